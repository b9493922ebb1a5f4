"""Operators for preparing training text: packing, deduplication, near-duplicate joins, language, quality, tokens,
personal data and toxicity. Nothing outside this folder (and ``corpus_pipeline.py``) imports it."""
