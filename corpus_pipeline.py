"""A training-corpus pipeline over ``documents``: toxicity filter, exact deduplication, near-duplicate join, masking of
personal data, packing into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes every stage's result as Parquet in
the shared checkpoint folder and reads it again as the next one's ``docs``, so a lost executor never costs more than the
running stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from wellspark.llm import exact_dedup, ngram_join, packing, pii, toxicity
from wellspark.llm.queries import CAPACITY, END_ID, vocabulary
from wellspark.session import drop_path, write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, learned from the labels of the documents at hand: rejected documents go."""
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return toxicity.keep_harmless(docs, toxicity.learn(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts (A-Z lower-cased) the document with the largest id stays."""
    return exact_dedup.keep_first_copies(docs, exact_dedup.new_index(spark, exact_dedup.buckets_for(docs.count())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near-duplicates (five words, similarity 0.8) the smallest id stays."""
    return ngram_join.keep_one_per_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: spans of personal data become marks of their kind."""
    return pii.mask(docs, pii.learn())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pieces of the documents' tokens with their sequence and place in it."""
    pieces = packing.token_pieces(docs, vocabulary("byte_bpe_50k.json"), CAPACITY, END_ID)
    return packing.pack(pieces, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

# learned weights, MinHash and tokenizers are not SQL: tests/llm compares the stages with brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is dropped when the next one's is written."""
    docs, before = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), None
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        path = write_table(found, f"stage-{name}")
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
