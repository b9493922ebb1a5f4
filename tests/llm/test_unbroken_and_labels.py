"""Texts without a blank through every operator, and labels with nulls, several per document and unknown ids."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wellspark.llm import (exact_dedup, language_id, ngram_join, packing, periodic_runs, pii, piece_codec, quality_model,
                           quality_rules, token_alignment, token_counts, toxicity, tree_bpe)

BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
N = 2_000_000


@pytest.fixture(scope="module")
def unbroken(spark):
    return spark.createDataFrame([(1, "abcdefgh" * (N // 8), "en"), (2, "日本語" * 60_000, "ja"), (3, "plain words here", "en")],
                                 "doc_id long, text string, lang string")


def test_tokens_of_unbroken_texts(spark, unbroken):
    from tokenizers import Tokenizer

    plain, word = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    texts = {r["doc_id"]: r["text"] for r in unbroken.collect()}
    n_ids = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    pieces = packing.token_pieces(unbroken, BYTES)
    got = {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == n_ids
    packed = packing.pack(pieces)
    assert packed.count() == pieces.count() and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
    counts = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(unbroken, RANKS).collect()}
    assert counts[1][0] == counts[2][0] == 1 and counts[3] == (3, 3) and 0 < counts[1][1] < N
    for r in tree_bpe.encode(unbroken, WORDS).collect():
        assert r["ids"] == word.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    short = unbroken.where("doc_id > 1")  # the streaming search takes a second per 100,000 characters
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode(piece_codec.encode(short, PIECES), PIECES).collect()}
    assert back == {i: t for i, t in texts.items() if i > 1}
    aligned = {r["doc_id"]: r for r in token_alignment.align(unbroken, BYTES, PIECES, groups_as_digest=True).collect()}
    assert all(r["n_links"] >= r["n_groups"] > 0 for r in aligned.values())


def test_other_operators_on_unbroken_texts(spark, unbroken):
    digests = {r["doc_id"]: r["digest"].hex() for r in exact_dedup.dedup(unbroken, exact_dedup.new_index(spark)).collect()}
    assert digests == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in unbroken.collect()}
    assert {r["class_id"] for r in ngram_join.ngram_join(unbroken).collect()} == {1, 2, 3}
    model = [("en", 0, "plain", 1.0), ("ja", 1, "日", 1.0)]
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(unbroken, model).collect()}[2] == "ja"
    runs = {r["doc_id"]: (r["n_words"], len(r["runs"])) for r in periodic_runs.find_runs(unbroken).collect()}
    assert runs == {1: (1, 0), 2: (1, 0), 3: (3, 0)}
    assert all(r["spans"] == [] for r in pii.find(unbroken, pii.learn()).collect())
    stats = {r["doc_id"]: (r["n_words"], r["word_chars"]) for r in quality_rules.judge(unbroken, []).collect()}
    assert stats == {1: (1, N), 2: (1, 180_000), 3: (3, 14)}
    marks = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_model.classify(unbroken, F.lit(0.0), marks, F.lit("h"), F.lit("p")).count() == 3
    assert not any(r["rejected"] for r in toxicity.score(unbroken, toxicity.Model({"bad": 9.0}, [3.0, 4.0, 5.0])).collect())


def test_labels_with_nulls_and_several_per_document(spark, documents, labels):
    wild = (labels.unionByName(labels.limit(40))
            .unionByName(spark.createDataFrame([(None, 0, 1), (10**9, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")))
    twice = documents.unionByName(documents.limit(100))  # repeated rows and ids
    rules, again = quality_rules.learn(documents, labels), quality_rules.learn(twice, wild)
    assert again == rules
    model, other = toxicity.learn(documents, labels), toxicity.learn(twice, wild)
    assert set(model.weights) == set(other.weights)
    kept = quality_model.classify(twice, quality_model.learn(twice, wild), wild, F.col("source"), F.col("lang"))
    assert kept.count() == twice.count()
    both = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_model.marks_of(both).first()["good"] == 0  # a bad word counts
