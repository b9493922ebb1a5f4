"""The operators as queries over the given tables, with their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.llm import (exact_dedup, language_id, ngram_join, packing, periodic_runs, pii, piece_codec,
                           quality_model, quality_rules, token_alignment, token_counts, toxicity, tree_bpe)
from wellspark.sources.tables import table

CAPACITY = 1024
END_ID = 2


def vocabulary(name: str) -> str:
    """The path of an installed public tokenizer file; every machine of the cluster has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, vocabulary("byte_bpe_50k.json"), CAPACITY, END_ID)
    return packing.pack(pieces, CAPACITY)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup.dedup(docs, exact_dedup.new_index(spark, exact_dedup.buckets_for(docs.count())))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_join(docs, n=5, threshold=Fraction(4, 5), recall=0.9995)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language_id.learn(docs, ~held_out)
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels")
    evidence = quality_model.learn(docs, labels)
    return quality_model.classify(docs, evidence, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, vocabulary("byte_bpe_50k.tiktoken"))


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = vocabulary("piece_bpe_32k.model")
    found = piece_codec.decode(piece_codec.encode(docs, model), model)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
                        F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def span_list(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn())
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in pii.KINDS],
                        F.sha2(F.encode(span_list("base"), "utf-8"), 256).alias("base_sha256"),
                        span_list("spans").alias("spans"),
                        F.size(F.filter("spans", lambda s: s["kind"] == pii.SECRET)).cast("long").alias("n_secret"),
                        (F.size("spans") > 0).alias("has_pii"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary("word_bpe_49k.json")
    found = tree_bpe.decode(tree_bpe.encode(docs, path), path)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.encode(F.concat_ws(" ", F.col("ids").cast("array<string>")), "utf-8"), 256)
                        .alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the documents its words with a tail that repeats itself, by the doc_id's CRC."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(crc / 10)

    def repeat(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        period = F.slice(words, a + 1, p)
        tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)

    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return F.when(crc % 10 == 0, F.element_at(F.transform(F.array(words), repeat), 1)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs)
    longer = lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(periodic_runs.RUN), longer)  # runs come by start, then period
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    rows = found.select("*", best.alias("best"), F.array_join(F.transform("runs", line), "").alias("lines"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode("lines", "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"),
                                  groups_as_digest=True)
    return found.select("doc_id", *token_alignment.MEASURES, F.col("groups").alias("groups_sha256"))


QUERIES = {
    f.__name__: f for f in (op1_best_fit_packing, op2_exact_dedup, op3_ngram_jaccard_join, op4_language_id,
                            op5_quality_classifier, op6_token_counts, op7_sentencepiece_codec, op8_quality_rules,
                            op9_pii, op10_toxicity, op11_tree_bpe, op12_periodic_runs, op13_token_alignment)
}
ORACLES = {"op2_exact_dedup": OP2_SQL}
