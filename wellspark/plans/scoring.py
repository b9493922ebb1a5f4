"""Stress scoring bound to the driver tables: ``embeddings`` (every window of 30 values as an HRV feature vector),
seeded weights (the reference's weight files are not published)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.operators import scoring as sc
from wellspark.sources.tables import table

ENCODER_SEED, HEAD_SEED = 1, 2
WIDTH, STEP = 30, 17
ENCODER = sc.seeded_layers(sc.ENCODER_SIZES, ENCODER_SEED)
HEAD = sc.seeded_layers(sc.HEAD_SIZES, HEAD_SEED)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole vector of every embedding as overlapping windows of the scorer's width, the last one at its end."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= WIDTH)
    last = F.size("embedding") - (WIDTH - 1)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(STEP)), F.array(last)))
    cut = e.select("vec_id", "embedding", F.posexplode(starts).alias("window_no", "start"))
    return cut.select("vec_id", F.col("window_no").cast("long").alias("window_no"),
                      F.expr(f"slice(embedding, start, {WIDTH})").cast("array<double>").alias("x"))


WINDOWS_SQL = f"""(SELECT vec_id, CAST(i - 1 AS BIGINT) AS window_no,
    CAST(embedding[starts[i]:starts[i] + {WIDTH - 1}] AS DOUBLE[]) AS x
  FROM (SELECT vec_id, embedding, starts, unnest(generate_series(1, len(starts))) AS i FROM (
    SELECT vec_id, embedding, list_sort(list_distinct(list_append(
      generate_series(1, len(embedding) - {WIDTH - 1}, {STEP}), len(embedding) - {WIDTH - 1}))) AS starts
    FROM embeddings WHERE len(embedding) >= {WIDTH})))"""


def stress_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.score_stress(windows(spark, sf_dir), "x", ENCODER, HEAD, keep=["vec_id", "window_no"])


QUERIES = {"stress_score": stress_score}


def _oracle() -> str:
    enc, enc_last = sc.layers_sql(
        WINDOWS_SQL, ["vec_id", "window_no"], "x", ENCODER, "none", prefix="enc"
    )
    head, head_last = sc.layers_sql(enc_last, ["vec_id", "window_no"], "h", HEAD, "sigmoid", prefix="head")
    return (
        "WITH " + ",\n".join(enc + head)
        + f"\nSELECT vec_id, window_no, CAST(list_position(h, list_max(h)) - 1 AS INTEGER) AS stress_level FROM {head_last}"
    )


ORACLES = {"stress_score": _oracle()}
