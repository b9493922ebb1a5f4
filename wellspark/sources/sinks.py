"""Sinks and the keyed result store.

The reference passes results between steps as JSON strings in an in-process dict keyed by a random UUID. Here
results stay DataFrames (lineage replaces the hand-off); when a result must outlive the job it is written as a
table under the session's shared checkpoint folder, keyed by ``(run_id, key)``.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.session import scratch_path


def records_json(df: DataFrame, date_cols=("date",)) -> DataFrame:
    """Each row as a JSON object; dates/timestamps as epoch milliseconds (pandas ``orient='records'``)."""
    conv = {}
    for c, t in df.dtypes:
        if c in date_cols or t in ("date", "timestamp", "timestamp_ntz"):
            conv[c] = F.unix_millis(F.col(c).cast("timestamp"))
    return df.withColumns(conv).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def columns_json(df: DataFrame, cols) -> DataFrame:
    """One JSON object per row over the listed columns (the reference's single feature object)."""
    return df.withColumn("json", F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}))


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows to a CSV folder (header on every part file, as each append writes its own file)."""
    df.write.mode("append").option("header", "true").option("escape", '"').csv(path)


def write_device_tree(df: DataFrame, root: str, device: str, file_name: str, user_col: str = "user_id",
                      order: Sequence[str] = ()) -> None:
    """The wearable layout as a partitioned CSV tree, one folder per participant, that the S1 to S3 readers take.

    Rows of one participant meet in one task and are written in the order of the columns named in ``order``, which are
    not written themselves."""
    placed = df.withColumns({"user_id": F.col(user_col).cast("string"), "device": F.lit(device), "file": F.lit(file_name)})
    if user_col != "user_id":
        placed = placed.drop(user_col)
    tree = ("user_id", "device", "file")
    placed = placed.repartition("user_id").sortWithinPartitions(*tree, *order)  # the writer sorts by the folders itself
    kept = [c for c in df.columns if c != user_col and c not in order]
    placed.select(*kept, *tree).write.mode("append").partitionBy(*tree).option("header", "true").csv(root)


def write_json_lines(json: DataFrame, path: str, col: str = "json") -> None:
    """One JSON text per line."""
    json.select(col).write.mode("overwrite").text(path)


def envelope(data: Column, description: Column) -> Column:
    """The stored payload envelope ``{"data": ..., "description": ...}``."""
    return F.to_json(F.struct(data.alias("data"), description.alias("description")), {"ignoreNullFields": "false"})


def store_results(spark: SparkSession, results: DataFrame, name: str) -> str:
    """S13 store: write ``(run_id, key, data, description)`` rows as Parquet under the shared folder."""
    path = scratch_path(spark, os.path.join("results", name))
    results.write.mode("overwrite").partitionBy("run_id").parquet(path)
    return path


def retrieve(spark: SparkSession, path: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S13 retrieve: stored rows for the requested ``(run_id, key)`` pairs, and the requested pairs that are
    missing (the reference raises on an unknown key)."""
    stored = spark.read.parquet(path)
    found = stored.join(keys, on=["run_id", "key"], how="inner")
    missing = keys.join(stored.select("run_id", "key"), on=["run_id", "key"], how="left_anti")
    return found, missing
