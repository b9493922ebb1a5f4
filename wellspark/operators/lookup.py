"""Id lookups and attribute joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.functions.text import strip_ws


def first_row_per_id(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """The first row (smallest ``order_col``) for each id; deterministic, unlike ``dropDuplicates``.

    A grouped ``min_by`` is partially aggregated before the shuffle, so a repeated id costs one row per task.
    """
    others = [c for c in df.columns if c != id_col]
    return (
        df.groupBy(id_col)
        .agg(F.min_by(F.struct(*others), F.col(order_col)).alias("__first"))
        .select(id_col, "__first.*")
    )


def lookup(
    table: DataFrame,
    id_col: str,
    requests: DataFrame,
    request_col: str,
    order_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """P8 batch form: ids are compared as strings after ``strip()``.

    Returns ``(found, missing)``: ``found`` has the request id plus the first matching table row;
    ``missing`` lists requested ids without a row (the reference raises for each).
    """
    keyed = table.withColumn("__id", strip_ws(F.col(id_col).cast("string")))
    if order_col is not None:
        keyed = first_row_per_id(keyed, "__id", order_col)
    req = requests.select(strip_ws(F.col(request_col).cast("string")).alias("__id")).distinct()
    found = req.join(keyed, on="__id", how="inner").withColumnRenamed("__id", "request_id")
    missing = req.join(keyed.select("__id"), on="__id", how="left_anti").withColumnRenamed("__id", "request_id")
    return found, missing


def attach_attributes(
    measures: DataFrame,
    participants: DataFrame,
    keys: Sequence[str],
) -> DataFrame:
    """Measures left-joined with participant attributes on the shared id.

    AQE broadcasts the side from its measured size or falls back to a shuffle join.
    """
    return measures.join(participants, on=list(keys), how="left")
