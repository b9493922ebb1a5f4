"""Pulse-signal segmentation: run starts, last segment, fixed-count chunks, interbeat intervals.

Every operator takes the key columns and an explicit order (the reference relies on file order, Q25).
Whole-key windows are avoided: ordered steps run inside ``(key, day)`` buckets (see ``ordered``), and the
segment bounds are per-key aggregates joined back, so one participant with most of the samples is still spread
over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspark.operators.ordered import day_bucket, join_back_by_bucket, lag_across_buckets, row_number_across_buckets

CHUNK_ROWS = 60 * 20  # 60 s at 20 Hz (fixed value of the reference)


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def mark_run_starts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    is_zero: Column,
    out: str = "is_start",
    bucket: Column | None = None,
) -> DataFrame:
    """A run starts where ``is_zero`` holds and the previous row's does not; a missing previous row counts."""
    df = df.withColumn("__z", is_zero)
    df = lag_across_buckets(df, keys, order, "__z", "__prev_z", bucket=bucket)
    return df.withColumn(out, F.col("__z") & F.coalesce(~F.col("__prev_z"), F.lit(True))).drop("__z", "__prev_z")


def last_segment(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    is_zero: Column,
    bucket: Column | None = None,
    closing_flag: str | None = None,
) -> DataFrame:
    """Rows from the second-last run start to the last run start of each key, both included.

    Keys with fewer than two starts give no rows (the reference fails with IndexError there).
    The two latest starts come from the start rows only, in one pass and without a whole-key window: the two
    latest of every (key, bucket) by a bucket-local window, then the two latest of those candidates per key (at
    most two rows per bucket); the per-key bounds are joined back bucket by bucket, to the rows as they came.
    ``closing_flag`` names an optional boolean output column that is true on the closing row (the last start).
    """
    keys = list(keys)
    marked = mark_run_starts(df, keys, order, is_zero, "__start", bucket=bucket)
    pos = _order_struct(order)
    b = bucket if bucket is not None else day_bucket(order[0])
    starts = marked.where("__start").select(*keys, b.alias("__b"), pos.alias("__pos"))
    latest_first = F.col("__pos").desc()
    cand = (
        starts.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(latest_first)))
        .where(F.col("__r") <= 2)
        .select(*keys, "__pos")
    )
    top2 = cand.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(latest_first))).where(
        F.col("__r") <= 2
    )
    bounds = (
        top2.groupBy(*keys)
        .agg(
            F.max(F.when(F.col("__r") == 1, F.col("__pos"))).alias("__last"),
            F.max(F.when(F.col("__r") == 2, F.col("__pos"))).alias("__second"),
        )
        .where(F.col("__second").isNotNull())
    )
    out = join_back_by_bucket(df, bounds, keys, b).where(
        (pos >= F.col("__second")) & (pos <= F.col("__last")))
    if closing_flag:
        out = out.withColumn(closing_flag, pos == F.col("__last"))
    return out.drop("__second", "__last")


def fixed_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int = CHUNK_ROWS,
    bucket: Column | None = None,
) -> DataFrame:
    """``chunk_id = floor((row_number - 1) / rows)`` in order within each key; the last chunk may be short."""
    out = row_number_across_buckets(df, keys, order, "row_no", bucket=bucket)
    return out.withColumn("chunk_id", F.floor((F.col("row_no") - 1) / F.lit(rows)).cast("long"))


def time_chunks(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seconds: float = CHUNK_ROWS / 20,
    out: str = "chunk_id",
) -> DataFrame:
    """W3 by time: ``chunk_id = floor((ts - the key's first ts) / seconds)``, whatever the sampling rate and however long
    a pause (a pause leaves chunk numbers out). Rows without a time have no chunk (NULL).

    The first times are a grouped minimum per (key, day), combined map-side, whose least per key is found in that small
    table and joined back day by day; no window over the rows, and no row number.
    """
    keys = list(keys)
    day = F.to_date(F.col(ts).cast("timestamp"))
    x = df.withColumn("__group", F.struct(*[F.col(k) for k in keys], day.alias("__day")))
    whole = Window.partitionBy(*[F.col(f"__group.{k}") for k in keys])  # one row per day
    first = x.groupBy("__group").agg(F.min(micros(ts)).alias("__us0")).withColumn("__us0", F.min("__us0").over(whole))
    length = F.lit(int(round(seconds * 1_000_000)))
    return x.join(first, on="__group").withColumn(
        out, F.floor((micros(ts) - F.col("__us0")) / length).cast("long")).drop("__us0", "__group")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def interbeat_intervals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ts_col: str,
    bucket: Column | None = None,
) -> DataFrame:
    """W5 over a whole key's sequence: ``rr_ms`` = whole milliseconds since the previous row, ``rr_diff`` =
    successive difference of ``rr_ms``. Both are NULL where there is no predecessor."""
    df = df.withColumn("__us", micros(ts_col))
    df = lag_across_buckets(df, keys, order, "__us", "__prev_us", bucket=bucket)
    df = df.withColumn("rr_ms", F.floor((F.col("__us") - F.col("__prev_us")) / F.lit(1000)).cast("long"))
    df = lag_across_buckets(df, keys, order, "rr_ms", "__prev_rr", bucket=bucket)
    return df.withColumn("rr_diff", F.col("rr_ms") - F.col("__prev_rr")).drop("__us", "__prev_us", "__prev_rr")


def chunk_intervals(df: DataFrame, group: Sequence[str], order: Sequence[str], ts_col: str) -> DataFrame:
    """W5 inside each chunk (the reference processes every chunk on its own, so the first beat of a chunk has
    no interval). Groups are bounded by the chunk size, so a plain window is fine here."""
    w = Window.partitionBy(*group).orderBy(*[F.col(c) for c in order])
    us = micros(ts_col)
    df = df.withColumn("rr_ms", F.floor((us - F.lag(us).over(w)) / F.lit(1000)).cast("long"))
    return df.withColumn("rr_diff", F.col("rr_ms") - F.lag("rr_ms").over(w))
