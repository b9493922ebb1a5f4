"""Ordered operators that stay distributed when one key holds a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one task. Here every ordered step
is split by an order-respecting *bucket* (by default the calendar day of the order timestamp):

* rows are windowed inside ``(key, bucket)`` only;
* each bucket is reduced to one summary row (count, last value), so the per-key window runs over
  ``#buckets`` rows instead of ``#rows``;
* the summary is joined back on ``(key, bucket)`` to patch the first row of each bucket / add the offset.

The bucket must be monotone in the order key (``bucket(a) < bucket(b)`` implies ``a`` before ``b``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_bucket(ts_col: str) -> Column:
    """Default bucket: calendar day of a timestamp."""
    return F.to_date(F.col(ts_col))


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _bucketed(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Add ``__group``: the keys and the bucket as one struct. Structs are equal when their fields are, NULLs
    included, so windows and joins on it keep the rows of NULL keys and NULL order timestamps together."""
    return df.withColumn("__group", F.struct(*[F.col(k) for k in keys], bucket.alias("__bucket")))


def join_back(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` joined with a per-key table on the keys as one struct, so that the rows of NULL keys find theirs, as in a
    plain window."""
    others = [c for c in small.columns if c not in set(keys)]
    side = small.select(F.struct(*_cols(keys)).alias("__key"), *others)
    return df.withColumn("__key", F.struct(*_cols(keys))).join(side, on="__key", how=how).drop("__key")


def join_back_by_bucket(df: DataFrame, small: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """:func:`join_back` (inner) for keys that hold many rows: the per-key table is spread over the buckets of its keys
    first, a table of one row per (key, bucket), so that a key's rows meet it in as many tasks as the key has buckets.

    The rows are dealt out with an explicit count: adaptive execution would read them back in as few tasks as wrote them."""
    others = [c for c in small.columns if c not in set(keys)]
    x = _bucketed(df, keys, bucket)
    groups = x.select("__group").distinct().select("__group", *[F.col(f"__group.{k}").alias(k) for k in keys])
    spread = join_back(groups, small, keys).select("__group", *others)
    dealt = x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__group")
    return dealt.join(spread, on="__group").drop("__group")


def lag_across_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    bucket: Column | None = None,
) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` computed with bucket-local windows.

    The first row of a bucket takes the last value of the nearest earlier non-empty bucket of the same key.
    Plan: one grouped ``max_by`` per (key, bucket) (combined map-side, so only one row per bucket and task is
    shuffled) and a window over that small table give the carry; the bucket-local window runs on the full rows
    (shuffled and sorted once) and is then joined with the carry on (key, bucket).
    """
    keys, order = list(keys), list(order)
    b = "__bucket"
    x = _bucketed(df, keys, bucket if bucket is not None else day_bucket(order[0]))
    carry = (
        x.groupBy("__group")
        .agg(F.max_by(F.col(value), F.struct(*_cols(order))).alias("__last"))
        .withColumn("__carry", F.lag("__last").over(Window.partitionBy(*[F.col(f"__group.{k}") for k in keys]).orderBy(f"__group.{b}")))
        .select("__group", "__carry")
    )
    w_in = Window.partitionBy("__group").orderBy(*_cols(order))
    # window before the join: a sort-merge join then reuses the window's (key, bucket) partitioning and order,
    # so the full rows are sorted once; a small carry table is broadcast by AQE instead
    y = x.withColumns({"__lag_in": F.lag(value).over(w_in), "__first_in": F.lag(F.lit(True)).over(w_in).isNull()})
    return (
        y.join(carry, on="__group", how="left")
        .withColumn(out, F.when(F.col("__first_in"), F.col("__carry")).otherwise(F.col("__lag_in")))
        .drop("__lag_in", "__first_in", "__carry", "__group")
    )


def row_number_across_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "row_no",
    bucket: Column | None = None,
) -> DataFrame:
    """1-based ``row_number() over (partition by keys order by order)`` without a whole-key window.

    Offsets are a running sum of bucket counts (grouped count combined map-side, then a window over the small
    per-bucket table), joined back before the bucket-local ``row_number``.
    """
    keys, order = list(keys), list(order)
    b = "__bucket"
    x = _bucketed(df, keys, bucket if bucket is not None else day_bucket(order[0]))
    offsets = (
        x.groupBy("__group")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__offset",
            F.coalesce(
                F.sum("__n").over(
                    Window.partitionBy(*[F.col(f"__group.{k}") for k in keys]).orderBy(f"__group.{b}").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select("__group", "__offset")
    )
    w_in = Window.partitionBy("__group").orderBy(*_cols(order))
    return (
        x.withColumn("__rn_in", F.row_number().over(w_in))
        .join(offsets, on="__group", how="left")
        .withColumn(out, (F.col("__rn_in") + F.coalesce(F.col("__offset"), F.lit(0))).cast("long"))
        .drop("__rn_in", "__offset", "__group")
    )


def lead_across_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    prefix: str = "next_",
    bucket: Column | None = None,
) -> DataFrame:
    """``lead(v) over (partition by keys order by order)`` for each ``v`` in ``values``, with bucket-local windows.

    The last row of a bucket takes the first row of the nearest later non-empty bucket of the same key (grouped
    ``min_by`` per bucket, a window over the small table, join back, bucket-local window).
    Output columns: ``<prefix><v>``.
    """
    keys, order, values = list(keys), list(order), list(values)
    b = "__bucket"
    x = _bucketed(df, keys, bucket if bucket is not None else day_bucket(order[0]))
    carry = (
        x.groupBy("__group")
        .agg(F.min_by(F.struct(*[F.col(v) for v in values]), F.struct(*_cols(order))).alias("__first"))
        .withColumn("__carry", F.lead("__first").over(Window.partitionBy(*[F.col(f"__group.{k}") for k in keys]).orderBy(f"__group.{b}")))
        .select("__group", "__carry")
    )
    w_in = Window.partitionBy("__group").orderBy(*_cols(order))
    y = x.withColumns(
        {
            **{f"__lead_{i}": F.lead(v).over(w_in) for i, v in enumerate(values)},
            "__last_in": F.lead(F.lit(True)).over(w_in).isNull(),
        }
    )
    return (
        y.join(carry, on="__group", how="left")
        .withColumns(
            {
                f"{prefix}{v}": F.when(F.col("__last_in"), F.col(f"__carry.{v}")).otherwise(F.col(f"__lead_{i}"))
                for i, v in enumerate(values)
            }
        )
        .drop(*[f"__lead_{i}" for i in range(len(values))], "__last_in", "__carry", "__group")
    )
