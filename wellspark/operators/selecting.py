"""Projection, renaming, date-range selection and simple column transforms."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.functions.numeric import round_half_even
from wellspark.functions.text import strip_ws

UPPER_MODES = ("inclusive_next_midnight", "exclusive", "inclusive")


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the listed columns in the listed order (column pruning reaches the scan)."""
    return df.select(*cols)


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename columns by position."""
    if len(names) != len(df.columns):
        raise ValueError(f"expected {len(df.columns)} names, got {len(names)}")
    return df.toDF(*names)


def parse_day(c: Column | str) -> Column:
    """``YYYY-MM-DD`` text -> date."""
    return F.to_date(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def parse_epoch_ms(c: Column | str) -> Column:
    """Epoch milliseconds -> timestamp."""
    return F.timestamp_millis(F.col(c) if isinstance(c, str) else c)


def select_range(
    df: DataFrame,
    date_col: str,
    start: str,
    end: str | None = None,
    cols: Sequence[str] | None = None,
    upper: str = "inclusive_next_midnight",
) -> DataFrame:
    """Rows of a date range.

    ``end`` given: ``start <= d <= end + 1 day`` (both ends included, as the reference does; on daily tables this
    also returns the day after ``end``). ``upper="exclusive"`` gives ``d < end + 1 day``; ``"inclusive"`` gives
    ``d <= end`` on the column's own type. ``end`` empty: equality with ``start`` at midnight.
    The bounds are literals, so the comparison is pushed to the Parquet scan.
    """
    if upper not in UPPER_MODES:
        raise ValueError(f"upper must be one of {UPPER_MODES}")
    d = F.col(date_col)
    lo = F.to_timestamp(F.lit(start), "yyyy-MM-dd")
    is_date = dict(df.dtypes).get(date_col) == "date"
    if is_date:
        lo = F.to_date(F.lit(start), "yyyy-MM-dd")
    if end:
        hi_day = F.date_add(F.to_date(F.lit(end), "yyyy-MM-dd"), 1)
        hi = hi_day if is_date else hi_day.cast("timestamp")
        if upper == "inclusive_next_midnight":
            cond = (d >= lo) & (d <= hi)
        elif upper == "exclusive":
            cond = (d >= lo) & (d < hi)
        else:
            end_lit = F.to_date(F.lit(end), "yyyy-MM-dd")
            cond = (d >= lo) & (d <= (end_lit if is_date else end_lit.cast("timestamp")))
    else:
        cond = d == lo
    out = df.where(cond)
    return out.select(*cols) if cols else out


def select_day(df: DataFrame, date_col: str, day: str) -> DataFrame:
    """Single-date selection (equality at midnight)."""
    return select_range(df, date_col, day, None)


def select_keys(df: DataFrame, key_col: str, values: Iterable) -> DataFrame:
    """Participant / device selection; on partitioned Parquet this prunes partitions."""
    return df.where(F.col(key_col).isin(list(values)))


def seconds_to_minutes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Divide the listed columns by 60, skipping names the frame does not have."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.col(c) / F.lit(60.0) for c in present})


def round_columns(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """P10: half-even rounding (NumPy semantics) on the listed (default: all floating) columns."""
    if cols is None:
        cols = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: round_half_even(c, digits) for c in cols})


def measure_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Every column whose name does not contain ``date`` (any case), minus ``exclude``."""
    return [c for c in df.columns if "date" not in c.lower() and c not in exclude]


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are NULL in every row (one aggregate job decides the schema)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def zero_if_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing or NULL counts as 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})


def with_requested_keys(requests: DataFrame, result: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join from the requested keys; ``has_data`` is false where the selection was empty."""
    flagged = result.withColumn("__hit", F.lit(True))
    return requests.join(flagged, on=list(keys), how="left").withColumn(
        "has_data", F.coalesce(F.col("__hit"), F.lit(False))
    ).drop("__hit")


def strip_argument(c: Column | str) -> Column:
    """Python ``str.strip()`` on an argument column."""
    return strip_ws(c)
