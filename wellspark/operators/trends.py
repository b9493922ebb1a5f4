"""Average, sum, trend and calendar-grain summaries per key.

All summaries are plain grouped aggregates: Spark computes them map-side (partial aggregation) and shuffles one
row per key and partition, so a key holding a large share of the rows does not create a large task.

Trend (A3) is the least-squares slope of a measure against days since the first date of the key. The slope does
not change when x is shifted, so x is taken as days since the epoch and no per-key minimum is needed for the slope;
the intercept (A4) is moved to the key's first date with one extra ``min(x)`` in the same aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.operators.ordered import join_back
from wellspark.functions.numeric import days_since_epoch, round_half_even
from wellspark.operators.selecting import measure_columns

HOW_ACTIVITY = ("average", "sum", "trend")
HOW_SLEEP = ("average", "trend")


def _check_how(how: str, allowed: Sequence[str]) -> None:
    if how not in allowed:
        raise ValueError(f"analysis must be one of {tuple(allowed)}, got {how!r}")


def _slope(y: str, x: Column) -> Column:
    # NaN/NULL anywhere in y makes the reference's slope NaN -> NULL here; a single row or constant x -> NULL.
    yc = F.col(y).cast("double")
    clean = F.count(F.when(~F.isnan(yc), yc)) == F.count(F.lit(1))
    return F.when(clean, F.regr_slope(yc, x))


def summarise(
    df: DataFrame,
    keys: Sequence[str],
    how: str,
    date_col: str = "date",
    measures: Sequence[str] | None = None,
    allowed: Sequence[str] = HOW_ACTIVITY,
    digits: int | None = None,
) -> DataFrame:
    """A1/A2/A3: one row per key with ``average`` / ``sum`` / ``trend`` of every measure.

    Measures default to every column whose name does not contain ``date`` (P11), minus the keys.
    Sum of an all-NULL column is 0 (pandas); average skips NULLs.
    """
    _check_how(how, allowed)
    keys = list(keys)
    if measures is None:
        measures = measure_columns(df, exclude=keys)
    types = dict(df.dtypes)

    def skip_nan(m: str) -> Column:
        # pandas mean/sum skip NaN as well as missing values; Spark would propagate NaN
        c = F.col(m)
        return F.nanvl(c, F.lit(None).cast(types[m])) if types.get(m) in ("double", "float") else c

    if how == "average":
        aggs = [F.avg(skip_nan(m)).alias(m) for m in measures]
    elif how == "sum":
        aggs = [F.coalesce(F.sum(skip_nan(m)), F.lit(0)).alias(m) for m in measures]
    else:
        x = days_since_epoch(date_col)
        aggs = [_slope(m, x).alias(m) for m in measures]
    out = df.groupBy(*keys).agg(*aggs)
    if digits is not None:
        out = out.withColumns({m: round_half_even(m, digits) for m in measures})
    return out


def trend_line(
    df: DataFrame,
    keys: Sequence[str],
    date_col: str,
    measure: str,
) -> DataFrame:
    """A4: per key slope and intercept (x = days since the key's first date) and the fitted value per row.

    The per-key fit is a grouped aggregate (one row per key) joined back on the key; AQE chooses a broadcast
    when that table is small and splits skewed keys otherwise.
    """
    keys = list(keys)
    x, y = days_since_epoch(date_col), F.col(measure).cast("double")
    fit = df.groupBy(*keys).agg(
        # slope and means over the same rows (those with a value); a NaN makes the fit NULL, as in the slope alone
        F.when(~F.bool_or(F.isnan(y)), F.regr_slope(y, x)).alias("slope"),
        F.regr_avgy(y, x).alias("__ybar"),
        F.regr_avgx(y, x).alias("__xbar"),
        F.min(x).alias("__x0"),
    )
    fit = fit.withColumn(
        "intercept", F.col("__ybar") - F.col("slope") * (F.col("__xbar") - F.col("__x0"))
    ).select(*keys, "slope", "intercept", "__x0")
    out = join_back(df, fit, keys)
    return out.withColumn(
        "fitted", F.col("intercept") + F.col("slope") * (x - F.col("__x0"))
    ).drop("__x0")


def daily_rollup(
    df: DataFrame,
    keys: Sequence[str],
    ts_col: str,
    measures: dict[str, Column],
    day_col: str = "date",
) -> DataFrame:
    """Pre-aggregate samples to one row per key and day (the grain of the daily sleep/activity tables)."""
    return df.groupBy(*keys, F.to_date(F.col(ts_col)).alias(day_col)).agg(
        *[expr.alias(name) for name, expr in measures.items()]
    )


def calendar_summary(
    df: DataFrame,
    keys: Sequence[str],
    date_col: str,
    grain: str,
    measures: Sequence[str],
    hows: Sequence[str] = ("average",),
    rollup: bool = False,
) -> DataFrame:
    """A5: summaries per key and calendar period (``grain`` in day/week/month/quarter/year).

    Output columns: key columns, ``period``, ``n_rows`` and ``<how>_<measure>`` for each requested summary.
    ``rollup=True`` adds per-key and grand totals (``rollup(keys..., period)``).
    """
    fns = {"average": F.avg, "sum": F.sum}
    for how in hows:
        _check_how(how, tuple(fns))
    period = F.to_date(F.date_trunc(grain, F.col(date_col))).alias("period")
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [fns[how](F.col(m)).alias(f"{how}_{m}") for how in hows for m in measures]
    if rollup:
        return df.rollup(*keys, period).agg(*aggs)
    return df.groupBy(*keys, period).agg(*aggs)


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean / sum / count / min / max of every numeric column over a stored result, one row."""
    if cols is None:
        cols = [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "decimal")]
    aggs = []
    for c in cols:
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.sum(c).alias(f"{c}_sum"),
            F.count(c).alias(f"{c}_count"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return df.agg(*aggs)
