"""Derivations the reference documents for its study tables (D1-D7, W9), as column expressions and grouped
aggregates.

Constants come from the published definitions named in SURVEY §2.11 (IPAQ scoring protocol, Bergenstal 2018).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspark.functions.numeric import safe_div
from wellspark.operators.ordered import lead_across_buckets

# ---------------------------------------------------------------------------------------------------------
# Fixed values of the published scoring rules.
# ---------------------------------------------------------------------------------------------------------
MET_WEIGHTS = {"vigorous": 8.0, "moderate": 4.0, "walking": 3.3}
MET_ACTIVE, MET_ACTIVE_VIGOROUS, MET_MINIMAL = 3000.0, 1500.0, 600.0
MIN_VIGOROUS_DAYS = 3
GMI_INTERCEPT, GMI_SLOPE = 3.31, 0.02392
GLUCOSE_LOW, GLUCOSE_HIGH = 70.0, 180.0
LOWEST_HR_WINDOW_US = 300 * 1_000_000
# ---------------------------------------------------------------------------------------------------------


def sleep_efficiency(sleep: Column, in_bed: Column) -> Column:
    """100 * sleep / time in bed (NULL when time in bed is 0)."""
    return safe_div(F.lit(100.0) * sleep, in_bed)


def bmi(weight_kg: Column, height_cm: Column) -> Column:
    """Kg / m^2."""
    return safe_div(weight_kg, F.pow(height_cm / F.lit(100.0), 2))


def met_minutes(df: DataFrame, keys: Sequence[str], day: Column, intensity: Column, minutes: Column) -> DataFrame:
    """D3: weekly MET-minutes and activity class per key and ISO week.

    ``intensity`` is one of vigorous / moderate / walking; class: active (>= 3000 MET-min, or >= 1500 with
    vigorous activity on >= 3 days), minimally active (>= 600), else inactive.
    """
    weight = F.coalesce(
        F.element_at(F.create_map(*[x for k, v in MET_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), intensity),
        F.lit(0.0),
    )
    x = df.select(*keys, F.date_trunc("week", day).cast("date").alias("week"), day.cast("date").alias("__day"),
                  (weight * minutes).alias("__met"), (intensity == "vigorous").alias("__vig"))
    agg = x.groupBy(*keys, "week").agg(
        F.sum("__met").alias("met_minutes"),
        F.count_distinct(F.when(F.col("__vig"), F.col("__day"))).alias("vigorous_days"),
    )
    met = F.col("met_minutes")
    return agg.withColumn(
        "activity_class",
        F.when(met >= MET_ACTIVE, "active")
        .when((met >= MET_ACTIVE_VIGOROUS) & (F.col("vigorous_days") >= MIN_VIGOROUS_DAYS), "active")
        .when(met >= MET_MINIMAL, "minimally active")
        .otherwise("inactive"),
    )


def glucose_summary(df: DataFrame, keys: Sequence[str], glucose: Column) -> DataFrame:
    """Samples, mean, SD, CV, GMI (% = 3.31 + 0.02392 * mean mg/dL) and shares below / in / above 70-180."""
    g = glucose
    n = F.count(g)
    return df.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(g).alias("mean"),
        F.stddev_samp(g).alias("sd"),
        safe_div(F.stddev_samp(g), F.avg(g)).alias("cv"),
        (F.lit(GMI_INTERCEPT) + F.lit(GMI_SLOPE) * F.avg(g)).alias("gmi"),
        safe_div(F.count_if(g < GLUCOSE_LOW), n).alias("share_below"),
        safe_div(F.count_if((g >= GLUCOSE_LOW) & (g <= GLUCOSE_HIGH)), n).alias("share_in_range"),
        safe_div(F.count_if(g > GLUCOSE_HIGH), n).alias("share_above"),
    )


def state_minutes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, state: Column, period: Column,
    max_gap: float | None = None,
) -> DataFrame:
    """Minutes spent per state (heart-rate zone, sleep stage) and period: each sample lasts until the next
    sample of the key; the last sample of a key lasts 0. ``max_gap`` (seconds) may bound a sample's time where a pause
    means that nothing was measured. The next sample comes from the bucketed ``lead`` (no whole-key window)."""
    x = df.withColumns({"__state": state, "__period": period})
    x = lead_across_buckets(x, keys, order, [ts], prefix="__next_")
    dur = F.coalesce(
        (F.unix_micros(F.col(f"__next_{ts}").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")))
        / F.lit(1e6),
        F.lit(0.0),
    )
    if max_gap is not None:
        dur = F.least(dur, F.lit(float(max_gap)))
    return x.groupBy(*keys, F.col("__period").alias("period"), F.col("__state").alias("state")).agg(
        (F.sum(dur) / F.lit(60.0)).alias("minutes"), F.count(F.lit(1)).alias("n_samples")
    )


def visit_change(df: DataFrame, keys: Sequence[str], visit: str, measure: str, visits: Sequence[str],
                 first: str, last: str) -> DataFrame:
    """One column per visit (``pivot`` with the visit list given, so no extra pass to find the values) and the
    change between two visits."""
    p = df.groupBy(*keys).pivot(visit, list(visits)).agg(F.avg(measure))
    return p.withColumn("change", F.col(f"`{last}`") - F.col(f"`{first}`"))


def lowest_sliding_mean(
    df: DataFrame, keys: Sequence[str], night: Column, ts: str, value: str, bucket_us: int = 3600 * 1_000_000
) -> DataFrame:
    """Lowest 5-minute sliding average of ``value`` per key and night.

    The range window runs inside hour buckets, not over a whole key-night: every row also goes, as a read-only
    halo row, to the next hour bucket when it lies in the last 5 minutes of its own hour, so each window frame
    is complete inside one bucket. Averages are kept for the bucket's own rows only, then the minimum per
    key-night is a grouped aggregate. Exact, and a participant with most of the samples is split by hour.
    """
    keys = list(keys)
    width = LOWEST_HR_WINDOW_US
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    x = df.select(*keys, night.alias("__night"), us.alias("__us"), F.col(value).alias("__v"))
    x = x.withColumn("__hour", F.floor(F.col("__us") / F.lit(bucket_us)))
    own = x.withColumn("__own", F.lit(True))
    halo = (
        x.where(F.col("__us") - F.col("__hour") * F.lit(bucket_us) >= F.lit(bucket_us - width))
        .withColumn("__hour", F.col("__hour") + 1)
        .withColumn("__own", F.lit(False))
    )
    both = own.unionByName(halo)
    w = Window.partitionBy(*keys, "__night", "__hour").orderBy("__us").rangeBetween(-(width - 1), 0)
    avgs = both.withColumn("__avg", F.avg("__v").over(w)).where(F.col("__own"))
    return avgs.groupBy(*keys, F.col("__night").alias("night")).agg(F.min("__avg").alias("lowest_5min_avg"))
