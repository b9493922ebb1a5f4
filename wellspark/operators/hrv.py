"""Heart-rate-variability features per chunk and their scaling across chunks (A10, A11 HTI, A13-A16).

Formulas follow the published definitions (Task Force 1996; NeuroKit2 documentation), see SURVEY §2.4.1.
Input: one row per interbeat interval with ``rr`` (ms) and ``d`` (successive difference, ms) and group columns.
Groups are chunks of at most 1200 samples, so every aggregate here is bounded per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspark.functions.numeric import safe_div

# ---------------------------------------------------------------------------------------------------------
# Feature order of the 30-value vector fed to the stress scorer, and method constants.
# ---------------------------------------------------------------------------------------------------------
FEATURE_ORDER = (
    "HRV_MeanNN", "HRV_SDNN", "HRV_RMSSD", "HRV_SDSD", "HRV_CVNN", "HRV_CVSD", "HRV_MedianNN", "HRV_MadNN",
    "HRV_MCVNN", "HRV_IQRNN", "HRV_Prc80NN", "HRV_pNN50", "HRV_pNN20", "HRV_MinNN", "HRV_MaxNN", "HRV_TINN",
    "HRV_HTI", "HRV_LF", "HRV_PSS", "HRV_HF", "HRV_VHF", "HRV_LFHF", "HRV_LFn", "HRV_HFn", "HRV_LnHF",
    "HRV_SD1", "HRV_SD2", "HRV_SD1SD2", "HRV_S", "PPG_Rate_Mean",
)
MAD_SCALE = 1.4826
HIST_BIN_MS = 1000.0 / 128.0  # 7.8125 ms
# ---------------------------------------------------------------------------------------------------------

TIME_FEATURES = (
    "HRV_MeanNN", "HRV_SDNN", "HRV_RMSSD", "HRV_SDSD", "HRV_CVNN", "HRV_CVSD", "HRV_MedianNN", "HRV_MadNN",
    "HRV_MCVNN", "HRV_IQRNN", "HRV_Prc80NN", "HRV_pNN50", "HRV_pNN20", "HRV_MinNN", "HRV_MaxNN",
)
NONLINEAR_FEATURES = ("HRV_SD1", "HRV_SD2", "HRV_SD1SD2", "HRV_S")


def time_domain(
    df: DataFrame, group: Sequence[str], rr: str = "rr", d: str = "d", extra: Sequence[Column] = ()
) -> DataFrame:
    """A10: the fifteen time-domain features per group (NULL intervals ignored).

    ``extra`` aggregates are computed in the same pass (one shuffle for all per-chunk features)."""
    group = list(group)
    w = Window.partitionBy(*group)
    x = df.withColumn("__med", F.median(F.col(rr)).over(w))
    r, dd = F.col(rr).cast("double"), F.col(d).cast("double")
    agg = x.groupBy(*group).agg(
        F.count(r).alias("n_rr"),
        F.avg(r).alias("HRV_MeanNN"),
        F.stddev_samp(r).alias("HRV_SDNN"),
        F.sqrt(F.avg(dd * dd)).alias("HRV_RMSSD"),
        F.stddev_samp(dd).alias("HRV_SDSD"),
        F.median(r).alias("HRV_MedianNN"),
        (F.lit(MAD_SCALE) * F.median(F.abs(r - F.col("__med")))).alias("HRV_MadNN"),
        (F.percentile(r, 0.75) - F.percentile(r, 0.25)).alias("HRV_IQRNN"),
        F.percentile(r, 0.8).alias("HRV_Prc80NN"),
        F.count_if(F.abs(dd) > 50).alias("__nn50"),
        F.count_if(F.abs(dd) > 20).alias("__nn20"),
        F.min(r).alias("HRV_MinNN"),
        F.max(r).alias("HRV_MaxNN"),
        *extra,
    )
    return agg.withColumns(
        {
            "HRV_CVNN": safe_div("HRV_SDNN", "HRV_MeanNN"),
            "HRV_CVSD": safe_div("HRV_RMSSD", "HRV_MeanNN"),
            "HRV_MCVNN": safe_div("HRV_MadNN", "HRV_MedianNN"),
            "HRV_pNN50": safe_div(F.col("__nn50") * F.lit(100.0), F.col("n_rr")),
            "HRV_pNN20": safe_div(F.col("__nn20") * F.lit(100.0), F.col("n_rr")),
        }
    ).drop("__nn50", "__nn20")


def nonlinear(df: DataFrame) -> DataFrame:
    """Poincaré SD1, SD2, SD1/SD2 and ellipse area from SDNN and SDSD; negative radicand -> NULL."""
    sdnn, sdsd = F.col("HRV_SDNN"), F.col("HRV_SDSD")
    sd1_sq = F.lit(0.5) * sdsd * sdsd
    sd2_sq = F.lit(2.0) * sdnn * sdnn - F.lit(0.5) * sdsd * sdsd
    return df.withColumns(
        {
            "HRV_SD1": F.when(sd1_sq >= 0, F.sqrt(sd1_sq)),
            "HRV_SD2": F.when(sd2_sq >= 0, F.sqrt(sd2_sq)),
        }
    ).withColumns(
        {
            "HRV_SD1SD2": safe_div("HRV_SD1", "HRV_SD2"),
            "HRV_S": F.lit(math.pi) * F.col("HRV_SD1") * F.col("HRV_SD2"),
        }
    )


def triangular_index(df: DataFrame, group: Sequence[str], rr: str = "rr") -> DataFrame:
    """A11 (HTI): intervals / height of the tallest histogram bin (bin width 1000/128 ms).

    Two small grouped aggregates: counts per (group, bin), then max per group.
    """
    group = list(group)
    bins = (
        df.where(F.col(rr).isNotNull())
        .groupBy(*group, F.floor(F.col(rr) / F.lit(HIST_BIN_MS)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return bins.groupBy(*group).agg(
        F.sum("n").alias("n_rr"), F.max("n").alias("max_bin_count")
    ).withColumn("HRV_HTI", safe_div(F.col("n_rr").cast("double"), F.col("max_bin_count")))


def overwrite_pss(df: DataFrame, strict_pss: bool = False) -> DataFrame:
    """The reference stores LF in the PSS slot; ``strict_pss=True`` keeps a separately computed PSS."""
    if strict_pss and "HRV_PSS" in df.columns:
        return df
    return df.withColumn("HRV_PSS", F.col("HRV_LF") if "HRV_LF" in df.columns else F.lit(None).cast("double"))


def minmax_mean(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], rate_col: str | None = "PPG_Rate_Mean"
) -> DataFrame:
    """Min-max scale every feature across the key's chunks, then average - in closed form
    ``(avg - min) / (max - min)`` in one aggregate. Constant feature or one chunk -> NULL.
    ``Heart_Rate`` is the plain mean of ``rate_col`` (taken before scaling)."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_chunks")]
    for f in features:
        c = F.col(f).cast("double")
        aggs.append(safe_div(F.avg(c) - F.min(c), F.max(c) - F.min(c)).alias(f))
    if rate_col:
        aggs.append(F.avg(F.col(rate_col)).alias("Heart_Rate"))
    return df.groupBy(*keys).agg(*aggs)


def feature_vector(df: DataFrame, features: Sequence[str] = FEATURE_ORDER, out: str = "features") -> DataFrame:
    """The 30 scorer inputs (29 HRV features and the rate) as ``array<double>`` in the fixed order; absent ones NULL."""
    cols = [F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double") for f in features]
    return df.withColumn(out, F.array(*cols))
