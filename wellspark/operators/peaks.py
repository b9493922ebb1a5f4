"""Beat detection, rate and spectral / geometric HRV per chunk (W4, W6, A11, A12), as windows and array functions.

Every step works inside one chunk (at most 60 s of samples), so frames, windows and arrays are bounded. Samples count
in hundredths, sums of samples are whole numbers and so do not depend on the order of addition. Methods follow
published descriptions: Elgendi et al. 2013 (two moving averages over the squared, band-limited signal) for systolic
peaks; Welch's averaged periodogram (1967) of the intervals, resampled evenly, over a fixed frequency grid for the band
powers; the least-squares triangle of the interval histogram for TINN (Task Force 1996).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspark.functions.numeric import safe_div
from wellspark.functions.text import let

# ---------------------------------------------------------------------------------------------------------
# Fixed method constants.
# ---------------------------------------------------------------------------------------------------------
SAMPLING_HZ = 20
BAND_HZ = (0.5, 8.0)
PEAK_WINDOW_S = 0.111
BEAT_WINDOW_S = 0.667
BEAT_OFFSET = 0.02
MIN_DELAY_S = 0.3
BANDS = {"VLF": (0.0033, 0.04), "LF": (0.04, 0.15), "HF": (0.15, 0.4), "VHF": (0.4, 0.5)}
HIST_BIN_MS = 1000.0 / 128.0
# ---------------------------------------------------------------------------------------------------------
GRID_STEP_HZ = 0.01
RESAMPLE_MS = 250  # the intervals' even grid: 4 Hz, twice what the highest band needs and more
WELCH_POINTS = 128  # 32 s, the longest segment; segments overlap by half
MIN_INTERVALS = 4  # fewer give no spectrum; TINN needs three

FREQ_COLUMNS = ("HRV_TINN", "HRV_LF", "HRV_HF", "HRV_VHF", "HRV_LFHF", "HRV_LFn", "HRV_HFn", "HRV_LnHF")


def widths(hz: float) -> dict[str, int]:
    """Samples on each side of the moving averages, the shortest block and the shortest way between beats."""
    return {
        "short": int(hz / BAND_HZ[1] / 2), "long": int(hz / BAND_HZ[0] / 2), "peak": int(PEAK_WINDOW_S * hz / 2),
        "beat": int(BEAT_WINDOW_S * hz / 2), "min_len": round(PEAK_WINDOW_S * hz), "delay": round(MIN_DELAY_S * hz),
    }


def grid(band: str) -> tuple[int, int]:
    """First and last step of the frequency grid inside a band (lower bound included, upper excluded)."""
    lo, hi = BANDS[band]
    return math.ceil(round(lo / GRID_STEP_HZ, 6)), math.ceil(round(hi / GRID_STEP_HZ, 6)) - 1


def peaks_per_chunk(
    samples: DataFrame, group: Sequence[str], order: str, signal: str, hz: float = SAMPLING_HZ
) -> DataFrame:
    """One row per beat: group columns, ``peak_no`` from 0, ``sample_index`` (place in the chunk), ``peak_ms`` (since
    the chunk's start, by a parabola through the peak and its neighbours), ``rate_bpm`` (from the interval before it)
    and ``n_samples`` of the chunk.

    Samples without a value are left out. A block is a run of samples whose short average of the squared signal lies
    above the long one; its highest sample is a beat unless the beat before it is too near.
    """
    group, k = list(group), widths(hz)
    w = Window.partitionBy(*group).orderBy("__o")
    whole = Window.partitionBy(*group)

    def mean(c: str, half: int) -> Column:
        return F.avg(c).over(w.rowsBetween(-half, half))

    x = samples.select(*group, F.col(order).alias("__o"), F.rint(F.col(signal).cast("double") * 100).alias("__v"))
    x = x.where(F.col("__v").isNotNull() & ~F.isnan("__v")).withColumn("__v", F.col("__v").cast("long"))
    # the one exchange of all steps; its explicit count keeps adaptive execution from merging chunks, whose array work
    # far outweighs their bytes, into a few tasks
    x = x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    x = x.select(*group, "__o", F.row_number().over(w).alias("__i"), F.count(F.lit(1)).over(whole).alias("__n"),
                 (mean("__v", k["short"]) - mean("__v", k["long"])).alias("__f"))
    x = x.withColumn("__q", F.when(F.col("__f") > 0, F.floor(F.col("__f") * F.col("__f"))).otherwise(F.lit(0)))
    x = x.withColumns({
        "__high": mean("__q", k["peak"]) > mean("__q", k["beat"]) + F.lit(BEAT_OFFSET) * F.avg("__q").over(whole),
        "__left": F.lag("__f").over(w), "__right": F.lead("__f").over(w),
    })
    starts = F.col("__high") & ~F.lag("__high", 1, False).over(w)
    x = x.withColumn("__block", F.sum(starts.cast("int")).over(w)).where("__high")
    top = F.max(F.struct("__f", (-F.col("__i")).alias("back"), "__left", "__right")).alias("__top")
    blocks = x.groupBy(*group, "__block").agg(F.count(F.lit(1)).alias("__len"), F.max("__n").alias("__n"), top)
    blocks = blocks.where(F.col("__len") >= k["min_len"])

    a, b, c = F.col("__top.__left"), F.col("__top.__f"), F.col("__top.__right")
    bend = a - F.lit(2.0) * b + c
    shift = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), safe_div(F.lit(0.5) * (a - c), bend)))
    beat = F.struct((-F.col("__top.back") - 1).alias("i"), F.coalesce(shift, F.lit(0.0)).alias("shift"))
    found = blocks.groupBy(*group).agg(F.max("__n").alias("n_samples"), F.sort_array(F.collect_list(beat)).alias("__all"))
    spaced = F.aggregate(
        F.slice("__all", 2, F.size("__all")), F.slice("__all", 1, 1),
        lambda kept, p: F.when(p["i"] - F.element_at(kept, -1)["i"] > k["delay"], F.concat(kept, F.array(p)))
        .otherwise(kept))
    beats = found.select(*group, "n_samples", F.posexplode(spaced).alias("peak_no", "__p")).select(
        *group, F.col("peak_no").cast("long").alias("peak_no"), F.col("__p.i").cast("long").alias("sample_index"),
        ((F.col("__p.i") + F.col("__p.shift")) * F.lit(1000.0) / F.lit(float(hz))).alias("peak_ms"), "n_samples")
    rr = F.col("peak_ms") - F.lag("peak_ms").over(Window.partitionBy(*group).orderBy("peak_no"))
    return beats.withColumn("rate_bpm", safe_div(F.lit(60000.0), rr))


def with_rate_share(peaks: DataFrame, group: Sequence[str], out: str = "rate_share") -> DataFrame:
    """The part of every beat in the chunk's mean rate; its sum per chunk is the mean over all samples of the rate
    interpolated linearly between beats and held before the first and after the last one.

    The first beat takes the mean interval; a chunk with one beat has no rate.
    """
    group = list(group)
    w, whole = Window.partitionBy(*group).orderBy("peak_no"), Window.partitionBy(*group)
    mean_rr = safe_div(F.max("peak_ms").over(whole) - F.min("peak_ms").over(whole), F.max("peak_no").over(whole))
    p = peaks.withColumn("__r", F.coalesce("rate_bpm", safe_div(F.lit(60000.0), mean_rr)))
    before, steps = F.lag("__r").over(w), F.col("sample_index") - F.lag("sample_index").over(w)
    rise = F.col("__r") - before
    share = F.when(F.col("peak_no") == 0, (F.col("sample_index") + 1) * F.col("__r")).otherwise(
        steps * before + rise * (steps + 1) / F.lit(2.0))
    tail = F.when(F.lead("peak_no").over(w).isNull(),
                  (F.col("n_samples") - 1 - F.col("sample_index")) * F.col("__r")).otherwise(F.lit(0.0))
    return p.withColumn(out, (share + tail) / F.col("n_samples")).drop("__r")


def _base_point(bins: str, towards: int) -> Column:
    """The histogram bin at which the triangle's side ``towards`` -1 or 1 of the mode meets zero (the nearest to the
    outermost bin of equally good ones; the mode where nothing lies on that side).

    Both sides' errors are independent. With width w, height Y and A = sum of counts times their distance from the
    base point, the error is Y^2 (w - 1)(2 w - 1) / (6 w) - 2 Y A / w plus a constant.
    """
    mode, height = F.col("__mode"), F.col("__height").cast("double")
    outer = F.array_min(F.transform(bins, lambda x: x["b"])) if towards < 0 else F.array_max(
        F.transform(bins, lambda x: x["b"]))
    reach = F.abs(mode - outer)

    def fit(width: Column) -> Column:
        base = mode + F.lit(towards) * width
        weight = F.aggregate(
            bins, F.lit(0).cast("long"),
            lambda acc, x: acc + F.when((x["b"] != mode) & ((x["b"] - mode) * towards > 0)
                                        & ((base - x["b"]) * towards > 0),
                                        x["c"] * F.abs(base - x["b"])).otherwise(F.lit(0)))
        wd = width.cast("double")
        err = (height * height * (wd - 1.0) * (F.lit(2.0) * wd - 1.0) / (F.lit(6.0) * wd)
               - F.lit(2.0) * height * weight.cast("double") / wd)
        return F.struct(err.alias("err"), (-width).alias("nearer"), base.alias("base"))

    fits = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(reach, F.lit(1))), fit)
    return F.when(reach == 0, mode).otherwise(F.array_min(fits)["base"])


def resampled(times: Column, rr: Column) -> Column:
    """The intervals on an even grid of RESAMPLE_MS from the first one's end, linearly between interval ends and up to
    the last one, which is left out. ``times`` are the beats (one more than intervals)."""
    step = F.lit(float(RESAMPLE_MS))
    first = F.element_at(times, 2)

    def between(k: Column) -> Column:
        t0, t1 = F.element_at(times, k + 2), F.element_at(times, k + 3)
        r0, r1 = F.element_at(rr, k + 1), F.element_at(rr, k + 2)
        low, high = F.ceil((t0 - first) / step), F.ceil((t1 - first) / step) - 1
        points = F.transform(F.sequence(low, F.greatest(low, high)),
                             lambda j: r0 + (r1 - r0) * ((j * step - (t0 - first)) / (t1 - t0)))
        return F.when(high >= low, points).otherwise(F.slice(points, F.lit(1), F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(rr) - 2), between))


def welch_power(points: Column, first: int, last: int) -> Column:
    """Power density (units^2 / Hz) of evenly sampled points at the steps ``first`` to ``last`` of the frequency grid:
    the mean over segments of at most WELCH_POINTS points, half overlapping, each less its mean and under a Hann
    window."""
    hz = 1000.0 / RESAMPLE_MS
    turn = 2 * math.pi * GRID_STEP_HZ / hz
    length = F.least(F.size(points), F.lit(WELCH_POINTS))
    hop = F.greatest(F.expr("1"), F.floor(length / 2).cast("int"))
    n_segments = F.floor((F.size(points) - length) / hop).cast("int") + 1
    hann = lambda i: F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * i / length)

    def windowed(s: Column) -> Column:
        segment = F.slice(points, s * hop + 1, length)
        mean = F.aggregate(segment, F.lit(0.0), lambda acc, x: acc + x) / length
        return let(mean, lambda m: F.transform(
            segment, lambda x, i: F.struct((hann(i) * (x - m)).alias("y"), i.cast("double").alias("i"))))

    def density(segments: Column) -> Column:
        weight = F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0.0), lambda acc, i: acc + hann(i) * hann(i))

        def at(k: Column) -> Column:
            def of(segment: Column) -> Column:
                part = lambda wave: F.aggregate(
                    segment, F.lit(0.0), lambda acc, p: acc + p["y"] * wave(F.lit(turn) * k * p["i"]))
                re, im = part(F.cos), part(F.sin)
                return re * re + im * im

            return F.aggregate(F.transform(segments, of), F.lit(0.0), lambda acc, x: acc + x)

        return let(weight, lambda w: F.transform(
            F.sequence(F.lit(first), F.lit(last)), lambda k: F.lit(2.0) * at(k) / (F.lit(hz) * w * n_segments)))

    return let(F.transform(F.sequence(F.lit(0), n_segments - 1), windowed), density)


def with_frequency_features(df: DataFrame, times_col: str, with_hti: bool = False) -> DataFrame:
    """A11 (TINN, optionally HTI) and A12 from an array column of beat times (ms) per row; drops ``times_col``.

    LFn and HFn are shares of VLF + LF + HF + VHF, LnHF = ln(HF); too few intervals or an empty power give NULL.
    """
    keep = [c for c in df.columns if c != times_col]
    n = F.greatest(F.size("__t") - 1, F.lit(0))
    x = df.withColumn("__t", F.sort_array(times_col))
    x = x.withColumn("__rr", F.zip_with(F.slice("__t", 2, n), F.slice("__t", 1, n), lambda b, a: b - a))
    x = x.withColumns({
        "__n": F.size("__rr"),
        "__bins": F.transform("__rr", lambda r: F.floor(r / F.lit(HIST_BIN_MS)).cast("long")),
    })
    x = x.withColumn("__hist", F.transform(
        F.array_sort(F.array_distinct("__bins")),
        lambda b: F.struct(b.alias("b"), F.size(F.filter("__bins", lambda v: v == b)).cast("long").alias("c"))))
    tallest = F.array_max(F.transform("__hist", lambda h: F.struct(h["c"].alias("c"), (-h["b"]).alias("back"))))
    x = x.withColumns({"__height": tallest["c"], "__mode": -tallest["back"]})
    last = grid("VHF")[1]
    enough = F.col("__n") >= MIN_INTERVALS
    x = x.withColumn("__points", F.when(enough, resampled(F.col("__t"), F.col("__rr"))))
    x = x.withColumn("__power", F.when(F.size("__points") > 1, welch_power(F.col("__points"), 1, last)))

    def band(name: str) -> Column:
        lo, hi = grid(name)
        total = F.aggregate(F.slice("__power", lo, hi - lo + 1), F.lit(0.0), lambda acc, p: acc + p)
        return total * F.lit(GRID_STEP_HZ)

    x = x.withColumns({f"__{b}": band(b) for b in BANDS})
    total = F.col("__VLF") + F.col("__LF") + F.col("__HF") + F.col("__VHF")
    out = {
        "HRV_TINN": F.when(F.col("__n") >= 3, (_base_point("__hist", 1) - _base_point("__hist", -1))
                           * F.lit(HIST_BIN_MS)),
        "HRV_LF": F.col("__LF"), "HRV_HF": F.col("__HF"), "HRV_VHF": F.col("__VHF"),
        "HRV_LFHF": safe_div("__LF", "__HF"), "HRV_LFn": safe_div(F.col("__LF"), total),
        "HRV_HFn": safe_div(F.col("__HF"), total), "HRV_LnHF": F.when(F.col("__HF") > 0, F.ln("__HF")),
    }
    if with_hti:
        out["HRV_HTI"] = safe_div(F.col("__n").cast("double"), F.col("__height"))
    return x.select(*keep, *[e.alias(c) for c, e in out.items()])


def frequency_features(peaks: DataFrame, group: Sequence[str], peak_ms: str = "peak_ms") -> DataFrame:
    """A11 (TINN) and A12 per chunk from its beats (bounded): one row per group with FREQ_COLUMNS."""
    per_chunk = peaks.groupBy(*group).agg(F.collect_list(peak_ms).alias("__ms"))
    return with_frequency_features(per_chunk, "__ms")
