"""Beat detection, rate, triangle and spectrum on signals with a known answer and against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspark.operators import hrv, peaks as pk, ppg

HIST = pk.HIST_BIN_MS


def test_sine_three_chunks_rate_60(spark):
    rows = [("u", i, float(10 * math.sin(2 * math.pi * i / 20.0))) for i in range(20 * 180)]
    df = spark.createDataFrame(rows, "user_id string, i long, ppg double")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("i") / 20))
    chunks = ppg.fixed_chunks(df, ["user_id"], ["ts", "i"], rows=1200)
    g = ["user_id", "chunk_id"]
    p = pk.with_rate_share(pk.peaks_per_chunk(chunks, g, "row_no", "ppg"), g).cache()
    rates = {r[0]: r[1] for r in p.groupBy("chunk_id").agg(F.sum("rate_share")).collect()}
    assert sorted(rates) == [0, 1, 2] and all(abs(r - 60.0) < 1 for r in rates.values())
    counts = [r["count"] for r in p.groupBy("chunk_id").count().collect()]
    assert all(c in (59, 60, 61) for c in counts)


def test_odd_samples(spark):
    """NULL keys and values, a flat chunk, one sample and no rows."""
    rows = [(None, i, 10 * math.sin(2 * math.pi * i / 20.0)) for i in range(200)]
    rows += [(1, i, 5.0) for i in range(50)] + [(2, 0, 1.0)] + [(3, i, None) for i in range(5)] + [(None, 500, None)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    out = pk.peaks_per_chunk(df, ["k"], "i", "v").collect()
    assert {r.k for r in out} == {None} and 9 <= len(out) <= 10
    assert pk.peaks_per_chunk(df.limit(0), ["k"], "i", "v").count() == 0


def _triangle(rr):
    """Plain loops: both base points tried bin by bin, the error summed over all bins."""
    b = np.floor(np.asarray(rr) / HIST).astype(int)
    lo, hi = b.min(), b.max()
    h = np.bincount(b - lo, minlength=hi - lo + 1).astype(float)
    x, y = int(np.argmax(h)), h.max()

    def error(n, m):
        q = np.zeros(len(h))
        for i in range(len(h)):
            if n <= i <= x and x > n:
                q[i] = y * (i - n) / (x - n)
            elif x <= i <= m and m > x:
                q[i] = y * (m - i) / (m - x)
        q[x] = y
        return round(((h - q) ** 2).sum(), 9)

    left = range(0, x) if x > 0 else [x]
    right = range(x + 1, len(h)) if x < len(h) - 1 else [x]
    return min((error(n, m), n - m) for n in left for m in right)[1] * -HIST


@pytest.mark.parametrize("seed", range(4))
def test_features_match_loops(spark, seed):
    rng = np.random.default_rng(seed)
    rr = np.round(rng.normal(800, 60, 60), 3)
    t = np.concatenate([[0.0], np.cumsum(rr)])
    df = spark.createDataFrame([(1, [float(v) for v in t])], "k int, t array<double>")
    got = pk.with_frequency_features(df, "t", with_hti=True).collect()[0]
    rr = np.diff(t)
    power = 0.01 * welch(np.interp(np.arange(t[1], t[-1], 250.0), t[1:], rr))
    lf, hf = sum(power[4:15]), sum(power[15:40])
    assert got.HRV_LF == pytest.approx(lf) and got.HRV_HF == pytest.approx(hf)
    assert got.HRV_LFHF == pytest.approx(lf / hf) and got.HRV_LnHF == pytest.approx(math.log(hf))
    bins = np.floor(rr / HIST)
    assert got.HRV_HTI == pytest.approx(len(rr) / max(np.unique(bins, return_counts=True)[1]))
    assert got.HRV_TINN == pytest.approx(_triangle(rr))


def welch(x, points=128, hz=4.0):
    """Density at 0.00, 0.01 ... 0.49 Hz."""
    n = min(len(x), points)
    w = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(n) / n)
    turn = np.exp(-2j * math.pi * 0.01 * np.outer(np.arange(50), np.arange(n)) / hz)
    parts = [x[s : s + n] for s in range(0, len(x) - n + 1, n // 2)]
    return np.mean([2 * np.abs(turn @ (w * (p - p.mean()))) ** 2 / (hz * (w * w).sum()) for p in parts], axis=0)


@pytest.mark.parametrize("rhythm,band,other", [(0.1, "HRV_LF", "HRV_HF"), (0.25, "HRV_HF", "HRV_LF")])
def test_a_rhythm_lands_in_its_band(spark, rhythm, band, other):
    t, times = 0.0, [0.0]
    while t < 60_000:
        t += 800 + 50 * math.sin(2 * math.pi * rhythm * t / 1000)
        times.append(t)
    got = pk.with_frequency_features(spark.createDataFrame([(1, times)], "k int, t array<double>"), "t").first()
    assert got[band] > 20 * got[other] and got[band] == pytest.approx(50 ** 2 / 2, rel=0.25)  # half the squared amplitude


def test_twenty_hertz_with_every_width_active(spark):
    """A pulse wave with a second, lower wave per beat and a slow drift, at the reference's rate: all six widths count."""
    widths = pk.widths(20)
    assert all(widths.values())
    times = np.arange(1200) / 20
    beats = np.cumsum(np.r_[0.4, np.tile([0.8, 0.9, 1.0], 22)])
    beats = beats[beats < 59]
    wave = sum(np.exp(-((times - b) / 0.12) ** 2) + 0.3 * np.exp(-((times - b - 0.35) / 0.1) ** 2) for b in beats)
    signal = 100 + 10 * wave + 3 * np.sin(2 * math.pi * 0.05 * times)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(signal)], "k int, i int, v double")
    found = sorted(r.peak_ms / 1000 for r in pk.peaks_per_chunk(df, ["k"], "i", "v", 20).collect())
    assert len(found) == len(beats) and np.abs(np.array(found) - beats).max() < 0.05


def test_low_frequency_modulation(spark):
    t, times = 0.0, [0.0]
    while t < 60_000:
        t += 1000 + 50 * math.sin(2 * math.pi * 0.1 * t / 1000)
        times.append(t)
    df = spark.createDataFrame([(1, times), (2, [5.0]), (3, []), (4, None), (5, [1.0, 2.0])], "k int, t array<double>")
    got = {r.k: r for r in pk.with_frequency_features(df, "t", with_hti=True).collect()}
    assert got[1].HRV_LF > 10 * got[1].HRV_HF
    for k in (2, 3, 4, 5):
        assert all(got[k][c] is None for c in pk.FREQ_COLUMNS)
    assert got[5].HRV_HTI == 1.0


def test_rate_is_the_mean_over_samples(spark):
    rows = [(1, 0, 3, 750.0, 20, None), (1, 1, 8, 2000.0, 20, 48.0), (1, 2, 14, 3500.0, 20, 40.0)]
    df = spark.createDataFrame(rows, "k int, peak_no long, sample_index long, peak_ms double, n_samples long, rate_bpm double")
    got = pk.with_rate_share(df, ["k"]).agg(F.sum("rate_share")).collect()[0][0]
    first = 60000 / 1375.0
    want = np.interp(np.arange(20), [3, 8, 14], [first, 48.0, 40.0]).mean()
    assert got == pytest.approx(want)


def test_features_feed_the_scorer_in_order():
    assert set(pk.FREQ_COLUMNS) <= set(hrv.FEATURE_ORDER)
