"""Pulse-signal and HRV operators bound to the driver tables.

Stand-in (SURVEY §7.5): ``events`` rows of one user, ordered by ``(ts, event_id)``, are the samples;
``event_type = 'error'`` plays ``hr == 0``; the gaps between successive events are the interbeat intervals;
chunks hold 20 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.numeric import round_half_even
from wellspark.operators import hrv
from wellspark.operators import ppg
from wellspark.sources.tables import table

KEYS = ["user_id"]
ORDER = ["ts", "event_id"]
CHUNK = 20


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


def _is_zero():
    return F.col("event_type") == "error"


def run_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ppg.mark_run_starts(_events(spark, sf_dir), KEYS, ORDER, _is_zero())
    return m.where("is_start").select("user_id", "event_id", "ts")


def last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppg.last_segment(_events(spark, sf_dir), KEYS, ORDER, _is_zero()).select(
        "user_id", "event_id", "ts", "event_type", "value"
    )


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppg.fixed_chunks(_events(spark, sf_dir), KEYS, ORDER, rows=CHUNK).select(
        "event_id", "user_id", "row_no", "chunk_id"
    )


def beat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppg.interbeat_intervals(_events(spark, sf_dir), KEYS, ORDER, "ts").select(
        "event_id", "user_id", "rr_ms", "rr_diff"
    )


def chunk_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = ppg.fixed_chunks(_events(spark, sf_dir), KEYS, ORDER, rows=CHUNK)
    rr = ppg.chunk_intervals(chunks, ["user_id", "chunk_id"], ORDER, "ts")
    return rr.select("user_id", "chunk_id", F.col("rr_ms").alias("rr"), F.col("rr_diff").alias("d"))


def _time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hrv.time_domain(chunk_rr(spark, sf_dir), ["user_id", "chunk_id"])


def _round(df: DataFrame, cols, digits=4) -> DataFrame:
    return df.withColumns({c: round_half_even(c, digits) for c in cols})


def hrv_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _time(spark, sf_dir)
    return _round(t, hrv.TIME_FEATURES).select("user_id", "chunk_id", "n_rr", *hrv.TIME_FEATURES)


def hrv_nonlinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the ellipse area is reported in s^2 and whole units: in ms^2 the event gaps give values near 1e16, where
    # the last bits of two engines' sums differ
    t = hrv.nonlinear(_time(spark, sf_dir))
    t = _round(t, ["HRV_SD1", "HRV_SD2", "HRV_SD1SD2"]).withColumn(
        "HRV_S_s2", round_half_even(F.col("HRV_S") / F.lit(1e6), 0)
    )
    return t.select("user_id", "chunk_id", "HRV_SD1", "HRV_SD2", "HRV_SD1SD2", "HRV_S_s2")


def hrv_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hrv.triangular_index(chunk_rr(spark, sf_dir), ["user_id", "chunk_id"])
    return _round(h, ["HRV_HTI"]).select("user_id", "chunk_id", "n_rr", "max_bin_count", "HRV_HTI")


def minmax_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hrv.nonlinear(_time(spark, sf_dir))
    t = t.withColumn("PPG_Rate_Mean", F.try_divide(F.lit(60000.0), F.col("HRV_MeanNN")))
    feats = list(hrv.TIME_FEATURES) + list(hrv.NONLINEAR_FEATURES)
    out = hrv.minmax_mean(t, ["user_id"], feats, "PPG_Rate_Mean")
    return _round(out, feats + ["Heart_Rate"]).select("user_id", "n_chunks", *feats, "Heart_Rate")


QUERIES = {
    "run_starts": run_starts,
    "last_segment": last_segment,
    "fixed_chunks": fixed_chunks,
    "beat_intervals": beat_intervals,
    "hrv_time": hrv_time,
    "hrv_nonlinear": hrv_nonlinear,
    "hrv_hist": hrv_hist,
    "minmax_mean": minmax_mean,
}


def _r4(x: str) -> str:
    return f"round_even(({x}) * 10000, 0) / 10000"


_W = "PARTITION BY user_id ORDER BY ts, event_id"
_STARTS = f"""s AS (
  SELECT user_id, event_id, ts, event_type, value,
         event_type = 'error' AND COALESCE(NOT (lag(event_type = 'error') OVER ({_W})), TRUE) AS is_start
  FROM events)"""
_CHUNKS = f"""c AS (
  SELECT user_id, event_id, ts, row_number() OVER ({_W}) AS row_no FROM events),
cc AS (SELECT *, (row_no - 1) // {CHUNK} AS chunk_id FROM c),
r AS (SELECT user_id, chunk_id, ts, event_id,
             (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, chunk_id ORDER BY ts, event_id)) // 1000
               AS rr
      FROM cc),
rd AS (SELECT user_id, chunk_id, rr,
              rr - lag(rr) OVER (PARTITION BY user_id, chunk_id ORDER BY ts, event_id) AS d,
              median(rr) OVER (PARTITION BY user_id, chunk_id) AS med
       FROM r)"""
# features per chunk from the intervals in ``rd`` (rr, successive difference d, the chunk's median med)
TIME_FROM_INTERVALS = """t AS (
  SELECT user_id, chunk_id, COUNT(rr) AS n_rr,
    AVG(rr) AS HRV_MeanNN, stddev_samp(rr) AS HRV_SDNN, sqrt(AVG(d::DOUBLE * d)) AS HRV_RMSSD,
    stddev_samp(d) AS HRV_SDSD, median(rr::DOUBLE) AS HRV_MedianNN,
    1.4826::DOUBLE * median(abs(rr - med)::DOUBLE) AS HRV_MadNN,
    quantile_cont(rr::DOUBLE, 0.75) - quantile_cont(rr::DOUBLE, 0.25) AS HRV_IQRNN,
    quantile_cont(rr::DOUBLE, 0.8) AS HRV_Prc80NN,
    COUNT(*) FILTER (WHERE abs(d) > 50) * 100.0::DOUBLE / NULLIF(COUNT(rr), 0) AS HRV_pNN50,
    COUNT(*) FILTER (WHERE abs(d) > 20) * 100.0::DOUBLE / NULLIF(COUNT(rr), 0) AS HRV_pNN20,
    MIN(rr)::DOUBLE AS HRV_MinNN, MAX(rr)::DOUBLE AS HRV_MaxNN
  FROM rd GROUP BY user_id, chunk_id),
tf AS (
  SELECT *, HRV_SDNN / HRV_MeanNN AS HRV_CVNN, HRV_RMSSD / HRV_MeanNN AS HRV_CVSD,
         HRV_MadNN / HRV_MedianNN AS HRV_MCVNN,
         CASE WHEN 0.5 * HRV_SDSD * HRV_SDSD >= 0 THEN sqrt(0.5::DOUBLE * HRV_SDSD * HRV_SDSD) END AS HRV_SD1,
         CASE WHEN 2.0 * HRV_SDNN * HRV_SDNN - 0.5 * HRV_SDSD * HRV_SDSD >= 0
              THEN sqrt(2.0::DOUBLE * HRV_SDNN * HRV_SDNN - 0.5::DOUBLE * HRV_SDSD * HRV_SDSD) END AS HRV_SD2
  FROM t),
tn AS (
  SELECT *, HRV_SD1 / NULLIF(HRV_SD2, 0) AS HRV_SD1SD2, pi() * HRV_SD1 * HRV_SD2 AS HRV_S,
         60000.0::DOUBLE / NULLIF(HRV_MeanNN, 0) AS PPG_Rate_Mean
  FROM tf)"""

_TIME = f"{_CHUNKS},\n{TIME_FROM_INTERVALS}"

_FEATS = list(hrv.TIME_FEATURES) + list(hrv.NONLINEAR_FEATURES)

ORACLES = {
    "run_starts": f"WITH {_STARTS} SELECT user_id, event_id, ts FROM s WHERE is_start",
    "last_segment": f"""WITH {_STARTS},
      ranked AS (SELECT user_id, ts, event_id,
                        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
                 FROM s WHERE is_start),
      b AS (SELECT user_id,
                   MAX(CASE WHEN k = 1 THEN ts END) AS last_ts, MAX(CASE WHEN k = 1 THEN event_id END) AS last_id,
                   MAX(CASE WHEN k = 2 THEN ts END) AS sec_ts, MAX(CASE WHEN k = 2 THEN event_id END) AS sec_id
            FROM ranked GROUP BY user_id HAVING COUNT(*) >= 2)
      SELECT s.user_id, s.event_id, s.ts, s.event_type, s.value
      FROM s JOIN b USING (user_id)
      WHERE (s.ts, s.event_id) >= (b.sec_ts, b.sec_id) AND (s.ts, s.event_id) <= (b.last_ts, b.last_id)""",
    "fixed_chunks": f"""
      SELECT event_id, user_id, row_no, (row_no - 1) // {CHUNK} AS chunk_id
      FROM (SELECT event_id, user_id, row_number() OVER ({_W}) AS row_no FROM events)""",
    "beat_intervals": f"""
      WITH r AS (SELECT event_id, user_id, ts,
                        (epoch_us(ts) - lag(epoch_us(ts)) OVER ({_W})) // 1000 AS rr_ms FROM events)
      SELECT event_id, user_id, rr_ms, rr_ms - lag(rr_ms) OVER ({_W}) AS rr_diff FROM r""",
    "hrv_time": f"""WITH {_TIME}
      SELECT user_id, chunk_id, n_rr, {", ".join(f"{_r4(f)} AS {f}" for f in hrv.TIME_FEATURES)} FROM tn""",
    "hrv_nonlinear": f"""WITH {_TIME}
      SELECT user_id, chunk_id, {", ".join(f"{_r4(f)} AS {f}" for f in hrv.NONLINEAR_FEATURES[:3])},
             round_even(HRV_S / 1e6, 0) AS HRV_S_s2 FROM tn""",
    "hrv_hist": f"""WITH {_CHUNKS},
      b AS (SELECT user_id, chunk_id, floor(rr / 7.8125::DOUBLE) AS bin, COUNT(*) AS n
            FROM rd WHERE rr IS NOT NULL GROUP BY 1, 2, 3)
      SELECT user_id, chunk_id, SUM(n)::BIGINT AS n_rr, MAX(n) AS max_bin_count,
             {_r4('SUM(n)::DOUBLE / MAX(n)')} AS HRV_HTI
      FROM b GROUP BY user_id, chunk_id""",
    "minmax_mean": f"""WITH {_TIME}
      SELECT user_id, COUNT(*) AS n_chunks,
        {", ".join(f"{_r4(f'(AVG({f}) - MIN({f})) / NULLIF(MAX({f}) - MIN({f}), 0)')} AS {f}" for f in _FEATS)},
        {_r4('AVG(PPG_Rate_Mean)')} AS Heart_Rate
      FROM tn GROUP BY user_id""",
}
