"""Streaming jobs bound to the driver tables: the tables are replayed as file streams (``readStream.parquet``,
``trigger(availableNow)``) and the final results are read back as batch tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.numeric import round_half_even
from wellspark.operators import nutrition as nu
from wellspark.plans.nutrition import FOODS_SQL, RISKS_SQL, SHARES_SQL, foods_of
from wellspark.sources.tables import table
from wellspark.streaming import jobs
from wellspark.streaming.zero_runs import zero_run_sessions


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    # a glob over the table's file(s): new files matching it are picked up as they land (ST1)
    return spark.readStream.schema(schema).option("basePath", sf_dir).parquet(os.path.join(sf_dir, f"{name}.parquet*"))


def _windows(spark: SparkSession, sf_dir: str, width: str, name: str) -> DataFrame:
    ev = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    agg = jobs.windowed_stats(ev, ["user_id"], "ts", "value", width=width)
    out = jobs.run_to_table(spark, agg, name, group_keys=["user_id", "window_start"])
    return out.select(
        "user_id",
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("n").cast("long").alias("n_events"),
        round_half_even("sum_value", 2).alias("sum_value"),
        "min_value",
        "max_value",
        round_half_even("mean_value", 2).alias("mean_value"),
        *[round_half_even(c, 4).alias(c) for c in ("mean_interval_ms", *RR_METRICS)],
    )


RR_METRICS = ("sdnn_ms", "rmssd_ms", "pnn50")


def stream_window_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "60 seconds", "window60")


def stream_window_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job in windows of a day, which hold several events of a user."""
    return _windows(spark, sf_dir, "1 day", "window1d")


def stream_daily_nutrients(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _stream(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    # stream-static join of the lines as they come (the foods derived from them are twice as wide)
    joined = foods_of(li.join(orders, "l_orderkey"), "o_custkey")
    measures = {n: F.coalesce(F.col(c), F.lit(0.0)) for n, c in nu.NUTRIENT_FIELDS.items()}
    agg = jobs.daily_totals(joined, ["o_custkey"], "l_shipdate", measures | {"n_foods": F.lit(1)})
    out = jobs.run_to_table(spark, agg, "daily_nutrients", group_keys=["o_custkey", "day_start"], evict_at_end=False)
    out = out.withColumns({c: round_half_even(c, 2) for c in nu.NUTRIENT_FIELDS})
    return nu.risk_rules(out).select(
        "o_custkey", F.to_date(F.col("day_start")).alias("day"), F.col("n_foods").cast("long").alias("n_foods"),
        *nu.NUTRIENT_FIELDS, *nu.RISK_COLUMNS)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.run_closed(
        spark, ev, "ts", lambda s: jobs.sessions(s, [jobs.MARK, "user_id"], "ts", gap="30 minutes"), "sessions")
    return out.select(
        "user_id",
        F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"),
        F.col("n").cast("long").alias("n_events"),
    )


def stream_zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from one run of 'error' events to the next, by keyed state and event-time timers."""
    ev = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    zero = F.col("event_type") == "error"
    out = jobs.run_closed(
        spark, ev, "ts",
        lambda s: zero_run_sessions(s, [jobs.MARK, "user_id"], "ts", "event_id", zero, "value"), "zero-runs")
    return out.select(
        "user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("start_tie").alias("start_event"), F.col("session_end").cast("timestamp_ntz").alias("session_end"),
        F.col("end_tie").alias("end_event"), F.col("n").alias("n_events"),
        round_half_even("total", 2).alias("sum_value"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered twice (two replays of the same files) -> one row per event after dedup."""
    a = _stream(spark, sf_dir, "events")
    b = _stream(spark, sf_dir, "events")
    both = a.unionByName(b).withColumn("ts", F.col("ts").cast("timestamp"))
    d = jobs.dedup(both, ["event_id"], "ts")
    out = jobs.run_to_table(spark, d.select("event_id", "user_id", "ts"), "dedup")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))


QUERIES = {
    "stream_window_60s": stream_window_60s,
    "stream_window_day": stream_window_day,
    "stream_daily_nutrients": stream_daily_nutrients,
    "stream_sessions": stream_sessions,
    "stream_zero_runs": stream_zero_runs,
    "stream_dedup": stream_dedup,
}

def _r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def _r4(x: str) -> str:
    return f"round_even(({x}) * 10000, 0) / 10000"


def _windows_sql(unit: str) -> str:
    w = "PARTITION BY user_id, window_start ORDER BY ts, event_id"
    return f"""
      WITH e AS (SELECT *, date_trunc('{unit}', ts) AS window_start FROM events),
      i AS (SELECT *, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER ({w})) / 1000)::DOUBLE AS rr FROM e),
      d AS (SELECT *, rr - lag(rr) OVER ({w}) AS d FROM i)
      SELECT user_id, window_start, COUNT(*) AS n_events,
             {_r2("SUM(value)")} AS sum_value, MIN(value) AS min_value, MAX(value) AS max_value,
             {_r2("AVG(value)")} AS mean_value,
             {_r4("(epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1000.0::DOUBLE / NULLIF(COUNT(*) - 1, 0)")}
               AS mean_interval_ms,
             {_r4("stddev_samp(rr)")} AS sdnn_ms,
             {_r4("CASE WHEN COUNT(rr) > 1 THEN sqrt(AVG(d * d)) END")} AS rmssd_ms,
             {_r4("100.0::DOUBLE * COUNT(*) FILTER (WHERE abs(d) > 50) / NULLIF(COUNT(rr), 0)")} AS pnn50
      FROM d GROUP BY 1, 2"""


ORACLES = {
    "stream_daily_nutrients": f"""
      WITH {FOODS_SQL},
      totals AS (
        SELECT o.o_custkey, CAST(f.l_shipdate AS DATE) AS day, COUNT(*) AS n_foods,
          {", ".join(f"{_r2(f'SUM(COALESCE({fl}, 0.0))')} AS {n}" for n, fl in nu.NUTRIENT_FIELDS.items())}
        FROM foods f JOIN orders o ON f.l_orderkey = o.o_orderkey
        GROUP BY 1, 2), {SHARES_SQL}
      SELECT o_custkey, day, n_foods, {", ".join(nu.NUTRIENT_FIELDS)}, {RISKS_SQL} FROM shares""",
    "stream_window_60s": _windows_sql("minute"),
    "stream_window_day": _windows_sql("day"),
    "stream_zero_runs": """
      WITH m AS (SELECT *, event_type = 'error' AS z, row_number() OVER w AS rn,
                   event_type = 'error' AND COALESCE(lag(event_type) OVER w <> 'error', TRUE) AS is_start
                 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
           s AS (SELECT user_id, ts, event_id, rn, lead(ts) OVER w AS end_ts, lead(event_id) OVER w AS end_event,
                   lead(rn) OVER w AS end_rn
                 FROM m WHERE is_start WINDOW w AS (PARTITION BY user_id ORDER BY rn))
      SELECT s.user_id, s.ts AS session_start, s.event_id AS start_event, any_value(s.end_ts) AS session_end,
             any_value(s.end_event) AS end_event, COUNT(*) AS n_events,
             round_even(SUM(m.value) * 100, 0) / 100 AS sum_value
      FROM s JOIN m ON m.user_id = s.user_id AND m.rn BETWEEN s.rn AND s.end_rn
      WHERE s.end_rn IS NOT NULL GROUP BY 1, 2, 3""",
    "stream_sessions": """
      WITH g AS (SELECT user_id, ts,
                   CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                          OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                        THEN 1 ELSE 0 END AS brk
                 FROM events),
           s AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
      SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS n_events
      FROM s GROUP BY user_id, sid""",
    "stream_dedup": "SELECT user_id, COUNT(*) AS n_events FROM events GROUP BY user_id",
}
