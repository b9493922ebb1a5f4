"""Selection, lookup, join and summary operators bound to the driver tables.

Stand-ins (SURVEY §7.5): ``events`` is the sample table (user_id = participant, ts = sample time, value = the
measure); ``orders``/``customer``/``nation`` are measurements and participant attributes.
Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.numeric import round_half_even
from wellspark.operators import lookup as lk
from wellspark.operators import selecting as sel
from wellspark.operators import trends as tr
from wellspark.sources.tables import table

RANGE_START, RANGE_END = "2024-01-05", "2024-01-12"
SINGLE_DAY = "1997-08-23"


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples pre-aggregated to the daily grain: one row per user and day (map-side combined)."""
    ev = table(spark, sf_dir, "events")
    return tr.daily_rollup(
        ev,
        ["user_id"],
        "ts",
        {"n_events": F.count(F.lit(1)), "total_value": F.sum("value")},
    )


def range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    out = sel.select_range(ev, "ts", RANGE_START, RANGE_END, cols=["event_id", "user_id", "ts", "value"])
    out = sel.rename_positional(out, ["event_id", "user_id", "sample_time", "value"])
    return sel.round_columns(out, ["value"], 2)


def single_day_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return sel.select_day(o, "o_orderdate", SINGLE_DAY).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )


def _lookup(spark: SparkSession, sf_dir: str):
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    # requested ids arrive as text with stray whitespace (the reference strips each argument)
    req = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit("\t")).alias("requested")
    )
    return lk.lookup(cust, "c_custkey", req, "requested", order_col="c_custkey")


def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _lookup(spark, sf_dir)
    return found.select("request_id", "c_custkey", "c_name", "c_acctbal")


def id_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, missing = _lookup(spark, sf_dir)
    return missing


def profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"
    )
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    with_c = lk.attach_attributes(o, c, ["o_custkey"])
    with_n = lk.attach_attributes(with_c, n, ["c_nationkey"])
    return with_n.select("o_orderkey", "o_custkey", "c_name", "n_name", "o_totalprice")


def measure_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_events(spark, sf_dir)
    return tr.summarise(d, ["user_id"], "average", measures=["n_events", "total_value"], digits=4).select(
        "user_id", F.col("n_events").alias("avg_n_events"), F.col("total_value").alias("avg_total_value")
    )


def measure_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_events(spark, sf_dir)
    out = tr.summarise(d, ["user_id"], "sum", measures=["n_events", "total_value"])
    return out.select(
        "user_id",
        F.col("n_events").cast("long").alias("sum_n_events"),
        round_half_even("total_value", 2).alias("sum_total_value"),
    )


def measure_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_events(spark, sf_dir)
    return tr.summarise(d, ["user_id"], "trend", measures=["n_events", "total_value"], digits=4).select(
        "user_id", F.col("n_events").alias("trend_n_events"), F.col("total_value").alias("trend_total_value")
    )


def measure_trend_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_events(spark, sf_dir)
    out = tr.trend_line(d, ["user_id"], "date", "total_value")
    return out.select(
        "user_id",
        F.col("date").alias("day"),
        round_half_even("total_value", 2).alias("total_value"),
        round_half_even("slope", 4).alias("slope"),
        round_half_even("intercept", 4).alias("intercept"),
        round_half_even("fitted", 4).alias("fitted"),
    )


def measure_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    out = tr.calendar_summary(o, ["o_custkey"], "o_orderdate", "month", ["o_totalprice"], hows=("sum", "average"))
    return out.select(
        "o_custkey",
        F.col("period").alias("month"),
        F.col("n_rows").alias("n_orders"),
        round_half_even("sum_o_totalprice", 2).alias("sum_totalprice"),
        round_half_even("average_o_totalprice", 4).alias("avg_totalprice"),
    )


def measure_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 with per-customer and grand totals (``rollup``), e.g. a yearly figure next to the monthly ones."""
    o = table(spark, sf_dir, "orders")
    out = tr.calendar_summary(o, ["o_custkey"], "o_orderdate", "year", ["o_totalprice"], hows=("sum",), rollup=True)
    return out.select(
        "o_custkey",
        F.col("period").alias("year"),
        F.col("n_rows").alias("n_orders"),
        round_half_even("sum_o_totalprice", 2).alias("sum_totalprice"),
    )


def seconds_to_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    out = sel.seconds_to_minutes(ev, ["value", "not_a_column"])
    return sel.round_columns(out, ["value"], 2).withColumnRenamed("value", "value_minutes")


QUERIES = {
    "range_select": range_select,
    "single_day_select": single_day_select,
    "id_lookup": id_lookup,
    "id_missing": id_missing,
    "profile_join": profile_join,
    "measure_average": measure_average,
    "measure_sum": measure_sum,
    "measure_trend": measure_trend,
    "measure_trend_line": measure_trend_line,
    "measure_monthly": measure_monthly,
    "measure_rollup": measure_rollup,
    "seconds_to_minutes": seconds_to_minutes,
}

_DAILY = """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n_events, SUM(value) AS total_value
                   FROM events GROUP BY 1, 2)"""

ORACLES = {
    "range_select": f"""
        SELECT event_id, user_id, ts AS sample_time, round_even(value * 100, 0) / 100 AS value
        FROM events
        WHERE ts >= TIMESTAMP '{RANGE_START}' AND ts <= TIMESTAMP '{RANGE_END}' + INTERVAL 1 DAY""",
    "single_day_select": f"""
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
        WHERE o_orderdate = TIMESTAMP '{SINGLE_DAY}'""",
    "id_lookup": """
        WITH r AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS request_id FROM lineitem)
        SELECT r.request_id, c.c_custkey, c.c_name, c.c_acctbal
        FROM r JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = r.request_id""",
    "id_missing": """
        WITH r AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS request_id FROM lineitem)
        SELECT request_id FROM r
        WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE CAST(c.c_custkey AS VARCHAR) = r.request_id)""",
    "profile_join": """
        SELECT o.o_orderkey, o.o_custkey, c.c_name, n.n_name, o.o_totalprice
        FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
        LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "measure_average": f"""{_DAILY}
        SELECT user_id, round_even(AVG(n_events) * 10000, 0) / 10000 AS avg_n_events,
               round_even(AVG(total_value) * 10000, 0) / 10000 AS avg_total_value
        FROM d GROUP BY user_id""",
    "measure_sum": f"""{_DAILY}
        SELECT user_id, CAST(SUM(n_events) AS BIGINT) AS sum_n_events,
               round_even(SUM(total_value) * 100, 0) / 100 AS sum_total_value
        FROM d GROUP BY user_id""",
    "measure_trend": f"""{_DAILY},
        x AS (SELECT *, CAST(day - MIN(day) OVER (PARTITION BY user_id) AS DOUBLE) AS x FROM d)
        SELECT user_id,
               round_even(regr_slope(n_events, x) * 10000, 0) / 10000 AS trend_n_events,
               round_even(regr_slope(total_value, x) * 10000, 0) / 10000 AS trend_total_value
        FROM x GROUP BY user_id""",
    "measure_trend_line": f"""{_DAILY},
        x AS (SELECT *, CAST(day - MIN(day) OVER (PARTITION BY user_id) AS DOUBLE) AS x FROM d),
        f AS (SELECT user_id, regr_slope(total_value, x) AS slope, regr_intercept(total_value, x) AS intercept
              FROM x GROUP BY user_id)
        SELECT x.user_id, x.day, round_even(x.total_value * 100, 0) / 100 AS total_value,
               round_even(f.slope * 10000, 0) / 10000 AS slope,
               round_even(f.intercept * 10000, 0) / 10000 AS intercept,
               round_even((f.intercept + f.slope * x.x) * 10000, 0) / 10000 AS fitted
        FROM x JOIN f USING (user_id)""",
    "measure_monthly": """
        SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n_orders,
               round_even(SUM(o_totalprice) * 100, 0) / 100 AS sum_totalprice,
               round_even(AVG(o_totalprice) * 10000, 0) / 10000 AS avg_totalprice
        FROM orders GROUP BY 1, 2""",
    "measure_rollup": """
        SELECT o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS year, COUNT(*) AS n_orders,
               round_even(SUM(o_totalprice) * 100, 0) / 100 AS sum_totalprice
        FROM orders GROUP BY ROLLUP (o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE))""",
    "seconds_to_minutes": """
        SELECT event_id, round_even(value / 60 * 100, 0) / 100 AS value_minutes FROM events""",
}
