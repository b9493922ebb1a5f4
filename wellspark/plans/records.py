"""Selections and small record rules bound to the driver tables: text dates, key selection, empty columns, requested
keys, file names, sleep efficiency, BMI, the PSS slot, routes with uploads, evidence per run and reply shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.numeric import round_half_even
from wellspark.functions.text import file_name
from wellspark.operators import derived as dv, hrv, selecting as sel, text as to, transcripts as tr
from wellspark.plans import ppg_chain, text as text_plans, transcripts
from wellspark.sources.tables import table

SEGMENTS = ("AUTOMOBILE", "MACHINERY")


def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ship date as text and the event time as epoch milliseconds, read back."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day_text"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"))
    return ev.select("event_id", sel.parse_day("day_text").alias("day"),
                     sel.parse_epoch_ms("epoch_ms").cast("timestamp_ntz").alias("ts_ms"))


def key_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the chosen keys."""
    return sel.select_keys(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS)


def measure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The averages of every measure, found by dropping the date columns."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", F.col("l_shipdate").alias("shipDate"))
    names = sel.measure_columns(li, exclude=["l_orderkey"])
    return li.groupBy("l_orderkey").agg(*[round_half_even(F.avg(c), 4).alias(f"avg_{c}") for c in names])


def filled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is NULL in every row goes, one that is NULL in some stays."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("large_price"),
        F.when(F.col("o_totalprice") < 0, F.col("o_totalprice")).alias("negative_price"))
    return sel.drop_all_null_columns(o)


def requested_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, with whether the selection of large orders has rows for them."""
    wanted = table(spark, sf_dir, "customer").select("c_custkey")
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_large"))
    return sel.with_requested_keys(wanted, large, ["c_custkey"])


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last path component of the pages' addresses."""
    return table(spark, sf_dir, "pages").select("page_id", file_name("url").alias("file_name"))


def sleep_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity plays the time asleep, quantity and line number the time in bed (none for the seventh line)."""
    q, line = F.col("l_quantity"), F.col("l_linenumber")
    in_bed = F.when(line == 7, F.lit(0.0)).otherwise(q + line)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", round_half_even(dv.sleep_efficiency(q, in_bed), 4).alias("efficiency"))


def body_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part size plays the weight, retail price the height."""
    part = table(spark, sf_dir, "part")
    height = F.when(F.col("p_size") != 1, F.col("p_retailprice") / F.lit(10.0)).otherwise(F.lit(0.0))
    return part.select("p_partkey", round_half_even(dv.bmi(F.col("p_size") + F.lit(40.0), height), 4).alias("bmi"))


def pss_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LF takes the PSS slot; the strict form keeps the value that is there."""
    f = ppg_chain.hrv_freq(spark, sf_dir).select("user_id", "chunk_id", "HRV_LF", F.col("HRV_HF").alias("HRV_PSS"))
    strict = hrv.overwrite_pss(f, strict_pss=True).select("user_id", "chunk_id", F.col("HRV_PSS").alias("pss_strict"))
    return hrv.overwrite_pss(f).join(strict, ["user_id", "chunk_id"])


def upload_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 with uploads: a text without an address takes the session's uploaded image, where there is one."""
    refs = text_plans.image_refs(spark, sf_dir)
    up = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/data/"), F.col("doc_id").cast("string"), F.lit(".png")))
    return to.with_upload(refs.withColumn("uploaded_path", up)).select("doc_id", "route", "image")


def run_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 per run: the evidence of a user's actions of a day in their order, as one text."""
    actions, results, refs = transcripts.action_log(spark, sf_dir)
    e = tr.evidence(actions, results, refs, ["run_id"])
    return tr.evidence_per_run(e, ["run_id", "user_id"], "event_id")


def reply_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of every run and the share of malformed ones."""
    return tr.malformed_share(transcripts.parsed_replies(spark, sf_dir), ["conv_id"])


QUERIES = {f.__name__: f for f in (
    parsed_dates, key_select, measure_names, filled_columns, requested_keys, file_names, sleep_efficiency, body_mass,
    pss_slot, upload_routes, run_evidence, reply_shares)}


def _r4(x: str) -> str:
    return f"round_even(({x}) * 10000, 0) / 10000"


ORACLES = {
    "parsed_dates": """
      SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('milliseconds', ts) AS ts_ms FROM events""",
    "key_select": f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN {SEGMENTS}",
    "measure_names": f"""
      SELECT l_orderkey, {_r4('AVG(l_quantity)')} AS avg_l_quantity, {_r4('AVG(l_discount)')} AS avg_l_discount
      FROM lineitem GROUP BY l_orderkey""",
    "filled_columns": """
      SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS large_price FROM orders""",
    "requested_keys": """
      SELECT c_custkey, n_large, n_large IS NOT NULL AS has_data FROM customer LEFT JOIN (
        SELECT o_custkey, COUNT(*) AS n_large FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = o_custkey""",
    "file_names": "SELECT page_id, string_split(url, '/')[-1] AS file_name FROM pages",
    "sleep_efficiency": f"""
      SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN
        {_r4('100.0::DOUBLE * l_quantity / (l_quantity + l_linenumber)')} END AS efficiency FROM lineitem""",
    "body_mass": f"""
      SELECT p_partkey, CASE WHEN p_size <> 1 THEN
        {_r4('(p_size + 40.0::DOUBLE) / power(p_retailprice / 10.0::DOUBLE / 100.0::DOUBLE, 2)')} END AS bmi FROM part""",
    "pss_slot": f"""
      SELECT user_id, chunk_id, HRV_LF, HRV_LF AS HRV_PSS, HRV_HF AS pss_strict
      FROM ({ppg_chain.ORACLES['hrv_freq']})""",
    "upload_routes": f"""
      SELECT doc_id, CASE WHEN route = 'text' AND doc_id % 3 = 0 THEN 'uploaded' ELSE route END AS route,
        CASE route WHEN 'url' THEN url WHEN 'local_path' THEN local_path
             ELSE CASE WHEN doc_id % 3 = 0 THEN '/data/' || doc_id || '.png' END END AS image
      FROM ({text_plans.ORACLES['image_refs']})""",
    "run_evidence": f"""
      SELECT CAST(ts AS DATE) AS run_id, user_id, COUNT(*) AS n_actions, string_agg(evidence, '' ORDER BY event_id) AS evidence
      FROM ({transcripts.ORACLES['evidence']}) JOIN events USING (event_id) GROUP BY 1, 2""",
    "reply_shares": f"""
      SELECT conv_id, COUNT(*) AS n_replies, COUNT(*) FILTER (WHERE parse_status <> 'ok') AS n_malformed,
             (COUNT(*) FILTER (WHERE parse_status <> 'ok'))::DOUBLE / COUNT(*) AS malformed_share
      FROM ({transcripts.ORACLES['reply_tags']}) GROUP BY conv_id""",
}
