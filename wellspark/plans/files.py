"""Sources and sinks bound to the driver tables: a given table is written to the shared folder in the format of a source
and read again by its reader (S1-S9), or written by a sink and read back (S10-S12).

Stand-ins: 40 participants share the users of ``events`` (``par_0`` to ``par_39``); a participant's day in ``events`` is a
night and a day of activity; customers are study participants; line items are foods.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspark.functions.numeric import round2
from wellspark.operators import nutrition as nu
from wellspark.plans.nutrition import FOODS_SQL, foods_of
from wellspark.session import scratch_path
from wellspark.sources import readers, schemas, sinks
from wellspark.sources.tables import table

PARTICIPANTS = 40


def _folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"files/{name}-{uuid.uuid4().hex[:12]}")


def _participant():
    return F.concat(F.lit("par_"), F.col("user_id") % PARTICIPANTS)


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(_participant().alias("participant"), F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.min("value").alias("low"))


def files_sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 with a column that is not kept."""
    root, d = _folder(spark, "sleep"), _days(spark, sf_dir)
    seconds = {c: F.col("n") * (60 * (i + 1)) + i for i, c in enumerate(schemas.SLEEP_RAW[1:8])}
    plain = {c: round2(F.col("top") / (i + 2)) for i, c in enumerate(schemas.SLEEP_RAW[8:])}
    rows = d.select("participant", F.col("day").cast("string").alias("date"),
                    *[e.cast("double").alias(c) for c, e in (seconds | plain).items()], F.lit(1).alias("score"))
    sinks.write_device_tree(rows, root, schemas.SLEEP_DEVICE, schemas.SLEEP_FILE, "participant")
    return readers.read_daily_sleep(spark, root)


def files_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2; a day's lowest value below 1 is missing (NA)."""
    root, d = _folder(spark, "activity"), _days(spark, sf_dir)
    rows = d.select("participant", F.col("day").cast("string").alias("date"),
                    *[F.when(F.col("low") >= 1, round2(F.col("low") * (i + 1)).cast("string")).otherwise(schemas.MISSING)
                      .alias(c) for i, c in enumerate(schemas.ACTIVITY_RAW[1:])])
    sinks.write_device_tree(rows, root, schemas.ACTIVITY_DEVICE, schemas.ACTIVITY_FILE, "participant")
    return readers.read_daily_activity(spark, root)


def files_ppg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, with the place of each sample in its participant's file."""
    root = _folder(spark, "ppg")
    ev = table(spark, sf_dir, "events").select(
        _participant().alias("participant"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        round2("value").alias("ppg"), (F.col("event_id") % 90).cast("double").alias("hr"), (-F.col("event_id")).alias("latest"))
    sinks.write_device_tree(ev, root, schemas.PPG_DEVICE, schemas.PPG_FILE, "participant", order=["latest"])
    w = Window.partitionBy("user_id").orderBy("sample_no")  # bounded: one participant's file
    read = readers.read_ppg(spark, root).withColumn("place", F.row_number().over(w).cast("long"))
    return read.withColumn("date", F.col("date").cast("timestamp_ntz")).drop("sample_no")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("A4F_"), F.col("c_custkey")).alias("id"), F.col("c_mktsegment").alias("group"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("sex"),
        round2(F.col("c_acctbal") / 100).cast("string").alias("usual_weight_kg"),
        F.when(F.col("c_nationkey") == 3, schemas.MISSING).otherwise(F.col("c_nationkey").cast("string"))
        .alias("weight_5years_kg"),
        F.when(F.col("c_nationkey") == 5, "").otherwise(F.lit("170")).alias("height_cm"),
        F.lit("1500").alias("intervention_diet_kcal"), F.lit("yes, all").alias("finished_intervention"))


def files_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4."""
    path = _folder(spark, "participants")
    sinks.append_csv(_customers(spark, sf_dir), path)
    return readers.read_participants(spark, path)


def files_sleep_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per participant, the id from its name."""
    folder, d = _folder(spark, "sleep-sets"), _days(spark, sf_dir)
    name = F.concat(F.col("participant"), F.lit(f"{schemas.SLEEP_DATASET_SUFFIX}.csv"))
    rows = d.select(F.concat_ws("-", "participant", "day").alias("sleep_id"), F.col("day").alias("start_time"),
                    F.col("n").alias("n_stages"), name.alias("file"))
    rows.repartition("file").write.partitionBy("file").option("header", "true").csv(folder)
    return readers.read_sleep_datasets(spark, folder)


def files_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any table as strings; quotes and commas inside values, missing values."""
    path = _folder(spark, "dataset")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit('a "'), "p_name", F.lit('", of '), "p_brand").alias("label"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("p_type"))
    sinks.append_csv(p, path)
    return readers.read_string_table(spark, path)


DOCS_PER_FILE = 250_000  # compressed text is read by one task a file


def files_nutrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per order line group of at most eight foods, folded again.

    The lines meet as the table has them, before the wider foods are derived, and the documents, mostly field names, are
    written compressed in files of a bounded number of them."""
    path = _folder(spark, "nutrition")
    piece = F.floor(F.col("l_linenumber") / 8)
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    f = foods_of(lines.repartition("l_orderkey", piece)).drop("l_shipdate")
    values = [c for c in f.columns if c.startswith("nf_")]
    docs = f.groupBy("l_orderkey", piece.alias("piece")).agg(
        F.collect_list(F.struct(F.concat(F.lit("order "), "l_orderkey").alias("food_name"), *values)).alias("foods"))
    docs.select("foods").write.option("maxRecordsPerFile", DOCS_PER_FILE).json(path, compression="gzip")
    read = nu.nested_totals(readers.read_nutrition_docs(spark, path))
    per_log = read.groupBy(F.col("foods")[0]["food_name"].alias("log")).agg(
        F.sum(F.size("foods")).cast("long").alias("n_foods"), *[F.sum(n).alias(n) for n in nu.NUTRIENT_FIELDS])
    return per_log.select("log", "n_foods", *[round2(n).alias(n) for n in nu.NUTRIENT_FIELDS])


def files_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all messages, with their number."""
    path = _folder(spark, "lines")
    table(spark, sf_dir, "conversations").select(F.coalesce("text", F.lit(""))).write.text(path)
    return readers.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def files_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per nation and its data URL (the content plays an image)."""
    path = _folder(spark, "images")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    read = readers.read_images_as_data_urls(spark, f"{path}/n_nationkey=*")
    key = F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int")
    return read.select(key.alias("n_nationkey"), "data_url")


def files_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON records, dates as epoch milliseconds, read back as text."""
    path = _folder(spark, "records")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    sinks.write_json_lines(sinks.records_json(o, date_cols=("o_orderdate",)), path)
    return readers.read_lines(spark, path).select(F.col("value").alias("json"))


def files_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object of features per customer, read back."""
    path = _folder(spark, "columns")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_nationkey") != 7, F.col("c_mktsegment")).alias("c_mktsegment"))
    sinks.write_json_lines(sinks.columns_json(c, c.columns), path)
    return readers.read_lines(spark, path).select(F.col("value").alias("json"))


def files_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions appended to the nations in one CSV folder."""
    path = _folder(spark, "append")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    sinks.append_csv(nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), path)
    sinks.append_csv(region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), path)
    return readers.read_string_table(spark, path)


QUERIES = {f.__name__: f for f in (
    files_sleep, files_activity, files_ppg, files_participants, files_sleep_sets, files_dataset, files_nutrition,
    files_lines, files_images, files_records, files_columns, files_append)}


def _r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


_DAYS = f"""d AS (SELECT concat('par_', user_id % {PARTICIPANTS}) AS user_id, CAST(ts AS DATE) AS date, COUNT(*) AS n,
    MAX(value) AS top, MIN(value) AS low FROM events GROUP BY 1, 2)"""
_SLEEP = ", ".join(
    [f"{_r2(f'(n * {60 * (i + 1)} + {i}) / 60.0::DOUBLE')} AS {c}" for i, c in enumerate(schemas.SLEEP_NAMES[1:8])]
    + [f"{_r2(_r2(f'top / {i + 2}'))} AS {c}" for i, c in enumerate(schemas.SLEEP_NAMES[8:])])
_ACTIVITY = ", ".join(f"CASE WHEN low >= 1 THEN {_r2(f'low * {i + 1}')} END AS {c}"
                      for i, c in enumerate(schemas.ACTIVITY_NAMES[1:]))

ORACLES = {
    "files_sleep": f"WITH {_DAYS} SELECT user_id, 'oura' AS device, date, {_SLEEP} FROM d",
    "files_activity": f"WITH {_DAYS} SELECT user_id, 'oura' AS device, date, {_ACTIVITY} FROM d",
    "files_ppg": f"""
      SELECT concat('par_', user_id % {PARTICIPANTS}) AS user_id, 'samsung' AS device, date_trunc('millisecond', ts) AS date,
        {_r2('value')} AS ppg, CAST(event_id % 90 AS DOUBLE) AS hr,
        row_number() OVER (PARTITION BY user_id % {PARTICIPANTS} ORDER BY event_id DESC) AS place
      FROM events""",
    "files_participants": f"""
      WITH c AS (SELECT concat('A4F_', c_custkey) AS id, c_mktsegment AS "group",
          CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
          {_r2('c_acctbal / 100')} AS usual_weight_kg_num,
          CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS DOUBLE) END AS weight_5years_kg_num,
          CASE WHEN c_nationkey <> 5 THEN 170.0::DOUBLE END AS height_cm_num,
          1500.0::DOUBLE AS intervention_diet_kcal_num, 'yes, all' AS finished_intervention FROM customer)
      SELECT *, CAST(usual_weight_kg_num AS VARCHAR) AS usual_weight_kg,
        CAST(CAST(weight_5years_kg_num AS INTEGER) AS VARCHAR) AS weight_5years_kg,
        CAST(CAST(height_cm_num AS INTEGER) AS VARCHAR) AS height_cm, '1500' AS intervention_diet_kcal FROM c""",
    "files_sleep_sets": f"""WITH {_DAYS}
      SELECT concat(user_id, '-', CAST(date AS VARCHAR)) AS sleep_id, CAST(date AS VARCHAR) AS start_time,
        CAST(n AS VARCHAR) AS n_stages, user_id AS id FROM d""",
    "files_dataset": """
      SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, concat('a "', p_name, '", of ', p_brand) AS label,
        CASE WHEN p_size > 25 THEN p_type END AS p_type FROM part""",
    "files_nutrition": f"""WITH {FOODS_SQL}
      SELECT concat('order ', l_orderkey) AS log, COUNT(*) AS n_foods,
        {", ".join(f"{_r2(f'SUM(COALESCE({fl}, 0.0))')} AS {n}" for n, fl in nu.NUTRIENT_FIELDS.items())}
      FROM foods GROUP BY 1""",
    "files_lines": """
      SELECT line, COUNT(*) AS n FROM (
        SELECT unnest(CASE WHEN t = '' THEN [''] WHEN t LIKE '%' || chr(10) THEN string_split(t, chr(10))
                           ELSE string_split(t, chr(10)) END) AS line
        FROM (SELECT COALESCE(text, '') AS t FROM conversations)) GROUP BY 1""",
    "files_images": """
      SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey,
        concat('data:image/jpeg;base64,', base64(encode(n_name || chr(10)))) AS data_url FROM nation""",
    "files_records": """
      SELECT concat('{"o_orderkey":', o_orderkey, ',"o_orderdate":', epoch_ms(o_orderdate), ',"o_orderstatus":"',
        o_orderstatus, '"}') AS json FROM orders""",
    "files_columns": """
      SELECT concat('{"c_custkey":', c_custkey, ',"c_nationkey":', c_nationkey, ',"c_mktsegment":',
        CASE WHEN c_nationkey <> 7 THEN '"' || c_mktsegment || '"' ELSE 'null' END, '}') AS json FROM customer""",
    "files_append": """
      SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation
      UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region""",
}
