"""Documented derivations (D3-D7, W9), message splitting (F7), latest upload (W8), summary (A18) and the
auto-encoder reconstruction (M4) bound to the driver tables.

Stand-ins: ``events.value`` is a heart rate (W9, D5: zone by value) or, times 4, a glucose reading in mg/dL (D4);
event types map to activity intensities (D3) and sleep stages (D6); order status plays the visit (D7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.numeric import round_half_even
from wellspark.functions import text as tx
from wellspark.operators import derived as dv
from wellspark.operators import scoring as sc
from wellspark.operators import text as to
from wellspark.plans.scoring import ENCODER, WINDOWS_SQL, windows
from wellspark.plans.text import attachment_message
from wellspark.sources.tables import table

DECODER_SEED = 3
DECODER = sc.seeded_layers(sc.DECODER_SIZES, DECODER_SEED)
INTENSITY = {"signup": "vigorous", "purchase": "moderate", "click": "walking"}
STAGE = {"view": "light", "click": "rem", "purchase": "deep", "signup": "awake", "error": "awake"}


def _ev(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


def _map(m: dict, c):
    return F.element_at(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))]), c)


def _r(df, cols, d=4):
    return df.withColumns({c: round_half_even(c, d) for c in cols})


def met_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    out = dv.met_minutes(ev, ["user_id"], F.col("ts"), _map(INTENSITY, F.col("event_type")), F.col("value"))
    # MET-minutes have at most 3 decimals (3.3 x 2-decimal minutes), so 4-decimal rounding is exact
    return _r(out, ["met_minutes"], 4).select(
        "user_id", "week", "met_minutes", F.col("vigorous_days").cast("long"), "activity_class"
    )


def glucose_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dv.glucose_summary(_ev(spark, sf_dir), ["user_id"], F.col("value") * F.lit(4.0))
    return _r(out, ["mean", "sd", "cv", "gmi", "share_below", "share_in_range", "share_above"]).withColumn(
        "n", F.col("n").cast("long")
    )


def _zone(v):
    return F.when(v < 10, "below 1").when(v < 20, "1").when(v < 35, "2").otherwise("3")


def hr_zone_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    out = dv.state_minutes(ev, ["user_id"], ["ts", "event_id"], "ts", _zone(F.col("value")),
                           F.to_date("ts"))
    return _r(out, ["minutes"]).select("user_id", F.col("period").alias("day"), F.col("state").alias("zone"),
                                       "minutes", F.col("n_samples").cast("long"))


def sleep_stage_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    night = F.to_date(F.col("ts") - F.expr("INTERVAL 12 HOURS"))
    out = dv.state_minutes(ev, ["user_id"], ["ts", "event_id"], "ts", _map(STAGE, F.col("event_type")), night)
    return _r(out, ["minutes"]).select("user_id", F.col("period").alias("night"), F.col("state").alias("stage"),
                                       "minutes", F.col("n_samples").cast("long"))


def visit_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    out = dv.visit_change(o, ["o_custkey"], "o_orderstatus", "o_totalprice", ["F", "O", "P"], "F", "P")
    return _r(out, ["F", "O", "P", "change"]).select(
        "o_custkey", F.col("F").alias("visit_f"), F.col("O").alias("visit_o"), F.col("P").alias("visit_p"), "change"
    )


def lowest_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    out = dv.lowest_sliding_mean(ev, ["user_id"], F.to_date("ts"), "ts", "value")
    return _r(out, ["lowest_5min_avg"])


def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages split into ordered text and attachment parts (absolute offsets, so every split is right)."""
    d = table(spark, sf_dir, "documents")
    msg = d.select("doc_id", attachment_message(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text")).alias("m"))
    return to.message_parts(msg, ["doc_id"], "m")


def latest_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, the most recent turn that mentions an image path (paths derived from each turn)."""
    c = table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("/uploads/c"), F.col("conv_id").cast("string"), F.lit("_t"), F.col("turn").cast("string"),
                    F.when(F.col("role") == "user", F.lit(".JPG")).otherwise(F.lit(".txt")))
    return to.latest_upload(c.withColumn("path", path), "conv_id", "turn", "path")


def describe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wellspark.operators.trends import describe_numeric

    out = describe_numeric(_ev(spark, sf_dir).select("value"), ["value"])
    return _r(out, ["value_mean", "value_sum"], 4)


def reconstruction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: decoder(encoder(x)) and the distance to x, per window of every embedding."""
    rec = sc.reconstruct(windows(spark, sf_dir), "x", ENCODER, DECODER, keep=["vec_id", "window_no", "x"])
    err = F.sqrt(F.aggregate(F.zip_with("x", "reconstruction", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                             lambda acc, v: acc + v))
    return rec.select("vec_id", "window_no", round_half_even(err, 6).alias("recon_error"))


QUERIES = {
    "met_weekly": met_weekly,
    "glucose_stats": glucose_stats,
    "hr_zone_minutes": hr_zone_minutes,
    "sleep_stage_minutes": sleep_stage_minutes,
    "visit_change": visit_change,
    "lowest_hr": lowest_hr,
    "message_parts": message_parts,
    "latest_upload": latest_upload,
    "describe_events": describe_events,
    "reconstruction_error": reconstruction_error,
}


def _r4(x):
    return f"round_even(({x}) * 10000, 0) / 10000"


def _case(m: dict, col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in m.items()) + " END"


def _state_sql(state: str, period: str, names: tuple[str, str]) -> str:
    return f"""
      WITH x AS (SELECT user_id, ts, {state} AS state, {period} AS period,
                   lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nts FROM events)
      SELECT user_id, period AS {names[0]}, state AS {names[1]},
             {_r4(f'SUM(COALESCE((epoch_us(nts) - epoch_us(ts)) / 1e6, 0)) / 60.0')} AS minutes,
             COUNT(*) AS n_samples
      FROM x GROUP BY 1, 2, 3"""


def _oracle_recon() -> str:
    keys = ["vec_id", "window_no", "x"]  # x goes through the chain beside the activations
    enc, enc_last = sc.layers_sql(WINDOWS_SQL, keys, "x", ENCODER, prefix="enc")
    dec, dec_last = sc.layers_sql(enc_last, keys, "h", DECODER, prefix="dec")
    return ("WITH " + ",\n".join(enc + dec) +
            f"\nSELECT vec_id, window_no, round_even(sqrt(list_sum(list_transform(list_zip(x, h), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) * 1e6, 0) / 1e6 AS recon_error FROM {dec_last}")


ORACLES = {
    "met_weekly": f"""
      WITH x AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(ts AS DATE) AS d,
                   COALESCE(CASE {" ".join(f"WHEN event_type = '{k}' THEN {dv.MET_WEIGHTS[v]}" for k, v in INTENSITY.items())} END, 0.0) * value AS met,
                   event_type = 'signup' AS vig
                 FROM events),
      a AS (SELECT user_id, week, SUM(met) AS m, COUNT(DISTINCT CASE WHEN vig THEN d END) AS vigorous_days
            FROM x GROUP BY 1, 2)
      SELECT user_id, week, round_even(m * 10000, 0) / 10000 AS met_minutes, vigorous_days,
             CASE WHEN m >= 3000 THEN 'active' WHEN m >= 1500 AND vigorous_days >= 3 THEN 'active'
                  WHEN m >= 600 THEN 'minimally active' ELSE 'inactive' END AS activity_class
      FROM a""",
    "glucose_stats": f"""
      WITH g AS (SELECT user_id, value * 4.0 AS g FROM events)
      SELECT user_id, COUNT(g) AS n, {_r4('AVG(g)')} AS mean, {_r4('stddev_samp(g)')} AS sd,
             {_r4('stddev_samp(g) / AVG(g)')} AS cv, {_r4('3.31 + 0.02392 * AVG(g)')} AS gmi,
             {_r4('COUNT(*) FILTER (WHERE g < 70) / COUNT(g)')} AS share_below,
             {_r4('COUNT(*) FILTER (WHERE g >= 70 AND g <= 180) / COUNT(g)')} AS share_in_range,
             {_r4('COUNT(*) FILTER (WHERE g > 180) / COUNT(g)')} AS share_above
      FROM g GROUP BY user_id""",
    "hr_zone_minutes": _state_sql(
        "CASE WHEN value < 10 THEN 'below 1' WHEN value < 20 THEN '1' WHEN value < 35 THEN '2' ELSE '3' END",
        "CAST(ts AS DATE)", ("day", "zone")),
    "sleep_stage_minutes": _state_sql(_case(STAGE, "event_type"), "CAST(ts - INTERVAL 12 HOUR AS DATE)",
                                      ("night", "stage")),
    "visit_change": f"""
      WITH p AS (SELECT o_custkey, AVG(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f,
                        AVG(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o,
                        AVG(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS p
                 FROM orders GROUP BY o_custkey)
      SELECT o_custkey, {_r4('f')} AS visit_f, {_r4('o')} AS visit_o, {_r4('p')} AS visit_p, {_r4('p - f')} AS change
      FROM p""",
    "lowest_hr": f"""
      WITH x AS (SELECT user_id, CAST(ts AS DATE) AS night,
                   AVG(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY epoch_us(ts)
                                    RANGE BETWEEN {dv.LOWEST_HR_WINDOW_US - 1} PRECEDING AND CURRENT ROW) AS a
                 FROM events)
      SELECT user_id, night, {_r4('MIN(a)')} AS lowest_5min_avg FROM x GROUP BY 1, 2""",
    "message_parts": """
      WITH m AS (SELECT doc_id, concat('Saved chart address:charts/doc_', CAST(doc_id AS VARCHAR),
                   '.png and table address:tables/doc_', CAST(doc_id AS VARCHAR), '_', lang, '.csv. ', text,
                   ' Raw data address:raw/', source, '.json') AS msg FROM documents),
      x AS (SELECT doc_id, regexp_extract_all(msg, 'address:([a-zA-Z0-9/_-]+\\.(?:png|csv|json))', 1) AS paths,
                   regexp_split_to_array(msg, 'address:([a-zA-Z0-9/_-]+\\.(?:png|csv|json))') AS pieces FROM m),
      y AS (SELECT doc_id, list_filter(list_transform(generate_series(0, 2 * len(paths)), lambda k:
                CASE WHEN k % 2 = 0 THEN {'kind': 'text', 'content': pieces[k // 2 + 1]}
                     ELSE {'kind': 'attachment', 'content': paths[(k - 1) // 2 + 1]} END),
              lambda p: length(p.content) > 0) AS kept FROM x)
      SELECT doc_id, CAST(i AS BIGINT) AS part_no, kept[i + 1].kind AS kind, kept[i + 1].content AS content
      FROM (SELECT doc_id, kept, unnest(generate_series(0, len(kept) - 1)) AS i FROM y)""",
    "latest_upload": """
      SELECT conv_id, arg_max(concat('/uploads/c', CAST(conv_id AS VARCHAR), '_t', CAST(turn AS VARCHAR), '.JPG'), turn)
             AS uploaded_path
      FROM conversations WHERE role = 'user' GROUP BY conv_id""",
    "describe_events": f"""
      SELECT {_r4('AVG(value)')} AS value_mean, {_r4('SUM(value)')} AS value_sum, COUNT(value) AS value_count,
             MIN(value) AS value_min, MAX(value) AS value_max FROM events""",
    "reconstruction_error": _oracle_recon(),
}
