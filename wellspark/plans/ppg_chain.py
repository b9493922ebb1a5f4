"""The wearable chain signal -> segment -> chunks -> beats -> HRV -> scaling -> stress over ``events`` (the deepest data
path, SURVEY §3.2).

Two tables play the pulse signal, read as samples at 4 Hz: a user's ``value`` in ``events`` in order of (ts, event_id),
where an 'error' event with a value of at least 100 plays ``hr == 0`` (some 70 samples a user), and in ``lineitem`` the
prices of ten devices (suppliers by their last digit) in order of shipping, thousands of samples each, where rare lines
of a quantity of 49 or 50 play it. Chunks are 60 s; the stress chain cuts them by time. A segment shorter than two chunks has no
scaled features, so its stress level is NULL; ``ppg_stress_5s`` cuts the short segments of ``events`` every 5 s instead.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspark.functions.numeric import round2, round_half_even
from wellspark.operators import hrv, peaks as pk, ppg, scoring as sc
from wellspark.operators.ordered import row_number_across_buckets
from wellspark.plans.scoring import ENCODER, HEAD
from wellspark.plans.signals import TIME_FROM_INTERVALS
from wellspark.session import materialize
from wellspark.sources.tables import table

HZ = 4
SECONDS = 60
CHUNK = SECONDS * HZ
KEYS = ["user_id"]
GROUP = ["user_id", "chunk_id"]
ORDER = ["ts", "event_id"]
SAMPLE_ORDER = ["ts", "tie"]
DIGITS = 6  # features are rounded before scaling, so that chunks alike stay alike whatever the order of a sum


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


def _event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = (F.col("event_type") == "error") & (F.col("value") >= 100)
    return _events(spark, sf_dir).select("event_id", "user_id", "ts", "value", zero.alias("zero"), F.col("event_id").alias("tie"))


def _line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = (F.col("l_quantity") >= 49) & (F.col("l_linenumber") == 1) & (F.col("l_discount") == 0)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), (F.col("l_suppkey") % 10).alias("user_id"),
        F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / 1000).alias("value"), zero.alias("zero"),
        # an order may hold a line number twice
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("tie"))


def _segment(samples: DataFrame, seconds: int) -> DataFrame:
    """The last segment's samples in chunks of so many seconds of the sampling clock; written once, as the row numbers
    and the first times read it again."""
    seg = materialize(ppg.last_segment(samples, KEYS, SAMPLE_ORDER, F.col("zero")), "segment")
    numbered = row_number_across_buckets(seg, KEYS, SAMPLE_ORDER, "row_no")
    clock = F.timestamp_micros((F.col("row_no") - 1) * (1_000_000 // HZ))
    return ppg.time_chunks(numbered.withColumn("clock", clock), KEYS, "clock", seconds)


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = ppg.fixed_chunks(_events(spark, sf_dir), KEYS, ORDER, rows=CHUNK)
    return pk.peaks_per_chunk(chunks, GROUP, "row_no", "value", HZ)


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 over all samples of every user, with the mean rate of the beat's chunk."""
    p = pk.with_rate_share(_peaks(spark, sf_dir), GROUP)
    chunk_rate = F.sum("rate_share").over(Window.partitionBy(*GROUP))
    return p.select(*GROUP, "peak_no", "sample_index", round_half_even("peak_ms", 4).alias("peak_ms"),
                    round_half_even("rate_bpm", 4).alias("rate_bpm"),
                    round_half_even(chunk_rate, 4).alias("chunk_rate_bpm"))


def hrv_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 TINN and A12 per chunk."""
    f = pk.frequency_features(_peaks(spark, sf_dir), GROUP)
    return f.select(*GROUP, *[round_half_even(c, 4).alias(c) for c in pk.FREQ_COLUMNS])


def chunk_features(p: DataFrame, group: list[str]) -> DataFrame:
    """All 30 scorer inputs per chunk from its beats: time domain, mean rate and beat times in one grouped pass,
    geometric and spectral features from the beat times, then Poincaré features and the PSS slot."""
    w = Window.partitionBy(*group).orderBy("peak_no")  # bounded: the beats of one chunk
    rr = pk.with_rate_share(p, group).withColumn("rr", F.col("peak_ms") - F.lag("peak_ms").over(w))
    rr = rr.withColumn("d", F.col("rr") - F.lag("rr").over(w))
    t = hrv.time_domain(rr, group, extra=[F.collect_list("peak_ms").alias("__ms"),
                                          F.sum("rate_share").alias("PPG_Rate_Mean")])
    t = pk.with_frequency_features(t, "__ms", with_hti=True)
    t = hrv.overwrite_pss(hrv.nonlinear(t))
    return t.select(*group, *[round_half_even(c, DIGITS).alias(c) for c in hrv.FEATURE_ORDER])


def _stress(samples: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """The whole chain per user: last segment -> chunks -> beats -> features -> min-max mean, rounded to 2 decimals ->
    stress level (NULL when a scaled feature is undefined, SURVEY Q14/Q15) and the level with undefined ones as 0."""
    p = pk.peaks_per_chunk(_segment(samples, seconds), GROUP, "row_no", "value", HZ)
    scaled = hrv.minmax_mean(chunk_features(p, GROUP), KEYS, hrv.FEATURE_ORDER, rate_col="PPG_Rate_Mean")
    scaled = scaled.withColumns({c: round2(c) for c in (*hrv.FEATURE_ORDER, "Heart_Rate")})
    vec = hrv.feature_vector(scaled).withColumn(
        "features_zero_filled", F.transform("features", lambda x: F.coalesce(x, F.lit(0.0))))
    return sc.score_stress(
        vec, {"stress_level": "features", "stress_level_zero_filled": "features_zero_filled"}, ENCODER, HEAD,
        keep=["user_id", "n_chunks", "Heart_Rate"],
    )


def ppg_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stress(_event_samples(spark, sf_dir))


def ppg_stress_5s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stress(_event_samples(spark, sf_dir), SHORT_SECONDS)


def ppg_stress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over segments of many minutes."""
    return _stress(_line_samples(spark, sf_dir))


SHORT_SECONDS = 5


def _chunks_of(samples: DataFrame, seconds: int = SECONDS) -> DataFrame:
    return _segment(samples, seconds).groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min("row_no").alias("first_row"),
        F.max("row_no").alias("last_row"),
        F.min_by("event_id", "row_no").alias("first_event"),
        F.max_by("event_id", "row_no").alias("last_event"),
        F.count_if("zero").alias("n_zero_samples"),
    )


def segment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stress chain up to beat detection (W1, W2, T4, W3): per user and chunk of the last segment, the sample
    count, first and last sample row with their events, and zero-rate samples."""
    return _chunks_of(_event_samples(spark, sf_dir), SHORT_SECONDS)


def segment_chunks_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks_of(_line_samples(spark, sf_dir))


QUERIES = {"peaks": peaks, "hrv_freq": hrv_freq, "ppg_stress": ppg_stress, "ppg_stress_5s": ppg_stress_5s,
           "ppg_stress_lines": ppg_stress_lines, "segment_chunks": segment_chunks,
           "segment_chunks_lines": segment_chunks_lines}


# ---------------------------------------------------------------------------------------------------------
# Oracles: the same chain from the events, with plain windows and one row per candidate.
# ---------------------------------------------------------------------------------------------------------

_ALL_SQL = """smp AS (
  SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_no
  FROM events)"""

_EVENT_SAMPLES = """ev AS (
  SELECT event_id, user_id, value, (event_type = 'error' AND value >= 100) AS z,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
"""
_LINE_SAMPLES = """ev AS (
  SELECT l_orderkey * 10 + l_linenumber AS event_id, l_suppkey % 10 AS user_id, l_extendedprice / 1000 AS value,
         (l_quantity >= 49 AND l_linenumber = 1 AND l_discount = 0) AS z,
         row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, l_quantity) AS rn
  FROM lineitem),
"""
_SEGMENT_SQL = """m AS (SELECT *, z AND COALESCE(NOT lag(z) OVER (PARTITION BY user_id ORDER BY rn), TRUE) AS is_start FROM ev),
ranked AS (SELECT user_id, rn, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS k FROM m WHERE is_start),
bounds AS (SELECT user_id, MAX(CASE WHEN k = 1 THEN rn END) AS last_rn, MAX(CASE WHEN k = 2 THEN rn END) AS sec_rn
      FROM ranked GROUP BY user_id HAVING COUNT(*) >= 2),
smp AS (SELECT m.user_id, m.event_id, m.value, m.z,
               row_number() OVER (PARTITION BY m.user_id ORDER BY m.rn) AS row_no
        FROM m JOIN bounds b USING (user_id) WHERE m.rn BETWEEN b.sec_rn AND b.last_rn)"""


def _beats_sql(rows: int) -> str:
    k = pk.widths(HZ)
    w = "PARTITION BY user_id, chunk_id ORDER BY row_no"

    def mean(c: str, half: int) -> str:
        frame = f"OVER ({w} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
        return f"(SUM({c}) {frame})::DOUBLE / (COUNT(*) {frame})"

    return f"""sig AS (SELECT user_id, (row_no - 1) // {rows} AS chunk_id, row_no, round_even(value * 100, 0)::BIGINT AS v
        FROM smp WHERE value IS NOT NULL),
flt AS (SELECT user_id, chunk_id, row_no, row_number() OVER ({w}) - 1 AS i,
               COUNT(*) OVER (PARTITION BY user_id, chunk_id) AS n,
               {mean('v', k['short'])} - {mean('v', k['long'])} AS f FROM sig),
sqr AS (SELECT *, CASE WHEN f > 0 THEN floor(f * f)::BIGINT ELSE 0 END AS q,
               lag(f) OVER ({w}) AS f0, lead(f) OVER ({w}) AS f2 FROM flt),
hi AS (SELECT *, {mean('q', k['peak'])} > {mean('q', k['beat'])}
             + {pk.BEAT_OFFSET}::DOUBLE * ((SUM(q) OVER (PARTITION BY user_id, chunk_id))::DOUBLE / n) AS high FROM sqr),
blk AS (SELECT *, i - row_number() OVER ({w}) AS block FROM hi WHERE high),
top AS (SELECT *, COUNT(*) OVER (PARTITION BY user_id, chunk_id, block) AS len,
               row_number() OVER (PARTITION BY user_id, chunk_id, block ORDER BY f DESC, i) AS place FROM blk),
cand AS (SELECT user_id, chunk_id, i, n,
           COALESCE(greatest(-0.5::DOUBLE, least(0.5::DOUBLE,
             0.5::DOUBLE * (f0 - f2) / NULLIF(f0 - 2.0::DOUBLE * f + f2, 0))), 0.0::DOUBLE) AS shift
         FROM top WHERE place = 1 AND len >= {k['min_len']}),
spaced AS (SELECT user_id, chunk_id, unnest(list_reduce(list_transform(list(i ORDER BY i), lambda p: [p]),
             lambda a, b: CASE WHEN b[1] - a[len(a)] > {k['delay']} THEN list_concat(a, b) ELSE a END)) AS i
           FROM cand GROUP BY user_id, chunk_id),
beat AS (SELECT c.user_id, c.chunk_id, c.i, c.n, (c.i + c.shift) * 1000.0::DOUBLE / {float(HZ)}::DOUBLE AS ms,
                row_number() OVER (PARTITION BY c.user_id, c.chunk_id ORDER BY c.i) - 1 AS peak_no
         FROM cand c JOIN spaced USING (user_id, chunk_id, i)),
gap AS (SELECT *, ms - lag(ms) OVER g AS rr,
               (MAX(ms) OVER c - MIN(ms) OVER c) / NULLIF(MAX(peak_no) OVER c, 0) AS mean_rr
        FROM beat WINDOW g AS (PARTITION BY user_id, chunk_id ORDER BY i), c AS (PARTITION BY user_id, chunk_id)),
rate AS (SELECT *, 60000.0::DOUBLE / rr AS bpm, COALESCE(60000.0::DOUBLE / rr, 60000.0::DOUBLE / mean_rr) AS r FROM gap),
every_sample AS (
  SELECT user_id, chunk_id, j, max(i) FILTER (WHERE i <= j) AS i0, min(i) FILTER (WHERE i >= j) AS i1
  FROM (SELECT user_id, chunk_id, i, unnest(range(0, n)) AS j
        FROM (SELECT a.user_id, a.chunk_id, a.n, b.i FROM (SELECT DISTINCT user_id, chunk_id, n FROM rate) a
              JOIN rate b USING (user_id, chunk_id)))
  GROUP BY ALL),
mean_rate AS (
  SELECT e.user_id, e.chunk_id,
         AVG(CASE WHEN i0 IS NULL THEN b.r WHEN i1 IS NULL OR i0 = i1 THEN a.r
                  ELSE a.r + (b.r - a.r) * (j - i0) / (i1 - i0) END) AS chunk_rate
  FROM every_sample e
  LEFT JOIN rate a ON a.user_id = e.user_id AND a.chunk_id = e.chunk_id AND a.i = e.i0
  LEFT JOIN rate b ON b.user_id = e.user_id AND b.chunk_id = e.chunk_id AND b.i = e.i1
  GROUP BY 1, 2)"""


def _freq_sql() -> str:
    lo = {b: pk.grid(b) for b in pk.BANDS}
    step, hz = f"{float(pk.RESAMPLE_MS)}::DOUBLE", 1000.0 / pk.RESAMPLE_MS
    turn = f"{2 * math.pi * pk.GRID_STEP_HZ / hz!r}::DOUBLE * k * i"
    hann = f"(0.5::DOUBLE - 0.5::DOUBLE * cos({2 * math.pi!r}::DOUBLE * i / len))"
    bands = ", ".join(f"{pk.GRID_STEP_HZ}::DOUBLE * SUM(p) FILTER (WHERE k BETWEEN {a} AND {z}) AS {b}"
                      for b, (a, z) in lo.items())
    return f"""seen AS (SELECT user_id, chunk_id, COUNT(rr) AS n_rr FROM rate GROUP BY 1, 2),
ivl AS (SELECT user_id, chunk_id, rr AS r0, lead(rr) OVER g AS r1, ms AS t0, lead(ms) OVER g AS t1,
          first_value(ms) OVER g AS first
        FROM rate WHERE rr IS NOT NULL WINDOW g AS (PARTITION BY user_id, chunk_id ORDER BY i)),
pts AS (SELECT user_id, chunk_id, j, r0 + (r1 - r0) * ((j * {step} - (t0 - first)) / (t1 - t0)) AS x
        FROM (SELECT *, unnest(range(ceil((t0 - first) / {step})::BIGINT, ceil((t1 - first) / {step})::BIGINT)) AS j
              FROM ivl JOIN seen USING (user_id, chunk_id) WHERE r1 IS NOT NULL AND n_rr >= {pk.MIN_INTERVALS})),
size AS (SELECT user_id, chunk_id, len, greatest(1, len // 2) AS hop, (m - len) // greatest(1, len // 2) + 1 AS n_seg
         FROM (SELECT user_id, chunk_id, COUNT(*) AS m, least(COUNT(*), {pk.WELCH_POINTS}) AS len FROM pts GROUP BY 1, 2)
         WHERE m > 1),
seg AS (SELECT user_id, chunk_id, s, len, n_seg, j - s * hop AS i, x - AVG(x) OVER (PARTITION BY user_id, chunk_id, s) AS x
        FROM (SELECT *, unnest(range(0, n_seg)) AS s FROM size) JOIN pts USING (user_id, chunk_id)
        WHERE j BETWEEN s * hop AND s * hop + len - 1),
win AS (SELECT user_id, chunk_id, s, n_seg, i, {hann} * x AS y,
          SUM({hann} * {hann}) OVER (PARTITION BY user_id, chunk_id, s) AS w FROM seg),
wave AS (SELECT user_id, chunk_id, k, s, any_value(n_seg) AS n_seg,
           2.0::DOUBLE * (power(SUM(y * cos({turn})), 2) + power(SUM(y * sin({turn})), 2))
             / ({hz}::DOUBLE * any_value(w) * any_value(n_seg)) AS p
         FROM win CROSS JOIN range(1, {lo['VHF'][1] + 1}) AS g(k) GROUP BY 1, 2, 3, 4),
band AS (SELECT user_id, chunk_id, {bands} FROM wave GROUP BY 1, 2),
hist AS (SELECT user_id, chunk_id, floor(rr / {pk.HIST_BIN_MS}::DOUBLE)::BIGINT AS b, COUNT(*) AS c
         FROM rate WHERE rr IS NOT NULL GROUP BY 1, 2, 3),
mode AS (SELECT user_id, chunk_id, arg_max(b, (c, -b)) AS x, MAX(c) AS y, MIN(b) AS b_min, MAX(b) AS b_max, SUM(c) AS n_rr
         FROM hist GROUP BY 1, 2),
base AS (SELECT *, unnest(generate_series(b_min, b_max)) AS e FROM mode),
err AS (SELECT s.user_id, s.chunk_id, s.x, s.e, abs(s.x - s.e)::DOUBLE AS w, any_value(s.y)::DOUBLE AS y,
               COALESCE(SUM(h.c * abs(h.b - s.e)), 0)::DOUBLE AS a
        FROM base s LEFT JOIN hist h ON h.user_id = s.user_id AND h.chunk_id = s.chunk_id
             AND ((h.b < s.x AND h.b > s.e) OR (h.b > s.x AND h.b < s.e))
        WHERE s.e <> s.x GROUP BY 1, 2, 3, 4),
fit AS (SELECT *, row_number() OVER (PARTITION BY user_id, chunk_id, e < x
          ORDER BY y * y * (w - 1.0) * (2.0::DOUBLE * w - 1.0) / (6.0::DOUBLE * w) - 2.0::DOUBLE * y * a / w, w DESC) AS place
        FROM err),
tri AS (SELECT m.user_id, m.chunk_id, m.n_rr / m.y AS HRV_HTI, CASE WHEN m.n_rr >= 3 THEN
          (COALESCE(MAX(f.e) FILTER (WHERE f.e > f.x), any_value(m.x))
           - COALESCE(MAX(f.e) FILTER (WHERE f.e < f.x), any_value(m.x))) * {pk.HIST_BIN_MS}::DOUBLE END AS HRV_TINN
        FROM mode m LEFT JOIN (SELECT * FROM fit WHERE place = 1) f USING (user_id, chunk_id)
        GROUP BY m.user_id, m.chunk_id, m.n_rr, m.y),
freq AS (SELECT s.user_id, s.chunk_id, HRV_TINN, HRV_HTI, LF AS HRV_LF, HF AS HRV_HF, VHF AS HRV_VHF,
           LF / NULLIF(HF, 0) AS HRV_LFHF, LF / NULLIF(VLF + LF + HF + VHF, 0) AS HRV_LFn,
           HF / NULLIF(VLF + LF + HF + VHF, 0) AS HRV_HFn, CASE WHEN HF > 0 THEN ln(HF) END AS HRV_LnHF
         FROM seen s LEFT JOIN tri USING (user_id, chunk_id) LEFT JOIN band USING (user_id, chunk_id))"""


def _rounded(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10 ** digits}, 0) / {10 ** digits}"


def _stress_sql(samples: str, seconds: int) -> str:
    feats = ", ".join(f"{_rounded(c if c != 'HRV_PSS' else 'HRV_LF', DIGITS)} AS {c}" for c in hrv.FEATURE_ORDER)
    scaled = ", ".join(_rounded(f"(AVG({c}) - MIN({c})) / NULLIF(MAX({c}) - MIN({c}), 0)", 2) for c in hrv.FEATURE_ORDER)
    zero = "list_transform(x, lambda v: COALESCE(v, 0.0::DOUBLE))"
    enc, e = sc.layers_sql("vec", ["user_id"], zero, ENCODER, "none", prefix="enc")
    head, h = sc.layers_sql(e, ["user_id"], "h", HEAD, "sigmoid", prefix="head")
    level = "CAST(list_position(h, list_max(h)) - 1 AS INTEGER)"
    return f"""WITH {samples}{_SEGMENT_SQL}, {_beats_sql(seconds * HZ)}, {_freq_sql()},
rd AS (SELECT user_id, chunk_id, rr, rr - lag(rr) OVER (PARTITION BY user_id, chunk_id ORDER BY i) AS d,
              median(rr) OVER (PARTITION BY user_id, chunk_id) AS med FROM rate),
{TIME_FROM_INTERVALS},
feat AS (SELECT user_id, chunk_id, {feats}
         FROM (SELECT tn.* EXCLUDE (PPG_Rate_Mean), chunk_rate AS PPG_Rate_Mean,
                      freq.* EXCLUDE (user_id, chunk_id)
               FROM tn JOIN freq USING (user_id, chunk_id) JOIN mean_rate USING (user_id, chunk_id))),
vec AS (SELECT user_id, COUNT(*) AS n_chunks, {_rounded('AVG(PPG_Rate_Mean)', 2)} AS Heart_Rate, [{scaled}] AS x
        FROM feat GROUP BY user_id),
{", ".join(enc + head)}
SELECT user_id, n_chunks, Heart_Rate, CASE WHEN list_count(x) = {len(hrv.FEATURE_ORDER)} THEN {level} END AS stress_level,
       {level} AS stress_level_zero_filled
FROM vec JOIN {h} USING (user_id)"""


def _chunks_sql(samples: str, seconds: int) -> str:
    return f"""WITH {samples}{_SEGMENT_SQL}
      SELECT user_id, (row_no - 1) // {seconds * HZ} AS chunk_id, COUNT(*) AS n_samples,
             MIN(row_no) AS first_row, MAX(row_no) AS last_row,
             arg_min(event_id, row_no) AS first_event, arg_max(event_id, row_no) AS last_event,
             COUNT(*) FILTER (WHERE z) AS n_zero_samples
      FROM smp GROUP BY 1, 2"""


ORACLES: dict[str, str] = {
    "peaks": f"""WITH {_ALL_SQL}, {_beats_sql(CHUNK)}
      SELECT user_id, chunk_id, peak_no, i AS sample_index, {_rounded('ms', 4)} AS peak_ms,
             {_rounded('bpm', 4)} AS rate_bpm, {_rounded('chunk_rate', 4)} AS chunk_rate_bpm
      FROM rate JOIN mean_rate USING (user_id, chunk_id)""",
    "hrv_freq": f"""WITH {_ALL_SQL}, {_beats_sql(CHUNK)}, {_freq_sql()}
      SELECT user_id, chunk_id, {", ".join(f"{_rounded(c, 4)} AS {c}" for c in pk.FREQ_COLUMNS)} FROM freq""",
    "ppg_stress": _stress_sql(_EVENT_SAMPLES, SECONDS),
    "ppg_stress_5s": _stress_sql(_EVENT_SAMPLES, SHORT_SECONDS),
    "ppg_stress_lines": _stress_sql(_LINE_SAMPLES, SECONDS),
    "segment_chunks": _chunks_sql(_EVENT_SAMPLES, SHORT_SECONDS),
    "segment_chunks_lines": _chunks_sql(_LINE_SAMPLES, SECONDS),
}
