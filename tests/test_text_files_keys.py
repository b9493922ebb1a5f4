"""HTML references, long texts in linear time, joins back on NULL keys, history appends, file trees."""

import datetime as dt
import html
import random
import time
import uuid
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from wellspark.functions import text as tx
from wellspark.operators import nutrition, ppg, transcripts, trends
from wellspark.operators import text as to
from wellspark.session import scratch_path
from wellspark.sources import readers, schemas, sinks


def folder(spark):
    return scratch_path(spark, f"test-files/{uuid.uuid4().hex[:12]}")


# ---- references and visible text ---------------------------------------------------------------------------------

def test_references_decode_as_in_html(spark):
    rng = random.Random(4)
    texts = [f"&{n}" for n in html5] + [f"x&{n.rstrip(';')}1 y" for n in html5]
    texts += [f"&#{n};" for n in [*range(300), 8217, 0xD800, 0xFFFE, 0x10FFFF, 0x110000, 64976, 10 ** 25]]
    texts += ["&#38;lt;", "&amp;lt;", "&&amp;&", "a & b", "&notit;", "&;", "&#;", "&#x;", "&", "", "&#x2019", "&#X41;"]
    texts += ["".join(rng.choices([*"&#x;ab12 <", "amp", "lt", "copy", "not", "hellip;"], k=rng.randrange(12)))
              for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", tx.decode_entities("t").alias("o"))
    assert [(r.t, r.o, html.unescape(r.t)) for r in df.collect() if r.t is not None and r.o != html.unescape(r.t)] == []
    assert [r.o for r in df.where("t IS NULL").collect()] == [None]


class VisibleText(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.texts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template")

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.texts.append(data.strip())


def test_visible_text_equals_a_parser(spark):
    pages = [
        "<!DOCTYPE html><p>Fish &amp; chips &mdash; 5&nbsp;&euro;</p><script>if (a && b) x('&lt;p>')</script>",
        "<p>&rsquo;caf&eacute;&rsquo;&hellip;</p><p>&#38;lt; &amp;amp; &copy 2020 &notin; &nope;</p>",
        "<div>&nbsp;&#8203;<b> bold </b> tail &#x1F600;</div><style>p{}</style><!-- &amp; -->",
        "<td title='a>b'>x</td><td>&nbsp;</td>", "no tags at all &lt;b&gt;", ""]
    got = spark.createDataFrame([(p,) for p in pages], "h string").select(tx.html_visible_text("h").alias("t")).collect()
    for page, row in zip(pages, got):
        parser = VisibleText()
        parser.feed(page)
        parser.close()
        assert row.t == " ".join(parser.texts)


def test_long_texts_take_linear_time(spark):
    n = 100_000
    began = time.time()
    kv = spark.createDataFrame([(", ".join(f"k{i % 70_000} = v{i}" for i in range(n)),)], "t string")
    row = kv.select(tx.kv_parse("t").alias("m")).select(F.size("m").alias("n"), F.col("m")["k5"].alias("v")).first()
    assert (row.n, row.v) == (70_000, "v70005")
    msg = "see address:a/b.png or é " * n
    found = to.attachments(spark.createDataFrame([(1, msg)], "k int, t string"), ["k"], "t")
    last = found.orderBy(F.col("att_no").desc()).first()
    assert found.count() == n and msg[last.start_pos : last.end_pos] == "address:a/b.png" and last.end_pos == len(msg) - 6
    assert time.time() - began < 60
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "address:x.png"), (4, "address:xaddress:y.csv")], "k int, t string")
    assert [(r.k, r.start_pos, r.path) for r in to.attachments(odd, ["k"], "t").orderBy("k").collect()] == [
        (3, 0, "x.png"), (4, 9, "y.csv")]


def test_running_totals(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        df = spark.createDataFrame([(list(range(1, n + 1)),)], "x array<int>")
        got = df.select(tx.running_totals(F.col("x")).alias("t")).first().t
        assert got == [k * (k + 1) // 2 for k in range(n)]


# ---- NULL keys ---------------------------------------------------------------------------------------------------

DAY = dt.datetime(2024, 1, 1)


def test_last_segment_of_a_null_key(spark):
    zeros = [1, 0, 1, 1, 0, 1, 0]
    rows = [(k, DAY + dt.timedelta(hours=9 * i), i, z) for k in (None, "a") for i, z in enumerate(zeros)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int, z int")
    got = ppg.last_segment(df, ["k"], ["ts", "i"], F.col("z") == 1, closing_flag="last")
    for key in (None, "a"):
        assert sorted((r.i, r["last"]) for r in got.collect() if r.k == key) == [(2, False), (3, False), (4, False), (5, True)]


def test_trend_line_and_time_chunks_of_a_null_key(spark):
    rows = [(k, DAY + dt.timedelta(days=i), 2.0 * i) for k in (None, "a") for i in range(3)]
    df = spark.createDataFrame(rows, "k string, d timestamp, y double")
    out = trends.trend_line(df, ["k"], "d", "y").collect()
    assert len(out) == 6 and all(r.slope == pytest.approx(2.0) and r.fitted == pytest.approx(r.y) for r in out)
    late = spark.createDataFrame([(None, None, 1.0), ("a", DAY + dt.timedelta(days=9, seconds=59.9), 1.0)], df.schema)
    chunks = ppg.time_chunks(df.unionByName(late), ["k"], "d", seconds=86_400).collect()
    assert sorted((r.k or "", r.chunk_id if r.chunk_id is not None else -1) for r in chunks) == [
        ("", -1), ("", 0), ("", 1), ("", 2), ("a", 0), ("a", 1), ("a", 2), ("a", 9)]


def passes(spark):
    flags = [("ok", False, False, ""), ("ok", True, False, ""), ("ok", False, True, "self.execute_task('t', ['1', 'b'])"),
             ("ok", False, True, "self.execute_task('after', [])")]
    rows = [(k, n, *f) for k in (None, 7) for n, f in enumerate(flags)] + [(8, 0, "bad_flag", None, None, ""), (9, 0, *flags[2])]
    return spark.createDataFrame(rows, "run long, turn int, parse_status string, strategy_change boolean, "
                                       "step_success boolean, code string")


def test_run_outcome_of_a_null_run(spark):
    got = {r.run: (r.n_passes, r.attempts, r.success) for r in transcripts.run_outcome(
        passes(spark), ["run"], ["turn"], bucket=F.lit(0)).collect()}
    assert got == {None: (4, 3, True), 7: (4, 3, True), 8: (1, 1, False), 9: (1, 1, False)}


# ---- history -----------------------------------------------------------------------------------------------------

def test_history_appends_are_repeatable(spark):
    done = transcripts.succeeded_passes(passes(spark), ["run"], ["turn"], bucket=F.lit(0))
    assert sorted(((r.run, r.pass_no) for r in done.collect()), key=str) == [(7, 3), (None, 3)]
    calls = transcripts.extract_tool_calls(done, ["run", "pass_no"], "code")
    keys, path = ["run", "pass_no", "call_no"], folder(spark)
    for batch in (calls.where("run = 7"), calls, calls.unionByName(calls), calls.limit(0)):
        history = transcripts.append_history(batch, path, keys)
    assert sorted(((r.run, r.pass_no, r.task, r.args) for r in history.collect()), key=str) == [
        (7, 3, "t", ["1", "b"]), (None, 3, "t", ["1", "b"])]


# ---- numbers and foods -------------------------------------------------------------------------------------------

def test_numbers_print_as_in_python(spark):
    values = [0.0, 43.0, 1432.77, 1e7, 12345678.9, 123456789012.25, 1e15, 1e16, 3.5e17, 1e-3, 0.00012, 1e-5, 1.25e-7, -1e7,
              -43.5, 9999999.99, 123456789012345.67, 0.000123456789012345]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = [r.t for r in df.select(nutrition.number_text(F.col("v")).alias("t")).collect()]
    assert got == [str(v) for v in values] + [None]


def test_whole_totals_print_without_a_fraction(spark):
    foods = spark.createDataFrame([(1, 14.0, 0.0, 0.5), (1, 3.0, None, 0.5), (2, 28.66, 0.0, None), (2, 14.34, 0.0, 1.0)],
                                  "log int, nf_total_fat double, nf_dietary_fiber double, nf_sugars double")
    rows = nutrition.format_totals(nutrition.food_totals(foods, ["log"], whole=True)).collect()
    got = {r.log: (r.Total_Fat_text, r.Dietary_Fiber_text, r.Sugars_text, r.Sodium_text) for r in rows}
    assert got == {1: ("17g", "0g", "1.0g", "0mg"), 2: ("43.0g", "0g", "1g", "0mg")}
    assert not any(c.endswith("_whole") for c in rows[0].asDict())


def test_message_parts_of_a_long_text_take_linear_time(spark):
    n = 50_000
    began = time.time()
    df = spark.createDataFrame([(1, "see address:a/b.png or " * n), (2, None), (3, "address:x.csv"), (4, "plain")], "k int, t string")
    got = to.message_parts(df, ["k"], "t")
    assert got.where("k = 1").count() == 2 * n + 1 and time.time() - began < 60
    assert [(r.k, r.part_no, r.kind, r.content) for r in got.where("k > 1").orderBy("k").collect()] == [
        (3, 0, "attachment", "x.csv"), (4, 0, "text", "plain")]


def test_foods_with_one_normalised_name(spark):
    log = spark.createDataFrame([(1, " Red   APPLE ", 2.0), (2, "pear", 1.0), (3, None, 1.0), (4, "red apple", 3.0)],
                                "id int, food string, n double")
    foods = spark.createDataFrame([("Red Apple", 10.0), ("red  apple", 99.0), ("red apple", 50.0), (None, 7.0)],
                                  "name string, kcal double")
    got = nutrition.price_foods(log, foods, "food", "name", "n", ["kcal"])
    assert sorted((r.id, r.kcal) for r in got.collect()) == [(1, 20.0), (2, None), (3, None), (4, 30.0)]


# ---- files -------------------------------------------------------------------------------------------------------

def test_sample_numbers_follow_the_file_over_splits(spark):
    path = folder(spark)
    n = 30_000
    lines = spark.range(n, numPartitions=1).select(
        F.concat_ws(",", F.lit(1596240000000), (F.col("id") % 1000).cast("double"), F.col("id").cast("double")).alias("v"))
    head = spark.createDataFrame([("timestamp,ppg,hr",)], "v string")
    head.coalesce(1).unionByName(lines).coalesce(1).write.text(f"{path}/par_1/samsung/ppg.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = readers.read_ppg(spark, path)
        assert df.rdd.getNumPartitions() > 5
        rows = df.select("hr", "sample_no", F.col("user_id")).orderBy("sample_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.hr for r in rows] == [float(i) for i in range(n)] and len({r.sample_no for r in rows}) == n


def test_device_trees_read_in_both_layouts(spark):
    root = folder(spark)
    day = spark.createDataFrame([("u/1", "2020-08-01", 5.0), ("par_5", "2020-08-02", None)], "who string, date string, steps double")
    day = day.select("who", "date", *[F.col("steps").alias(c) for c in schemas.ACTIVITY_RAW[1:]])
    sinks.write_device_tree(day, root, schemas.ACTIVITY_DEVICE, schemas.ACTIVITY_FILE, "who")
    day.where("who = 'par_5'").drop("who").coalesce(1).write.option("header", "true").csv(f"{root}/par_6/oura/x")
    assert {r.user_id for r in readers.read_daily_activity(spark, root, ["par_5"]).collect()} == {"par_5"}
    assert readers.read_daily_activity(spark, root).count() == 2
    assert readers.read_daily_activity(spark, root, ["nobody"]).count() == 0
    assert readers.read_sleep_datasets(spark, root).count() == 0


def test_quotes_and_missing_values_in_tables(spark):
    path = folder(spark)
    rows = spark.createDataFrame([('say "hi", you', "NA"), ("x", None), ("", "1")], "a string, b string")
    sinks.append_csv(rows, path)
    sinks.append_csv(rows.limit(1), path)
    got = sorted(((r.a, r.b) for r in readers.read_string_table(spark, path).collect()), key=str)
    assert got == [('say "hi", you', None), ('say "hi", you', None), ("x", None), (None, "1")]
