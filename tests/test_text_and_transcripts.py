"""Small stated cases for the text, reply-parsing and derivation helpers."""

import datetime as dt

from pyspark.sql import functions as F

from wellspark.functions import text as tx
from wellspark.operators import derived as dv
from wellspark.operators import text as to
from wellspark.operators import transcripts as tr
from wellspark.operators import scoring as sc


def test_kv_text_both_ways(spark):
    df = spark.createDataFrame([(1, 4)], "col1 int, col2 int")
    line = df.select(tx.kv_line(["col1", "col2"]).alias("l")).first().l
    assert line == "col1 = 1, col2 = 4"
    m = spark.createDataFrame([(line,)], "l string").select(tx.kv_parse("l").alias("m")).first().m
    assert m == {"col1": "1", "col2": "4"}


def test_tagged_reply_with_two_backtick_close(spark):
    reply = ("[STRATEGY_CHANGE]: no\n[STEP_SUCCESS] - No\n[CONTENT]: next step\n```python\n"
             "result = self.execute_task('affect_sleep_get', ['par_1', '2020-08-01', '2020-08-07'])\n``")
    df = spark.createDataFrame([(reply,), ("[STEP_SUCCESS]: yes",), ("[STRATEGY_CHANGE] maybe\n[STEP_SUCCESS] no",)],
                               "t string")
    rows = tr.parse_replies(df, "t").collect()
    assert (rows[0].parse_status, rows[0].strategy_change, rows[0].step_success) == ("ok", False, False)
    assert rows[0].code.strip().startswith("result = self.execute_task('affect_sleep_get'")
    assert rows[1].parse_status == "missing_tag" and rows[1].step_success is False
    assert rows[2].parse_status == "bad_flag"
    calls = tr.extract_tool_calls(tr.parse_replies(df, "t").limit(1), [], "code").first()
    assert (calls.task, calls.args) == ("affect_sleep_get", ["par_1", "2020-08-01", "2020-08-07"])


def test_second_tag_on_a_line_and_repeated_tag(spark):
    replies = ["[STRATEGY_CHANGE] yes [STEP_SUCCESS] no", "[STRATEGY_CHANGE] no\n[STEP_SUCCESS] yes\n[step_success]: no",
               "note [STRATEGY_CHANGE] no\n [STEP_SUCCESS] yes\n[STRATEGY_COMPLETE] x [CONTENT] ```python\na``"]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, t string")
    a, b, c = tr.parse_replies(df, "t").orderBy("i").collect()
    assert a.parse_status == "missing_tag"
    assert (b.parse_status, b.strategy_change, b.step_success) == ("ok", False, False)
    assert (c.parse_status, c.step_success, c.code) == ("ok", True, "\na")


def test_run_ends_with_success_error_or_limit(spark):
    ok, bad = "ok", "bad_flag"
    runs = {
        "contradiction": [(ok, False, False), (ok, True, True), (ok, False, True)],
        "bad": [(bad, None, None), (ok, False, True)],
        "success": [(ok, True, True), ("missing_tag", False, False), (ok, True, False), (ok, False, True), (ok, False, False)],
        "limit": [(ok, False, False)] * 12 + [(ok, False, True)],
    }
    rows = [(k, i, *p) for k, ps_ in runs.items() for i, p in enumerate(ps_)]
    df = spark.createDataFrame(rows, "run string, i int, parse_status string, strategy_change boolean, step_success boolean")
    out = {r.run: r for r in tr.run_outcome(df, ["run"], ["i"], bucket=F.floor(F.col("i") / 4)).collect()}
    pick = lambda r: (r.attempts, r.skipped, r.errors, r.strategy_changes, r.failures, r.passes_after_end, r.success)
    assert pick(out["contradiction"]) == (2, 0, 1, 0, 1, 1, False)
    assert pick(out["bad"]) == (1, 0, 1, 0, 0, 1, False)
    assert pick(out["success"]) == (4, 1, 0, 1, 1, 1, True)
    assert pick(out["limit"]) == (11, 0, 0, 0, 11, 2, False)


def test_react_outcomes(spark):
    texts = [
        "Thought: plan\nAction: affect_sleep_get\nAction Inputs: meal_plan\n",
        "Thought: done\nFinal Answer: eat more fiber",
        "Thought: hmm, nothing",
        "Action: affect_sleep_get\nAction Inputs: x\nFinal Answer: both",
        "Final Answer: first\n\nAction: affect_sleep_get\nAction Inputs: y",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {r.i: r for r in tr.react_parse(df, "t", ["affect_sleep_get"]).collect()}
    assert (out[0].outcome, out[0].task, out[0].task_input) == ("action", "affect_sleep_get", "meal_plan\n")
    assert (out[1].outcome, out[1].answer) == ("finish", "eat more fiber")
    assert out[2].outcome == "malformed"
    assert out[3].outcome == "error"
    assert (out[4].outcome, out[4].answer) == ("finish", "first")


def test_attachments_and_parts(spark):
    msg = "see address:a/b.png and address:c.csv end"
    df = spark.createDataFrame([(1, msg)], "k int, m string")
    att = [(r.path, r.start_pos, r.end_pos) for r in to.attachments(df, ["k"], "m").orderBy("att_no").collect()]
    assert att == [("a/b.png", 4, 19), ("c.csv", 24, 37)]
    assert msg[4:19] == "address:a/b.png" and msg[24:37] == "address:c.csv"
    parts = [(r.kind, r.content) for r in to.message_parts(df, ["k"], "m").orderBy("part_no").collect()]
    assert parts == [("text", "see "), ("attachment", "a/b.png"), ("text", " and "), ("attachment", "c.csv"),
                     ("text", " end")]


def test_image_refs_and_history(spark):
    df = spark.createDataFrame([("Is /tmp/x.PNG healthy? https://a.b/c.jpg).",), ("",)], "t string")
    r = to.image_refs(df, "t").collect()
    assert (r[0].url, r[0].local_path, r[0].question, r[0].route) == ("https://a.b/c.jpg", "/tmp/x.PNG", "Is healthy?", "url")
    assert r[1].question == tx.DEFAULT_IMAGE_QUESTION and r[1].route == "text"
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye")],
                                 "c int, turn int, role string, text string")
    pairs = to.reply_pairs(conv, "c", "turn", "role", "text")
    h = to.history_text(pairs, "c", "turn").first().history
    assert h == ("\n------------\nUser: hi\nCHA: hello\n------------\n"
                 "\n------------\nUser: bye\nCHA: \n------------\n")


def test_page_text_visible_only(spark):
    html = ("<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style>"
            "<script>var a='<p>';</script></head><body><!-- c --><p> Hello </p><p>\nworld&lt;</p></body></html>")
    df = spark.createDataFrame([("https://x.org/a", html), ("ftp://x.org/a", html), ("http://x/a.PDF", html)],
                               "url string, html string")
    r = to.page_text(df, "url", "html").collect()
    assert r[0].text == "T & U Hello world<"
    assert (r[1].url_ok, r[1].text) == (False, None)
    assert (r[2].is_pdf, r[2].text) == (True, None)


def test_search_pick_cases(spark):
    df = spark.createDataFrame(
        [('{"organic_results": [{"link": "https://a"}]}',), ("{}",), ('{"answer_box": {"link": "https://b"}}',),
         ('{"answer_box": {"title": "x"}, "organic_results": [{"link": "https://c"}]}',)], "j string")
    picks = [r.pick for r in to.search_pick(df, "j").collect()]
    assert picks == ["https://a", tx.SEARCH_ERROR_TEXT, "https://b", tx.SEARCH_ERROR_TEXT]


def test_chunks_and_budget(spark):
    df = spark.createDataFrame([(1, "a" * 9), (2, "")], "k int, t string")
    chunks = [(r.chunk_no, r.chunk) for r in to.chunk_text(df.where("k = 1"), ["k"], "t", max_tokens=1).collect()]
    assert chunks == [(0, "aaaa"), (1, "aaaa"), (2, "a")]
    assert to.chunk_text(df.where("k = 2"), ["k"], "t").count() == 0
    b = {r.k: r for r in to.token_budget(df, ["k"], "t", max_tokens=1).collect()}
    assert (b[1].n_chunks, b[1].chunk_budget, b[1].over_budget) == (3, 0, True)
    assert b[2].chunk_budget is None


def test_small_derivations(spark):
    df = spark.createDataFrame([(420.0, 480.0, 70.0, 175.0, "/a/b/c.png", 404)],
                               "s double, bed double, kg double, cm double, p string, st int")
    r = df.select(dv.sleep_efficiency(F.col("s"), F.col("bed")).alias("eff"), dv.bmi(F.col("kg"), F.col("cm")).alias("bmi"),
                  tx.file_name("p").alias("f"), tx.status_text("st", F.lit("x"), "failed").alias("st")).first()
    assert r.eff == 87.5 and round(r.bmi, 2) == 22.86 and r.f == "c.png" and r.st == "failed"
    ev = spark.createDataFrame([(1, dt.date(2024, 1, 1), "vigorous", 60.0), (1, dt.date(2024, 1, 2), "walking", 30.0)],
                               "u int, d date, i string, m double")
    met = dv.met_minutes(ev, ["u"], F.col("d"), F.col("i"), F.col("m")).first()
    assert met.met_minutes == 8.0 * 60 + 3.3 * 30 and met.activity_class == "inactive"


def test_reconstruction_shape(spark):
    enc = sc.seeded_layers(sc.ENCODER_SIZES, 1)
    dec = sc.seeded_layers(sc.DECODER_SIZES, 3)
    df = spark.createDataFrame([(1, [0.1] * 30)], "k int, x array<double>")
    out = sc.reconstruct(df, "x", enc, dec, ["k"]).first()
    assert len(out.reconstruction) == 30
