"""Rows that once gave wrong answers or stopped a job."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from wellspark.functions import numeric, parsing, text
from wellspark.operators import ordered, scoring, trends
from wellspark.sources import sinks
from wellspark.streaming import jobs


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first().o


def test_trend_line_ignores_rows_without_a_value(spark):
    import datetime as dt

    day = dt.date(2020, 1, 1)
    rows = [(1, day + dt.timedelta(d), y) for d, y in ((0, 1.0), (1, 2.0), (2, 3.0), (10, None))]
    out = trends.trend_line(spark.createDataFrame(rows, "k int, d date, y double"), ["k"], "d", "y").first()
    assert out.slope == pytest.approx(1.0) and out.intercept == pytest.approx(1.0)
    rows[1] = (1, rows[1][1], math.nan)
    out = trends.trend_line(spark.createDataFrame(rows, "k int, d date, y double"), ["k"], "d", "y").first()
    assert out.slope is None and out.intercept is None


def test_key_value_text_with_commas_and_repeated_names(spark):
    assert one(spark, "name = Smith, John, a = 1, a = 2", text.kv_parse) == {"name": "Smith", "John": None, "a": "2"}


def test_percent_of_a_tiny_total(spark):
    assert one(spark, 9.9e15, numeric.pct_trunc, "double") == 990000000000000000
    assert one(spark, -0.298, numeric.pct_trunc, "double") == -29
    assert one(spark, math.inf, numeric.pct_trunc, "double") is None


def test_reconstruction_skips_bad_vectors(spark):
    enc, dec = scoring.seeded_layers([3, 2], 1), scoring.seeded_layers([2, 3], 2)
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0, None, 2.0]), (4, [1.0])],
                               "i int, x array<double>")
    got = {r.i: r.reconstruction for r in scoring.reconstruct(df, "x", enc, dec, ["i"]).collect()}
    assert len(got[1]) == 3 and np.isfinite(got[1]).all() and got[2] is got[3] is got[4] is None


def test_json_sinks_write_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(sinks.records_json(df).first().json) == {"a": 1, "b": None}
    assert json.loads(sinks.columns_json(df, ["a", "b"]).first().json) == {"a": 1, "b": None}


def test_tool_calls_in_either_quotes(spark):
    code = """x = self.execute_task("b", ["z", 'x, y', '[1]'])\nself.execute_task('c', [])"""
    df = spark.createDataFrame([(code,)], "v string")
    rows = df.select(F.explode(parsing.tool_calls("v")).alias("c")).select("c.task", parsing.split_args(F.col("c.args")).alias("a"))
    assert [(r.task, r.a) for r in rows.collect()] == [("b", ["z", "x, y", "[1]"]), ("c", [])]


def test_visible_text_of_awkward_html(spark):
    html = "<p>it&#8217;s &#x41;</p><script>var s='</style>';hidden()</script><a title='x>y'>L</a> it<b>'</b>s"
    assert one(spark, html, text.html_visible_text) == "it’s A L it ' s"


def test_ordered_operators_with_nulls_equal_plain_windows(spark):
    import datetime as dt

    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, *range(5)]), i, rng.random()) for i in range(200)]
    t0 = dt.datetime(2020, 1, 1)
    rows = [Row(k=k, ts=None if d is None else t0 + dt.timedelta(days=d, minutes=rng.randint(0, 600)), i=i, v=v)
            for k, d, i, v in rows]
    df = spark.createDataFrame(rows, "k int, ts timestamp, i int, v double")
    w = Window.partitionBy("k").orderBy("ts", "i")
    plain = df.select("*", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.row_number().over(w).alias("r"))
    got = ordered.lag_across_buckets(df, ["k"], ["ts", "i"], "v", "p")
    got = ordered.lead_across_buckets(got, ["k"], ["ts", "i"], ["v"], "next_").withColumnRenamed("next_v", "n")
    got = ordered.row_number_across_buckets(got, ["k"], ["ts", "i"], "r")
    key = lambda r: r.i
    want = [(r.i, r.p, r.n, r.r) for r in sorted(plain.collect(), key=key)]
    assert [(r.i, r.p, r.n, r.r) for r in sorted(got.collect(), key=key)] == want


def test_a_failing_stream_raises(spark, tmpdir_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(f"{tmpdir_path}/in")
    stream = spark.readStream.schema("a int, b string").parquet(f"{tmpdir_path}/in")
    broken = stream.select(F.raise_error(F.lit("broken")).cast("string").alias("o"))
    with pytest.raises(Exception, match="broken"):
        jobs.run_to_table(spark, broken, "broken")


def test_a_repeated_batch_replaces_its_rows(spark, tmpdir_path):
    for i in range(3):
        spark.createDataFrame([(i, j) for j in range(5)], "a int, b int").coalesce(1).write.mode("append").parquet(
            f"{tmpdir_path}/in")
    stream = spark.readStream.schema("a int, b int").option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_path}/in")
    out = jobs.run_to_table(spark, stream.groupBy("b").agg(F.count("*").alias("n")), "counts", ["b"])
    assert sorted(map(tuple, out.collect())) == [(b, 3) for b in range(5)]


def test_a_cluster_session_needs_a_shared_folder():
    from wellspark.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
