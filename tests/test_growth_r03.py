"""Findings on growth: what one task reads of a key's rows, and what the documents of meals write."""

import datetime as dt
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from wellspark.functions.numeric import round2
from wellspark.operators import nutrition as nu, ppg
from wellspark.plans import files, streams
from wellspark.plans.nutrition import foods_of
from wellspark.streaming import jobs


@pytest.fixture()
def not_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _one_key(spark, days=40, a_day=25):
    """One key and, of another, too few starts; the first and the last sample are its only zeros."""
    last = days * a_day - 1
    t0 = dt.datetime(2024, 1, 1)
    rows = [(7, t0 + dt.timedelta(days=i // a_day, seconds=i % a_day), i, i in (0, last)) for i in range(last + 1)]
    rows += [(8, t0, -1, True), (8, t0 + dt.timedelta(days=1), -2, False)]
    return spark.createDataFrame(rows, "k int, ts timestamp, i int, z boolean"), last


def _tasks(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().count()


def test_rows_of_one_key_meet_its_bounds_in_several_tasks(spark, not_adaptive):
    df, last = _one_key(spark)
    seg = ppg.last_segment(df, ["k"], ["ts", "i"], F.col("z"), closing_flag="closing")
    assert sorted((r.k, r.i, r.closing) for r in seg.collect()) == [(7, i, i == last) for i in range(last + 1)]
    assert _tasks(seg) > 1


def test_rows_of_one_key_meet_its_first_time_in_several_tasks(spark, not_adaptive):
    df, last = _one_key(spark)
    df = df.unionByName(df.where("k = 7 AND i = 5").withColumn("ts", F.lit(None).cast("timestamp")))
    cut = ppg.time_chunks(df, ["k"], "ts", seconds=86_400)
    assert _tasks(cut.where("k = 7")) > 1
    got = sorted((r.k, r.i, -1 if r.chunk_id is None else r.chunk_id) for r in cut.collect())
    assert got == sorted([(7, i, i // 25) for i in range(last + 1)] + [(7, 5, -1), (8, -1, 0), (8, -2, 1)])


def test_documents_of_meals_are_written_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    """Orders of up to seven lines, a line number that occurs twice, null keys and a null line number."""
    rows = [(o, n, dt.datetime(2024, 1, 1), float(o + n), 10.0 * o, 0.05, 0.02) for o in range(1, 401) for n in range(1, o % 7 + 2)]
    rows += [rows[0], (None, 1, None, 3.0, 70.0, 0.1, 0.0), (None, 9, None, 4.0, None, 0.1, 0.0), (5, None, None, 1.0, 2.0, 0.0, 0.0)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate timestamp, l_quantity double, "
                                        "l_extendedprice double, l_discount double, l_tax double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = f"{tmp_path}/docs"
    monkeypatch.setattr(files, "_folder", lambda spark, name: folder)
    monkeypatch.setattr(files, "DOCS_PER_FILE", 20, raising=False)

    got = {r.log: r for r in files.files_nutrition(spark, str(tmp_path)).collect()}
    totals = foods_of(lines).groupBy(F.concat(F.lit("order "), "l_orderkey").alias("log")).agg(
        F.count(F.lit(1)).alias("n_foods"), *[round2(F.sum(F.coalesce(f, F.lit(0.0)))).alias(n) for n, f in nu.NUTRIENT_FIELDS.items()])
    want = {r.log: r for r in totals.collect()}
    assert got.keys() == want.keys() and None in got
    for log, r in want.items():
        assert got[log].n_foods == r.n_foods
        assert all(abs(got[log][n] - r[n]) < 0.011 for n in nu.NUTRIENT_FIELDS)

    parts = glob.glob(f"{folder}/part-*")
    text = [r.value for r in spark.read.text(folder).collect()]
    assert len(parts) >= len(text) / 20
    assert sum(os.path.getsize(p) for p in parts) < sum(map(len, text)) / 2


def test_daily_nutrients_end_with_the_last_batch_of_data(spark, tmp_path, monkeypatch):
    rows = [(o, n, dt.datetime(2024, 1, 1 + 5 * (o % 5)), float(o + n), 10.0 * o, 0.05, 0.02) for o in range(1, 60) for n in (1, 2)]
    rows += [rows[0], (None, 1, dt.datetime(2024, 1, 2), 1.0, 1.0, 0.0, 0.0)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_quantity double, "
                                        "l_extendedprice double, l_discount double, l_tax double")
    orders = spark.createDataFrame([(o, o % 7) for o in range(1, 50)] + [(3, 3)], "o_orderkey long, o_custkey long")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(jobs, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")

    got = {(r.o_custkey, r.day): r for r in streams.stream_daily_nutrients(spark, str(tmp_path)).collect()}
    f = foods_of(lines).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    want = f.groupBy("o_custkey", F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n_foods"), *[F.sum(F.coalesce(f, F.lit(0.0))).alias(n) for n, f in nu.NUTRIENT_FIELDS.items()]).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r.o_custkey, r.day]
        assert g.n_foods == r.n_foods and all(abs(g[n] - r[n]) < 0.011 for n in nu.NUTRIENT_FIELDS)
    assert len(glob.glob(f"{tmp_path}/streams/*/checkpoint/commits/[0-9]*")) == 1


def test_the_latest_batch_counts_whole_nulls_too(spark, tmp_path):
    for i, v in enumerate((1.0, None)):
        spark.createDataFrame([("a", v), (f"b{i}", 2.0)], "k string, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = stream.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) == 1, F.max("v")).alias("once"))
    got = jobs.run_to_table(spark, found, "latest", group_keys=["k"], evict_at_end=False)
    assert sorted((r.k, r.n, r.once) for r in got.collect()) == [("a", 2, None), ("b0", 1, 2.0), ("b1", 1, 2.0)]


def test_risk_texts_generate_no_method_too_long_to_compile(spark, capsys):
    values = ", ".join(f"{n} double" for n in nu.NUTRIENT_FIELDS)
    nu.risk_rules(spark.createDataFrame([(1.0,) * len(nu.NUTRIENT_FIELDS)], values)).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert all(n < 8000 for n in sizes)
