"""The bucketed ordered operators equal plain whole-key windows, including a key holding most rows."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from wellspark.operators.ordered import lag_across_buckets, lead_across_buckets, row_number_across_buckets


def _data(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        user = 0 if rnd.random() < 0.6 else rnd.randint(1, 20)  # hot key: ~60 % of rows
        ts = base + dt.timedelta(seconds=rnd.randint(0, 40 * 86400))
        rows.append((i, user, ts, rnd.random()))
    return spark.createDataFrame(rows, "id long, user int, ts timestamp, v double")


def test_lag_and_row_number_equal_plain_window(spark):
    df = _data(spark)
    w = Window.partitionBy("user").orderBy("ts", "id")
    plain = df.select("id", F.lag("v").over(w).alias("p"), F.row_number().over(w).alias("rn"),
                      F.lead("v").over(w).alias("nx"))
    got = lag_across_buckets(df, ["user"], ["ts", "id"], "v", "p")
    got = row_number_across_buckets(got, ["user"], ["ts", "id"], "rn")
    got = lead_across_buckets(got, ["user"], ["ts", "id"], ["v"], prefix="nx_")
    a = {r.id: (r.p, r.rn, r.nx) for r in plain.collect()}
    b = {r.id: (r.p, r.rn, r.nx_v) for r in got.select("id", "p", "rn", "nx_v").collect()}
    assert a == b


def test_custom_bucket(spark):
    df = _data(spark, 500)
    w = Window.partitionBy("user").orderBy("ts", "id")
    plain = {r.id: r.rn for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    got = row_number_across_buckets(df, ["user"], ["ts", "id"], "rn", bucket=F.date_trunc("hour", "ts"))
    assert {r.id: r.rn for r in got.collect()} == plain


def test_lowest_sliding_mean_equals_whole_night_window(spark):
    from wellspark.operators.derived import LOWEST_HR_WINDOW_US, lowest_sliding_mean

    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = [(0 if rnd.random() < 0.7 else 1, base + dt.timedelta(seconds=rnd.randint(0, 2 * 86400)), rnd.random() * 100)
            for _ in range(4000)]
    df = spark.createDataFrame(rows, "user int, ts timestamp, v double")
    us = F.unix_micros("ts")
    w = Window.partitionBy("user", F.to_date("ts")).orderBy(us).rangeBetween(-(LOWEST_HR_WINDOW_US - 1), 0)
    plain = (df.withColumn("a", F.avg("v").over(w)).groupBy("user", F.to_date("ts").alias("night"))
             .agg(F.min("a").alias("m")))
    got = lowest_sliding_mean(df, ["user"], F.to_date("ts"), "ts", "v")
    a = {(r.user, r.night): round(r.m, 9) for r in plain.collect()}
    b = {(r.user, r.night): round(r.lowest_5min_avg, 9) for r in got.collect()}
    assert a == b


def test_last_segment_equals_plain_windows(spark):
    """W1/W2 with the bucketed passes and the two-level top-2 equal the plain whole-key formulation."""
    from wellspark.operators import ppg

    df = _data(spark, 4000, seed=5).withColumn("z", F.col("v") < 0.3)
    w = Window.partitionBy("user").orderBy("ts", "id")
    m = df.withColumn("start", F.col("z") & F.coalesce(~F.lag("z").over(w), F.lit(True)))
    rk = Window.partitionBy("user").orderBy(F.col("ts").desc(), F.col("id").desc())
    s = m.where("start").withColumn("k", F.row_number().over(rk))
    b = s.groupBy("user").agg(
        F.max(F.when(F.col("k") == 1, F.struct("ts", "id"))).alias("last"),
        F.max(F.when(F.col("k") == 2, F.struct("ts", "id"))).alias("sec"),
    ).where(F.col("sec").isNotNull())
    pos = F.struct("ts", "id")
    plain = m.join(b, "user").where((pos >= F.col("sec")) & (pos <= F.col("last")))
    expected = {(r.id, r.closing) for r in plain.select("id", (pos == F.col("last")).alias("closing")).collect()}
    for bucket in (None, F.date_trunc("hour", "ts")):
        got = ppg.last_segment(df, ["user"], ["ts", "id"], F.col("z"), bucket=bucket, closing_flag="closing")
        assert {(r.id, r.closing) for r in got.select("id", "closing").collect()} == expected
    assert len(expected) > 0


def test_null_order_timestamps_numbered_like_plain_window(spark):
    """Rows with a NULL order timestamp (NULL day bucket) come first in a plain window; the bucketed operators
    keep and number them the same way."""
    df = _data(spark, 800, seed=9).withColumn("ts", F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("ts")))
    w = Window.partitionBy("user").orderBy("ts", "id")
    plain = {r.id: (r.rn, r.p) for r in df.select("id", F.row_number().over(w).alias("rn"),
                                                    F.lag("v").over(w).alias("p")).collect()}
    got = row_number_across_buckets(df, ["user"], ["ts", "id"], "rn")
    got = lag_across_buckets(got, ["user"], ["ts", "id"], "v", "p")
    assert {r.id: (r.rn, r.p) for r in got.select("id", "rn", "p").collect()} == plain
