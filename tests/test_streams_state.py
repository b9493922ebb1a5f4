"""Streams over several files and micro-batches: rows out of order, equal and missing times, NULL keys, open groups."""

import datetime as dt
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspark.operators import ppg
from wellspark.plans import all_queries
from wellspark.plans.streams import stream_zero_runs
from wellspark.session import scratch_path
from wellspark.streaming import jobs
from wellspark.streaming.zero_runs import OPEN, ROW, walk, zero_run_sessions

from conftest import SF_SMALL

START = dt.datetime(2024, 3, 1, 12)
SCHEMA = "k string, ts timestamp, id long, hr double, v double"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def streamed(spark, batches):
    """A file stream that takes one file per micro-batch, in the order of ``batches``."""
    path = scratch_path(spark, f"test-streams/{uuid.uuid4().hex[:12]}")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option(
        "maxFilesPerTrigger", 1).parquet(path)


# rows of the second and third file lie between those of the first, within the delay
ROWS = [("a", at(0), 1, 0.0, 1.0), ("a", at(10), 2, 0.0, 2.0), ("a", at(20), 3, 70.0, 4.0), ("a", at(60), 6, 0.0, 8.0),
        ("a", at(60), 7, 71.0, 16.0), ("a", at(60), 8, 0.0, None), ("a", at(90), 9, 72.0, 32.0),
        ("b", at(5), 11, 70.0, 1.0), ("b", at(6), 12, 0.0, 1.0), ("b", at(7), 13, 0.0, 1.0),
        (None, at(1), 21, 0.0, 3.0), (None, at(2), 22, 50.0, 3.0), (None, at(3), 23, 0.0, 3.0),
        ("c", None, 31, 0.0, 1.0), ("c", at(4), 32, None, 1.0)]
BATCHES = [[ROWS[i] for i in (0, 3, 7, 10, 13)], [ROWS[i] for i in (2, 5, 8, 12, 14)], [ROWS[i] for i in (1, 4, 6, 9, 11)]]


def sessions_of(rows):
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[2]))
        zero = [r[3] == 0 for r in mine]
        starts = [i for i, z in enumerate(zero) if z and (i == 0 or not zero[i - 1])]
        for i, j in zip(starts, starts[1:]):
            out.append((key, mine[i][1], mine[i][2], mine[j][1], mine[j][2], j - i + 1,
                        sum(r[4] or 0 for r in mine[i : j + 1])))
    return sorted(out, key=str)


def test_zero_run_sessions_across_micro_batches(spark):
    stream = streamed(spark, BATCHES)
    got = jobs.run_closed(spark, stream, "ts", lambda s: zero_run_sessions(
        s, [jobs.MARK, "k"], "ts", "id", F.col("hr") == 0, "v", delay="10 minutes"), "test")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sessions_of(ROWS)


def test_zero_run_sessions_end_where_the_batch_rule_ends(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    last = ppg.last_segment(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    w = last.groupBy("user_id").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("a"), F.max_by("event_id", F.struct("ts", "event_id")).alias("b"),
        F.count("*").alias("n"))
    want = {r.user_id: (r.a, r.b, r.n) for r in w.collect()}
    got = {}
    for r in sorted(stream_zero_runs(spark, SF_SMALL).collect(), key=lambda r: (r.session_end, r.end_event)):
        got[r.user_id] = (r.start_event, r.end_event, r.n_events)
    assert got == want and len(got) > 5


def test_walk_in_pieces_equals_walk_at_once():
    rng = np.random.default_rng(3)
    rows = np.zeros(200, ROW)
    rows["us"], rows["zero"], rows["value"] = np.arange(200), rng.random(200) < 0.4, rng.integers(0, 9, 200)
    nothing = (False, None, None, 0, 0.0)
    assert len(OPEN.split(",")) == len(nothing)
    whole, end = walk(rows, nothing)
    for cut in (0, 1, 57, 199, 200):
        first, carried = walk(rows[:cut], nothing)
        second, carried = walk(rows[cut:], carried)
        assert first + second == whole and carried == end


def test_sessions_are_emitted_when_they_close_and_the_open_ones_at_the_end(spark):
    rows = [("a", at(s), i, 1.0, 1.0) for i, s in enumerate((0, 100, 5000, 5100, 20000))]
    stream = streamed(spark, [[rows[0], rows[2]], [rows[1], rows[3]], [rows[4]]])
    seen = jobs.sessions(stream.withColumn(jobs.MARK, F.lit(False)), [jobs.MARK, "k"], "ts", gap="10 minutes", delay="3 hours")
    early = jobs.run_to_table(spark, seen, "test")  # without end marks the open sessions stay in state
    assert [(r.session_start, r.n) for r in early.orderBy("session_start").collect()] == [(at(0), 2), (at(5000), 2)]
    got = jobs.run_closed(spark, stream, "ts", lambda s: jobs.sessions(
        s, [jobs.MARK, "k"], "ts", gap="10 minutes", delay="3 hours"), "test")
    assert [(r.session_start, r.session_end, r.n) for r in got.orderBy("session_start").collect()] == [
        (at(0), at(700), 2), (at(5000), at(5700), 2), (at(20000), at(20600), 1)]


def test_interval_metrics_of_late_and_equal_times(spark):
    times = [0.0, 0.8, 1.65, 1.65, 2.4, 3.35, 4.1234567]
    rows = [("a", at(s), i, 1.0, 1.0) for i, s in enumerate(times)] + [("b", at(3), 9, 1.0, 1.0), (None, at(1), 10, 1.0, None)]
    stream = streamed(spark, [[rows[i] for i in (4, 0, 6, 7)], [rows[i] for i in (2, 5, 8)], [rows[i] for i in (1, 3)]])
    out = jobs.run_to_table(spark, jobs.windowed_stats(stream, ["k"], "ts", "v"), "test", group_keys=["k", "window_start"])
    got = {r.k: r for r in out.collect()}
    us = np.array([round(t * 1e6) for t in times])
    rr = np.floor(np.diff(us) / 1000)
    d = np.diff(rr)
    a = got["a"]
    assert a.n == 7 and a.sdnn_ms == pytest.approx(rr.std(ddof=1)) and a.rmssd_ms == pytest.approx(math.sqrt((d * d).mean()))
    assert a.pnn50 == pytest.approx(100 * (np.abs(d) > 50).sum() / len(rr))
    assert (got["b"].n, got["b"].sdnn_ms, got["b"].rmssd_ms, got["b"].pnn50) == (1, None, None, None)
    assert got[None].n == 1 and got[None].sum_value is None


def test_stream_queries_are_registered():
    assert {"stream_zero_runs", "stream_window_day", "stream_sessions"} <= set(all_queries())
