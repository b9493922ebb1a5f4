"""Structured Streaming jobs (ST1-ST5).

* ``windowed_stats``  ST2: per-key tumbling windows (60 s = one 1200-sample chunk at 20 Hz) with a watermark.
* ``daily_totals``    ST3: running per-key daily sums, rules applied after aggregation by the caller.
* ``sessions``        ST4: ``session_window`` per key (inactivity gap); by zero runs in ``streaming.zero_runs``.
* ``dedup``           ST5: ``dropDuplicatesWithinWatermark`` on an event id.
* ``run_to_table``    drives any of them to completion with ``availableNow`` and a fault-tolerant sink:
                      aggregations are written per micro-batch in update mode (with the batch id), so the
                      latest version of every group is recovered by one grouped ``max_by`` when read back;
                      checkpoints and output live under the session's shared checkpoint folder.
* ``run_closed``      drives an append-mode job to completion and then closes what the watermark left open, so that
                      state holds open groups only and still no group is lost at the end of the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.session import BASE_CONF, scratch_path


def interval_metrics(times: Column) -> dict[str, Column]:
    """SDNN, RMSSD (ms) and pNN50 (percent) of the intervals between sorted times (microseconds).

    Intervals are whole milliseconds (W5); equal times are an interval of 0. Too few intervals give NULL.
    """
    pairs = F.greatest(F.size(times) - 1, F.lit(0))
    rr = F.zip_with(F.slice(times, 2, pairs), F.slice(times, F.lit(1), pairs),
                    lambda b, a: F.floor((b - a) / F.lit(1000)).cast("double"))

    def metric(rr: Column) -> Column:
        n = F.size(rr)
        total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
        later = F.greatest(n - 1, F.lit(0))
        d = F.zip_with(F.slice(rr, 2, later), F.slice(rr, F.lit(1), later), lambda b, a: b - a)
        mean = F.try_divide(total(rr, lambda x: x), n)
        spread = F.element_at(F.transform(F.array(mean), lambda m: total(rr, lambda x: (x - m) * (x - m))), 1)
        far = F.size(F.filter(d, lambda x: F.abs(x) > 50))
        return F.struct(
            F.when(n > 1, F.sqrt(spread / (n - 1))).alias("sdnn_ms"),
            F.when(n > 1, F.sqrt(total(d, lambda x: x * x) / (n - 1))).alias("rmssd_ms"),
            F.when(n > 0, F.lit(100.0) * far / n).alias("pnn50"))

    found = F.element_at(F.transform(F.array(rr), metric), 1)  # the intervals are computed once
    return {c: found[c] for c in ("sdnn_ms", "rmssd_ms", "pnn50")}


def windowed_stats(
    stream: DataFrame, keys: Sequence[str], ts: str, value: str, width: str = "60 seconds", delay: str = "10 minutes"
) -> DataFrame:
    """ST2: count, sum, mean, min and max of ``value``, the mean interval of the rows and the metrics of their intervals
    (SDNN, RMSSD, pNN50) per key and tumbling window.

    The times of a window are kept in its state, sorted when read: rows of any order within the watermark's delay and
    rows of equal time are in. A window holds rate times width of them (1,200 at 20 Hz and 60 s).
    """
    times = F.array_sort(F.collect_list(F.unix_micros(ts))).alias("times")
    stats = (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.window(F.col(ts), width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(value).alias("sum_value"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            F.avg(value).alias("mean_value"),
            F.try_divide((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(1000.0),
                         F.count(F.lit(1)) - 1).alias("mean_interval_ms"),
            times,
        )
    )
    return stats.withColumns(interval_metrics(F.col("times"))).select(
        *keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "sum_value",
        "min_value", "max_value", "mean_value", "mean_interval_ms", "sdnn_ms", "rmssd_ms", "pnn50")


def daily_totals(
    stream: DataFrame, keys: Sequence[str], ts: str, measures: dict[str, Column], delay: str = "1 day"
) -> DataFrame:
    """ST3: per key and calendar day (1-day tumbling window) running sums of the measures."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.window(F.col(ts), "1 day").alias("w"))
        .agg(*[F.sum(e).alias(n) for n, e in measures.items()])
        .withColumn("day_start", F.col("w.start"))
        .drop("w")
    )


def sessions(stream: DataFrame, keys: Sequence[str], ts: str, gap: str = "30 minutes", delay: str = "1 hour"):
    """ST4: recording sessions split by inactivity (``session_window``)."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.session_window(F.col(ts), gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
    )


def dedup(stream: DataFrame, id_cols: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """ST5: drop repeated events (same ids) arriving within the watermark delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(id_cols))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State in RocksDB for the queries that are started inside, whatever the session says: arbitrary keyed state needs
    it. A query keeps the settings that it was started with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    with session_setting(spark, key, BASE_CONF[key]):
        yield


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for the queries that are started inside; the session's own comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


MARK = "is_end_mark"
END_OF_TIME = "2200-01-01 00:00:00"  # within the nanosecond times of pandas, which keyed state reads


def run_closed(
    spark: SparkSession, stream: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], name: str
) -> DataFrame:
    """Run ``build(stream)``, an append-mode job that groups by :data:`MARK` besides its keys, over everything available
    and return its rows as a batch table, those still open at the end of the input included.

    The job reads the stream together with a folder of end marks, empty at first. When the input is used up, one mark
    at the end of time is written there and the query goes on from its checkpoint: the watermark passes every row, all
    groups close and are emitted, each once. A stream that goes on later simply leaves the mark out. Marks are a group
    of their own, which never closes. A run that is lost goes on from its checkpoint in the same way.
    """
    run = f"{name}-{uuid.uuid4().hex[:12]}"
    out_path, marks_path, ckpt = (scratch_path(spark, f"streams/{run}/{p}") for p in ("out", "marks", "checkpoint"))
    schema = stream.withColumn(MARK, F.lit(False)).schema
    spark.createDataFrame([], schema).write.parquet(marks_path)
    marks = spark.readStream.schema(schema).parquet(marks_path)
    found = build(stream.withColumn(MARK, F.lit(False)).unionByName(marks))

    def go_on() -> None:
        with rocksdb_state(spark):
            query = found.writeStream.format("parquet").outputMode("append").option("path", out_path).option(
                "checkpointLocation", ckpt).trigger(availableNow=True).start()
        query.awaitTermination()

    go_on()
    mark = [F.lit(END_OF_TIME).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(True).alias(MARK)
            if f.name == MARK else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*mark).write.mode("append").parquet(marks_path)
    go_on()
    return spark.read.schema(found.schema).parquet(out_path).where(~F.col(MARK)).drop(MARK)


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_to_table(
    spark: SparkSession, query_df: DataFrame, name: str, group_keys: Sequence[str] | None = None,
    mode: str = "update", evict_at_end: bool = True,
) -> DataFrame:
    """Run a streaming DataFrame over everything available now and return its final result as a batch table.

    Waits until the query has processed all its input; a failed query raises.

    ``group_keys`` given (aggregations): update mode through ``foreachBatch``; every batch writes its updated rows
    to a folder of its own (a retried batch overwrites it); the final value per group is the row of the latest batch.
    ``group_keys`` None (append-only streams): file sink in append mode.
    ``mode="complete"``: every batch writes the whole result and the last batch is kept; all groups stay in state, so
    this suits replays of bounded inputs only. Sessions run in append mode (:func:`run_closed`).
    ``evict_at_end`` False leaves out the batch without data that follows the last one: of an aggregation in update mode
    it emits nothing, and only clears the groups that the watermark passed, over the whole state and its upstream joins.
    A run that goes on from the checkpoint clears them in its first batch.
    """
    run = f"{name}-{uuid.uuid4().hex[:12]}"
    out_path = scratch_path(spark, f"streams/{run}/out")
    ckpt = scratch_path(spark, f"streams/{run}/checkpoint")
    if group_keys is None:
        q = (
            query_df.writeStream.format("parquet").outputMode("append").option("path", out_path)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return spark.read.schema(query_df.schema).parquet(out_path)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/stream_batch={batch_id}")

    closing = spark.conf.get(NO_DATA_BATCHES) if evict_at_end else "false"
    with session_setting(spark, NO_DATA_BATCHES, closing):
        q = (
            query_df.writeStream.outputMode(mode).foreachBatch(write_batch)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        )
    q.awaitTermination()
    written = spark.read.schema(query_df.schema.add("stream_batch", "long")).parquet(out_path)
    if mode == "complete":
        last = written.agg(F.max("stream_batch").alias("stream_batch"))
        return written.join(F.broadcast(last), "stream_batch").drop("stream_batch")  # one-row side
    cols = [c for c in written.columns if c not in group_keys and c != "stream_batch"]
    # a batch holds a group once, so all columns come from one row; plain columns are aggregated by hash, a struct by sorting
    return written.groupBy(*group_keys).agg(*[F.max_by(c, "stream_batch").alias(c) for c in cols])
