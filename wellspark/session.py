"""Spark session settings shared by tests, the bench and the operators.

Nothing here is specific to local mode except the checkpoint folder of a local session that names none; a cluster
session without ``spark.checkpoint.dir`` raises.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every plan relies on: UTC for timestamp arithmetic (DuckDB oracle is zone-less); no broadcast
# decided from *estimated* sizes (an exploded or derived side can be estimated far too small), instead AQE
# turns a shuffle join into a broadcast only after measuring the side's real shuffle output (below 32 MB),
# splits skewed partitions otherwise; explicit broadcast() remains for fixed-size dimensions only; Arrow for
# the few Python stages. Streaming state lives in RocksDB (off-heap, spills to local disk, changelog
# checkpoints to the shared checkpoint folder) rather than in executor heap maps, so large keyed state (all
# customer-days, all open sessions) does not bound executor memory.
BASE_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(
    app: str = "wellspark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    ``master`` is only set when given (tests pass ``local[*]``; on a cluster spark-submit decides).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables, as a whole URI.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a local session (tests) gets a fresh folder
    under the system temp dir; a cluster session raises, because a machine-local folder is not visible to the other
    machines.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="wellspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for written intermediate tables and sink output."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, through Spark's own file system classes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch_path` named, through Spark's own file system classes."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_table(df, name: str = "intermediate") -> str:
    """Write ``df`` as a Parquet table of its own under the shared checkpoint folder; the table's path."""
    import uuid

    path = scratch_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df, name: str = "intermediate"):
    """Cut the lineage of an intermediate result: write it as a Parquet table under the shared checkpoint folder
    (reliable storage, survives executor loss) and continue from the written table.

    Used where a multi-pass operator reads its input more than once and that input is itself the output of such
    operators: without the cut, every pass would recompute the whole upstream chain. Parquet keeps the write
    columnar and lets later passes read only the columns they need. The table is read with the schema of ``df``, so
    no file is opened to infer it. The folder lives as long as the checkpoint folder, since the lazy result still
    reads it.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))
