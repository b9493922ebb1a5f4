"""Exact deduplication against a persistent digest index.

The index is a table of digests in generations, one per append, each bucketed and sorted by digest with one file per
bucket. A batch of documents is reduced to one row per digest (map-side pre-aggregated, so a text that a third of all
rows share costs one row per task) and meets the generations in sort-merge joins: the batch is shuffled and sorted once,
the generations are read bucket by bucket and are neither shuffled nor sorted. Digests that none has are appended as a
new generation; when there are too many, all are merged into one.

Every digest carries the batch that brought it, by default a checksum of the batch's rows. Digests of the same batch do
not count as seen, so a batch that is run again after a lost job gives the same result, and adds nothing twice.

Everything is DataFrame operations; the text is hashed in the scan and never shuffled.

Edge cases: a null text equals an empty one. A null id ranks below every other id. Rows that repeat an id with an equal
text are one document (one result row, counted in ``group_size``). Extra columns are ignored whatever their names. An
empty table gives an empty result and leaves the index as it was.
"""

from __future__ import annotations

import functools
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.session import drop_path, materialize, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of one byte per character is plain ASCII, for which ``lower`` is the same."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of the normalised text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "utf-8"), 256))


ROWS_PER_BUCKET = 2_000_000  # some 100 MB of digests
MOST_GENERATIONS = 6
COLUMNS = "digest BINARY, first_id BIGINT, batch STRING"


def buckets_for(rows: int) -> int:
    """Buckets (a power of two) for an index that starts with ``rows`` digests and may grow to some four times as many
    before a bucket is large."""
    return max(8, 1 << (4 * rows // ROWS_PER_BUCKET).bit_length())


@contextmanager
def sorted_bucket_scans(spark: SparkSession):
    """Let scans of bucketed tables with one sorted file per bucket report that order, while plans are run inside."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class DigestIndex:
    """A persistent index of (digest binary, first_id long, batch string) in generations of bucketed, sorted tables.

    ``path`` names the first generation's folder; the others are beside it (``path.g1``, ...). Opening existing folders
    again (in a later session) registers them under ``table`` and ``table_g1``, ... with the same layout. ``buckets`` is
    fixed when the index is made, see :func:`buckets_for`.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = 64):
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets
        self.register(0)
        self.generations = [0, *self.later()]
        for g in self.generations[1:]:
            self.register(g)

    def later(self) -> list[int]:
        """The numbers of the written generations after the first."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}.g*/_SUCCESS")
        files = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(int(f.getPath().getParent().getName().rpartition(".g")[2]) for f in files)

    def folder(self, generation: int) -> str:
        return self.path if generation == 0 else f"{self.path}.g{generation}"

    def name(self, generation: int) -> str:
        return self.table if generation == 0 else f"{self.table}_g{generation}"

    def register(self, generation: int) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name(generation)} ({COLUMNS}) USING parquet CLUSTERED BY (digest) "
            f"SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder(generation)}'")

    def read(self) -> DataFrame:
        found = [self.spark.table(self.name(g)) for g in self.generations]
        return functools.reduce(DataFrame.unionByName, found)

    def found(self, groups: DataFrame) -> DataFrame:
        """``groups`` (unique by ``digest``) with ``seen_id`` and ``seen_batch`` of their digests, NULL where the index
        has none. Run it inside :func:`sorted_bucket_scans`."""
        rows = groups.repartition(self.buckets, "digest").withColumns(
            {"seen_id": F.lit(None).cast("long"), "seen_batch": F.lit(None).cast("string")})
        for g in self.generations:
            side = self.spark.table(self.name(g)).select(
                "digest", F.col("first_id").alias("id__"), F.col("batch").alias("batch__"))
            rows = rows.join(side.hint("merge"), "digest", "left").withColumns(
                {"seen_id": F.coalesce("seen_id", "id__"), "seen_batch": F.coalesce("seen_batch", "batch__")}
            ).drop("id__", "batch__")
        return rows

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` (unique by ``digest``) whose digest is not in the index."""
        return self.found(groups).where("seen_batch IS NULL").drop("seen_id", "seen_batch")

    def append(self, rows: DataFrame, batch: str = "") -> None:
        """Add (digest, first_id) rows that the index does not have as a generation of their own, one sorted file per
        bucket; nothing to add adds nothing. Too many generations are merged into one."""
        rows = rows.select("digest", "first_id", F.lit(batch).alias("batch"))
        if rows.isEmpty():
            return
        if len(self.generations) == 1 and self.read().isEmpty():
            self.write(rows, 0)
            return
        self.write(rows, self.generations[-1] + 1)
        if len(self.generations) > MOST_GENERATIONS:
            self.merge()

    def write(self, rows: DataFrame, generation: int) -> None:
        if generation:  # what a lost append has left
            self.drop(generation)
        (rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest")
         .format("parquet").option("path", self.folder(generation)).mode("append").saveAsTable(self.name(generation)))
        self.spark.catalog.refreshTable(self.name(generation))
        if generation not in self.generations:
            self.generations.append(generation)

    def drop(self, generation: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(generation)}")
        drop_path(self.spark, self.folder(generation))

    def merge(self) -> None:
        """All generations after the first as a new one, then without the old ones. If this is lost half-way, digests
        are in two generations and the joins take the first one's."""
        old = self.generations[1:]
        later = [self.spark.table(self.name(g)) for g in old]
        rows = functools.reduce(DataFrame.unionByName, later).groupBy("digest").agg(
            F.min(F.struct("first_id", "batch")).alias("v")).select("digest", "v.first_id", "v.batch")
        self.write(rows, old[-1] + 1)
        for g in old:
            self.drop(g)
        self.generations = [0, old[-1] + 1]

def batch_of(hashed: DataFrame) -> str:
    """A checksum of a batch's rows: the same for the same rows in any order."""
    row = hashed.agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "digest").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text",
          batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, seen_before, kept.

    Of equal texts in this batch the row with the largest id stays, unless an earlier batch brought the text (then none
    does, and ``keep_id`` is the indexed document). The digests of the batch are in the index afterwards. ``batch``
    names the batch; unnamed ones go by the checksum of their rows.
    """
    spark = docs.sparkSession
    hashed = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                     text_digest(F.col(text_col)).alias("digest")), "digests")
    batch = batch_of(hashed) if batch is None else batch
    groups = hashed.groupBy("digest").agg(F.max("doc_id").alias("first_id"), F.count("*").alias("group_size"))
    with sorted_bucket_scans(spark):
        found = materialize(index.found(groups), "found")  # read before the append
        index.append(found.where("seen_batch IS NULL"), batch)
    seen = F.col("seen_batch").isNotNull() & (F.col("seen_batch") != batch)
    verdicts = found.select("digest", F.when(seen, F.col("seen_id")).otherwise(F.col("first_id")).alias("keep_id"),
                            "group_size", seen.alias("seen_before"))
    # a text that many rows share is a skewed join key: adaptive execution splits it on the documents' side
    single = hashed.groupBy("doc_id", "digest").agg(F.lit(1).alias("one")).drop("one")
    return (single.join(verdicts.hint("merge"), "digest")
            .withColumn("kept", ~F.col("seen_before") & F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def new_index(spark: SparkSession, buckets: int = 8) -> DigestIndex:
    """An empty index of its own in the shared scratch folder."""
    name = f"digest_index_{uuid.uuid4().hex[:12]}"
    return DigestIndex(spark, name, scratch_path(spark, f"index/{name}"), buckets)


def keep_first_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`dedup` keeps, with their own columns; repeated rows of a kept document stay
    once."""
    verdicts = dedup(docs, index, id_col, text_col).where("kept")
    rows = docs.withColumn("digest__", text_digest(F.col(text_col)))
    mine = verdicts.select(F.col("doc_id").alias("id__"), F.col("digest").alias("d__"))
    kept = rows.join(mine, F.col(id_col).cast("long").eqNullSafe(F.col("id__")) & (F.col("digest__") == F.col("d__")),
                     "left_semi")
    return kept.dropDuplicates([id_col, "digest__"]).drop("digest__")
