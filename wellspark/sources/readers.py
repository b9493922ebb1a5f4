"""Scans (S1-S9, ST1 sources): CSV trees with keys from the path, nested JSON, line text, binary files.

Layout of the wearable files: ``<root>/<user_id>/<device>/<file>.csv``, or the tree that ``sinks.write_device_tree``
writes, ``<root>/user_id=<id>/device=<device>/file=<file>.csv/part-*``. One scan reads every participant; the user id
and device come from ``_metadata.file_path``, so selecting participants is a filter (and partition pruning once the
data is rewritten as Parquet partitioned by ``user_id``/``date``).
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.functions.numeric import round2
from wellspark.operators import selecting as sel
from wellspark.sources import schemas as S

PATH_KEYS = r".*/(?:user_id=)?([^/]+)/(?:device=)?([^/]+)/[^/]+$"
PART_FOLDER = r"/file=[^/]*(/[^/]*)$"
ROWS_OF_TASK = (1 << 33) - 1  # the bits of monotonically_increasing_id that count a task's rows


def _csv(spark: SparkSession, schema: T.StructType, path, streaming: bool = False):
    reader = spark.readStream if streaming else spark.read
    return (
        reader.schema(schema)
        .option("header", "true")
        .option("escape", '"')  # a quote inside a value is doubled, as pandas and most writers do
        .option("nullValue", S.MISSING)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def _csv_by_name(spark: SparkSession, path, keep: Sequence[str], types: T.StructType, streaming: bool = False):
    """Read CSV files whose header carries more columns than needed; keep ``keep`` by name (like ``usecols``) and
    cast them to the declared types. All columns are read as text first (the header of the first file gives the
    names; ``enforceSchema=false`` makes every other file's header be checked against it, so a file with a
    different column order fails instead of being silently mis-mapped)."""
    if not streaming and not _found(spark, path):  # nobody has such a file: no rows
        fields = [T.StructField(c, types[c].dataType if c in types.names else T.StringType()) for c in keep]
        place = T.StructType([T.StructField("file_path", T.StringType())])
        return spark.createDataFrame([], T.StructType([T.StructField("_metadata", place), *fields]))
    header = spark.read.option("header", "true").csv(path).schema.fieldNames()
    missing = [c for c in keep if c not in header]
    if missing:
        raise ValueError(f"columns {missing} not in CSV header {header}")
    reader = spark.readStream if streaming else spark.read
    df = (
        reader.schema(S.all_string(header))
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("escape", '"')
        .option("nullValue", S.MISSING)
        .csv(path)
    )
    casts = {f.name: f.dataType for f in types.fields}
    return df.select(
        "_metadata", *[F.nullif(F.col(c), F.lit("")).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in keep]
    )


def _with_path_keys(df: DataFrame) -> DataFrame:
    p = F.regexp_replace(F.col("_metadata.file_path"), PART_FOLDER, "$1")
    return df.withColumns(
        {"user_id": F.regexp_extract(p, PATH_KEYS, 1), "device": F.regexp_extract(p, PATH_KEYS, 2)}
    )


def _found(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path pattern."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern))


def _rounded(df: DataFrame) -> DataFrame:
    """Fractions to two decimals, as the reference's get tasks return them."""
    return df.withColumns({f.name: round2(f.name) for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def _device_glob(root: str, device: str, file_name: str, users: Sequence[str] | None) -> str:
    """One pattern for all asked participants; one without a file gives no rows (a plain list of paths would fail)."""
    if users:
        names = [re.sub(r"([\\*?\[\]{},])", r"\\\1", u.strip()) for u in users]
        names = [form + n for n in names for form in ("", "user_id=")]
    else:
        names = ["*"]
    forms = (names, [device, f"device={device}"], [file_name, f"file={file_name}"])
    return os.path.join(root, *["{" + ",".join(f) + "}" if len(f) > 1 else f[0] for f in forms])


def read_daily_sleep(
    spark: SparkSession, root: str = S.DEFAULT_DATA_DIR, users: Sequence[str] | None = None, streaming: bool = False
) -> DataFrame:
    """Kept sleep columns renamed, seven durations in minutes, ``date`` as DateType, plus user/device keys."""
    path = _device_glob(root, S.SLEEP_DEVICE, S.SLEEP_FILE, users)
    raw = _csv_by_name(spark, path, S.SLEEP_RAW, S.SLEEP_RAW_SCHEMA, streaming)
    df = _with_path_keys(raw).select("user_id", "device", *S.SLEEP_RAW)
    df = df.toDF("user_id", "device", *S.SLEEP_NAMES).withColumn("date", sel.parse_day("date"))
    return _rounded(sel.seconds_to_minutes(df, S.SLEEP_SECONDS))


def read_daily_activity(
    spark: SparkSession, root: str = S.DEFAULT_DATA_DIR, users: Sequence[str] | None = None, streaming: bool = False
) -> DataFrame:
    """Kept activity columns renamed (names as in the reference), ``date`` as DateType."""
    path = _device_glob(root, S.ACTIVITY_DEVICE, S.ACTIVITY_FILE, users)
    raw = _csv_by_name(spark, path, S.ACTIVITY_RAW, S.ACTIVITY_RAW_SCHEMA, streaming)
    df = _with_path_keys(raw).select("user_id", "device", *S.ACTIVITY_RAW)
    return _rounded(df.toDF("user_id", "device", *S.ACTIVITY_NAMES).withColumn("date", sel.parse_day("date")))


def read_ppg(
    spark: SparkSession, root: str = S.DEFAULT_DATA_DIR, users: Sequence[str] | None = None, streaming: bool = False
) -> DataFrame:
    """S3: PPG samples; ``date`` = epoch-ms ``timestamp`` as a timestamp; ``sample_no`` keeps file order (Q25).

    A file is read in splits, which tasks take in any order. A sample's number is its split's first byte plus its place
    in the task: a line has several bytes, so the numbers of a split end before the next split's first byte.
    """
    raw = _csv_by_name(spark, _device_glob(root, S.PPG_DEVICE, S.PPG_FILE, users), S.PPG_RAW, S.PPG_RAW_SCHEMA,
                       streaming)
    df = _with_path_keys(raw)
    if not streaming:
        row = F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS_OF_TASK))
        place = F.col("_metadata.file_block_start") if "file_block_start" in df.select("_metadata.*").columns else F.lit(0)
        df = df.withColumn("sample_no", place + row)
    df = df.withColumn("date", sel.parse_epoch_ms("timestamp")).drop("timestamp")
    return _rounded(df.select("user_id", "device", "date", "ppg", "hr", *(["sample_no"] if not streaming else [])))


def read_string_table(spark: SparkSession, path: str) -> DataFrame:
    """A dataset table with every column read as text (header decides the names); ``NA`` and empty
    unquoted fields are NULL, quoted ``""`` becomes NULL via ``nullif``."""
    header = spark.read.option("header", "true").csv(path).schema.fieldNames()
    df = _csv(spark, S.all_string(header), path)
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in header})


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    """Participant information, all strings, plus a typed view of the numeric columns."""
    df = read_string_table(spark, path)
    typed = {c: F.col(c).try_cast("double") for c in ("usual_weight_kg", "weight_5years_kg", "height_cm",
                                                       "intervention_diet_kcal") if c in df.columns}
    return df.withColumns({f"{c}_num": e for c, e in typed.items()})


def read_sleep_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``<id>_additional_sleep_data.csv`` of a folder, all strings, ``id`` from the file name."""
    path = os.path.join(folder, f"*{S.SLEEP_DATASET_SUFFIX}.csv")
    if not _found(spark, path):  # nobody has such a file: no rows
        return spark.createDataFrame([], S.all_string(("sleep_id", "start_time", "id")))
    df = read_string_table(spark, path)
    name = rf"/(?:file=)?([^/]*){S.SLEEP_DATASET_SUFFIX}\.csv(?:/[^/]*)?$"
    return df.withColumn("id", F.regexp_extract(F.col("_metadata.file_path"), name, 1))


def read_nutrition_docs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nutrition service documents (one JSON object per line, or one per file with ``multi_line``);
    ``log_id`` tells the documents apart and rises with the lines of a file."""
    df = spark.read.schema(S.NUTRITION_DOC_SCHEMA).option("multiLine", str(multi_line).lower()).json(path)
    return df.withColumns({"source_file": F.col("_metadata.file_path"), "log_id": F.monotonically_increasing_id()})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line (e.g. a questions file), with the source file."""
    return spark.read.text(path).withColumn("source_file", F.col("_metadata.file_path"))


IMAGE_MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
              "webp": "image/webp", "bmp": "image/bmp"}


def read_images_as_data_urls(spark: SparkSession, path: str, default_mime: str = "image/jpeg") -> DataFrame:
    """Image files -> ``data:<mime>;base64,<content>``; MIME by suffix, default jpeg."""
    df = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(
        F.element_at(F.create_map(*[x for kv in IMAGE_MIME.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]), suffix),
        F.lit(default_mime),
    )
    return df.select("path", F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content")).alias("data_url"))
