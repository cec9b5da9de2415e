"""Sources and sinks."""

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuscope.functions.lexicon import TEXTUAL_CONTENT_TYPES

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly before CPU-heavy parsing, by a hash of the first column.

    The same plan for every size: parsing costs far more than one shuffle of its input, and files
    differ in the number and length of their pages."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, F.xxhash64(df.columns[0]))


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one named in ``spark.checkpoint.dir``.

    Only a session whose executors live in this process (``local[n]``, as in tests) may leave it
    unset and gets a new temporary folder; on a cluster that would be a folder of one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table once and go on from the file.

    Lost executors then cost a re-read, not a second parse of the markup; the reader prunes
    columns; and the plans that follow start from a scan."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once a later table has taken its place; other tables stay."""
    spark, root = df.sparkSession, shared_folder(df.sparkSession)
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if re.fullmatch(r"[0-9a-f]{32}", folder.getName()) and folder.getParent().getName() == root.rstrip("/").rpartition("/")[2]:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage and keep partitions and their order as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def is_textual():
    """Content type is unknown or text."""
    base = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    return (base == "") | base.isin(*TEXTUAL_CONTENT_TYPES)


def textual_only(pages: DataFrame) -> DataFrame:
    """Drop rows whose content type is known and is not text."""
    return pages.where(is_textual())


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Events as a stream of files; the batch size bounds what one micro-batch reads."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def write_results(df: DataFrame, path: str, keys: list[str], audits: DataFrame, partition: str = "audit_id", folders: int = 64) -> None:
    """Make ``df`` the results of the listed ``audits`` (one column) and leave other audits alone.

    An audit that now has no rows loses those that it had.  Duplicate keys within an audit are dropped.
    A folder holds the audits of one hash bucket, so their number doesn't grow with the audits; the
    folders of the listed audits are written anew from the rows that stay and the new ones, and swapped.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(partition), F.lit(folders)).cast("int")
    listed = audits.select(F.col(audits.columns[0]).alias(partition)).distinct()
    rows = df.dropDuplicates([partition, *keys]).join(listed, partition, "left_semi").withColumn("_bucket", bucket)
    try:
        old = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        rows.repartitionByRange("_bucket", partition, *keys).write.partitionBy("_bucket").parquet(path)
        return
    touched = listed.select(bucket.alias("_bucket")).distinct()
    stay = old.join(touched, "_bucket", "left_semi").join(listed, partition, "left_anti").select(rows.columns)
    merged = materialize(stay.unionByName(rows))
    emptied = [r["_bucket"] for r in touched.join(merged.select("_bucket").distinct(), "_bucket", "left_anti").collect()]  # below ``folders``
    merged.repartitionByRange("_bucket", partition, *keys).write.partitionBy("_bucket").option(
        "partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for b in emptied:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"_bucket={b}"), True)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
