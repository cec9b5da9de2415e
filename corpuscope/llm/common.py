"""Small helpers that several training-data operators share."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuscope.sources.io import materialize, reliable_checkpoint, shared_folder

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space; everything between is a word.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(col):
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def space_words(text):
    """The words of a text, in order: its runs of characters that are not ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this run's own, below the one that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate table and go on from it; the shuffle files that made it go at once.

    The table in the shared folder replaces them: nothing that comes later runs those shuffles again."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return materialize(df)
    finally:
        conf.set(name, before)


def prefix_sums(df: DataFrame, order: list, values: list[str]) -> DataFrame:
    """Add ``before_<v>`` for each column of ``values``: its sum over all rows that come earlier.

    The rows are range-partitioned by ``order`` and written once, so that every later step sees
    the same ranges; each range sums its own rows, and the totals of the ranges (one row for each
    partition) give the offsets.  No task sees more than one range.
    """
    ranged = reliable_checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(*(F.sum(v).alias(v) for v in values)).select(
        "_range", *(F.coalesce(F.sum(v).over(ranges), F.lit(0)).alias(f"_start_{v}") for v in values))
    return (
        ranged.select("*", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_local_{v}") for v in values))
        .join(F.broadcast(offsets), "_range")  # one row for each partition of the ranges
        .select(*df.columns, *((F.col(f"_start_{v}") + F.col(f"_local_{v}")).alias(f"before_{v}") for v in values))
    )
