"""One effect for each event, however often, however late and in whatever order it is delivered.

State is one row for each event id, kept without a watermark in the state store of the query's
checkpoint, so a copy that comes a month late or after a restart finds its first delivery.  Changes go
to a table by key that a batch which runs again leaves as it was.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Keeps keyed state on disk and uploads only what changed; the default one holds all keys in executors' heaps.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_of_each(deliveries: DataFrame) -> DataFrame:
    """(event_id, delivery_id, deliveries, first): what is known of each event after a micro-batch that touches it (update mode).

    The first delivery is the one of the smallest ``delivery_id``; one that comes late replaces the row under the same key."""
    return deliveries.groupBy("event_id").agg(
        F.min("delivery_id").alias("delivery_id"), F.count("*").alias("deliveries"),
        F.min_by(F.struct(*(c for c in deliveries.columns if c not in ("event_id", "delivery_id"))), "delivery_id").alias("first"))


def latest_versions(table: DataFrame) -> list:
    """(bucket, epoch) of the newest version of each bucket; as many rows as buckets at most."""
    return [tuple(r) for r in table.groupBy("bucket").agg(F.max("epoch")).collect()]


def rows_of(table: DataFrame, versions: list) -> DataFrame:
    """Rows of the given versions; both columns are folders, so nothing else is read."""
    named = F.lit(False)
    for bucket, epoch in versions:
        named = named | ((F.col("bucket") == bucket) & (F.col("epoch") == epoch))
    return table.where(named)


def written(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame | None:
    """The table as it was before an epoch, or as it is; None if nothing was written."""
    try:
        table = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    table = table.where(F.col("epoch") < before) if before is not None else table
    return rows_of(table, latest_versions(table)).drop("epoch")


def merge_by_key(path: str, key: str, buckets: int = 64):
    """``foreachBatch`` sink that holds one row for each key.

    A batch writes a new version of the buckets that it touches, made of its rows and of the rows of
    other keys in the version before.  It goes to a folder of its epoch, from what earlier epochs wrote, so
    the same epoch run again writes the same.  Readers see a bucket's newest version (``written``)."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if (old := written(spark, path, None, before=epoch)) is not None:
            touched = new.select("bucket").distinct()
            stay = old.join(touched, "bucket", "left_semi").join(new.select(key), key, "left_anti")
            new = new.unionByName(stay.select(new.columns))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/epoch={epoch}")

    return sink


def run_to_end(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """Take in what the source has by now and return the table; call again for what came since.

    ``folder`` holds the query's checkpoint with its state, and the table."""
    spark, (name, provider) = stream.sparkSession, STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        query = stream.writeStream.outputMode("update").foreachBatch(merge_by_key(f"{folder}/table", key)).option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    found = written(spark, f"{folder}/table", None)
    return (spark.createDataFrame([], stream.schema) if found is None else found).select(stream.columns)


def firsts(table: DataFrame) -> DataFrame:
    """Whole rows of first deliveries, as the batch operators read them."""
    return table.select("event_id", "delivery_id", "first.*")


def duplicates(table: DataFrame) -> DataFrame:
    return table.select("event_id", "delivery_id", F.col("first.type").alias("type"), (F.col("deliveries") - 1).alias("duplicates"))
