"""Results on a stream that a late row can still change.

Each micro-batch writes what it decided: rows for its own events, and revisions of earlier rows that a
late event changed.  A folder ``epoch=N`` holds those of one micro-batch, is made from what earlier
epochs wrote, and is replaced when the same epoch runs again; a consumer that follows the folders replaces
rows by key, and ``current`` does so for the whole log.  No row is ever too late, and nothing is
held in executors between micro-batches.
"""

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuscope.operators import events as ev
from corpuscope.operators.joins import lookup
from corpuscope.sources.io import drop_stored, materialize
from corpuscope.streaming.exactly_once import merge_by_key

DECISION = ("allowed", "remaining", "retry_after")


def logged(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All rows that epochs wrote, those ``before`` one only if named; none where nothing was written yet."""
    stamped = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    try:
        log = spark.read.schema(stamped).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stamped)
    return log if before is None else log.where(F.col("epoch") < before)


def current(log: DataFrame, key: str) -> DataFrame:
    """The newest row of each key."""
    values = [c for c in log.columns if c not in (key, "epoch")]
    return log.groupBy(key).agg(F.max_by(F.struct(*values), "epoch").alias("r")).select(key, "r.*")


def decisions_schema(attempts: DataFrame, key: str, at: str, tie: str) -> T.StructType:
    return T.StructType([*attempts.select(tie, key, at).schema.fields, T.StructField("allowed", T.BooleanType()),
                         T.StructField("remaining", T.LongType()), T.StructField("retry_after", T.LongType())])


def limited(path: str, key: str, at: str, tie: str, limit: int, window_seconds: int):
    """``foreachBatch`` sink of a sliding-window limiter that accepts attempts in any order.

    An attempt can change decisions from its own time on.  So each key is folded again from its earliest new attempt,
    over later attempts that are known already and, to begin with the right state, the accepted ones of one window before.
    Attempts that come in order thus cost one window of history.  A copy of a known attempt changes nothing.
    A key's rows are spread over tasks (``lookup``, ``ordered_fold``); attempts without key count as one key, and those
    without time are left out, since no rule places them.
    """
    window = timedelta(seconds=window_seconds)

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        attempts = materialize(batch.select(tie, key, at).where(F.col(at).isNotNull()).dropDuplicates([tie]))
        earliest = attempts.agg(F.min(at)).first()[0]
        schema = decisions_schema(attempts, key, at, tie)
        if earliest is None:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
            return
        # The condition on time reaches the files of the log: older rows can't matter.
        known = materialize(current(logged(spark, path, schema, epoch).where(F.col(at) >= F.lit(earliest - window)), tie))
        fresh = attempts.join(known.select(tie), tie, "left_anti")
        owner = F.to_json(F.struct(key))
        starts = fresh.groupBy(owner.alias("_owner")).agg(F.min(F.struct(at, tie)).alias("_start"))
        old = lookup(known.withColumn("_owner", owner), starts, ["_owner"], tie, "inner")
        replayed = F.struct(at, tie) > F.col("_start")
        state = F.col("allowed") & (F.col(at) >= F.col(f"_start.{at}") - F.expr(f"INTERVAL {window_seconds} SECONDS"))
        before = old.where(replayed | state).select(
            tie, key, at, F.to_json(F.struct(*DECISION)).alias("_was"), (~replayed).alias("_state"))
        rows = fresh.select(tie, key, at, F.lit(None).cast("string").alias("_was"), F.lit(False).alias("_state")).unionByName(before)
        decided = ev.ordered_fold(rows, key, at, tie, ev.limit_step(limit, window_seconds * 1_000_000))
        changed = ~F.col("_was").eqNullSafe(F.to_json(F.struct(*DECISION)))
        decided.where(~F.col("_state") & changed).select(schema.names).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        drop_stored(known)
        drop_stored(attempts)

    return sink


def folded_again(path: str, key: str, tie: str, fold):
    """``foreachBatch`` sink of a table with one row per key that depends on the order of all its events.

    Events are added to ``path/history``; the keys of a micro-batch are folded by the batch operator ``fold`` from
    their whole history, so a late event is replayed in its place, and merged into ``path/table`` by key."""
    merge = merge_by_key(f"{path}/table", key)

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/history/epoch={epoch}")
        history = logged(spark, f"{path}/history", batch.schema, epoch + 1)
        touched = history.where(F.col("epoch") == epoch).select(key).distinct()
        rows = materialize(fold(lookup(history.drop("epoch"), touched, [key], tie, "inner")))
        merge(rows, epoch)
        drop_stored(rows)

    return sink


def run_to_end(stream: DataFrame, sink, folder: str) -> None:
    """Take in what the source has by now; called again with the same folder, what came since."""
    stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
