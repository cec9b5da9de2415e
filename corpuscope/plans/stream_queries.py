"""Registered queries that drain a stream of the given events.

Each runs until the source is exhausted, writes to the shared folder and returns what it wrote.
Files may come in any order, so no row is ever late.
"""

import re
import uuid

from pyspark.sql import functions as F

from corpuscope.operators import events as ev
from corpuscope.sources import bindings as b, io
from corpuscope.streaming import exactly_once, pipelines, revisions


def _drain(spark, stream, mode, name):
    """Run to the end of the source.  Updates are kept as changes per micro-batch."""
    base = f"{io.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(pipelines.write_changes(f"{base}/changes"))
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{base}/changes"


def _events(spark, sf):
    return io.stream_events(spark, f"{sf}/event[s].parquet")


def _daily(spark, sf):
    path = _drain(spark, pipelines.daily_counts(_events(spark, sf), watermark=None), "update", "daily")
    changes = spark.read.parquet(path)
    return changes.groupBy("day", "event_type").agg(F.max_by("events", "epoch").alias("events"))


def _limited(spark, sf):
    """Decisions as the stream made and revised them."""
    folder = f"{io.shared_folder(spark)}/limit-{uuid.uuid4().hex}"
    attempts = _events(spark, sf).select("event_id", "user_id", "ts")
    revisions.run_to_end(attempts, revisions.limited(f"{folder}/log", "user_id", "ts", "event_id", 3, 86400), folder)
    log = revisions.logged(spark, f"{folder}/log", revisions.decisions_schema(attempts, "user_id", "ts", "event_id"))
    return revisions.current(log, "event_id").select("event_id", "user_id", "allowed", "remaining", "retry_after")


def _deliveries(spark, sf):
    """Webhook deliveries as a stream of the given events."""
    return spark.sql(re.sub(r"FROM events\b", "FROM {events}", b.WEBHOOKS_SQL), events=_events(spark, sf))


def _first_deliveries(spark, sf):
    """Table of each event's first delivery, kept by the stream."""
    folder = f"{io.shared_folder(spark)}/deliveries-{uuid.uuid4().hex}"
    return exactly_once.run_to_end(exactly_once.first_of_each(_deliveries(spark, sf)), folder, "event_id")


def _resolved(spark, sf):
    users = b.bind(spark, sf, b.USERS_SQL)
    return spark.read.parquet(_drain(spark, pipelines.resolve_users(_deliveries(spark, sf), users), "append", "resolved")).drop("epoch")


def _subscriptions(spark, sf):
    folder = f"{io.shared_folder(spark)}/subscriptions-{uuid.uuid4().hex}"
    rows = _deliveries(spark, sf).where(F.col("type").isin(*ev.SUBSCRIPTION_TYPES)).select(
        "event_id", "delivery_id", "type", "subscription_ref", "plan", "status", "period", "created_at")
    revisions.run_to_end(rows, revisions.folded_again(folder, "subscription_ref", "delivery_id", ev.subscription_state), folder)
    return exactly_once.written(spark, f"{folder}/table", None).drop("bucket")


QUERIES = {
    "e11_stream_daily_counts": _daily, "e7_stream_rate_limit": _limited,
    "e2_stream_event_dedupe": lambda spark, sf: exactly_once.duplicates(_first_deliveries(spark, sf)),
    "e2_stream_credit_grants": lambda spark, sf: ev.credit_grants(exactly_once.firsts(_first_deliveries(spark, sf))),
    "e4_stream_resolve_user": _resolved,
    "e5_stream_subscription_state": _subscriptions,
    "e6_stream_payment_upsert": lambda spark, sf: ev.payment_upsert(exactly_once.firsts(_first_deliveries(spark, sf))),
}
