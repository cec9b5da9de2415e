"""The event rules on streams.

Late rows are a parameter (``watermark``): the state of closed windows, seen event ids and idle
keys is dropped behind it, and with it the rows that come later still.  That suits sources that
arrive in time order; where files come in any order, ``None`` counts every row, and ``revisions``
decides again what a late row changes.
"""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuscope.functions import lexicon as lx
from corpuscope.operators import events as ev
from corpuscope.operators.ordered_fold import limit_step

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sanitize(events: DataFrame) -> DataFrame:
    """Stateless: the batch projection as it is."""
    return ev.event_sanitize(events)


def daily_counts(events: DataFrame, at: str = "ts", name: str = "event_type", watermark: str | None = "1 day") -> DataFrame:
    """Counts of each day.  Without a watermark the state is one row per day and name, and no row is late."""
    timed = events.withWatermark(at, watermark) if watermark else events
    windowed = timed.groupBy(F.window(at, "1 day").alias("w"), name).agg(F.count("*").alias("events"))
    return windowed.selectExpr("to_date(w.start) AS day", name, "events")


def first_deliveries(deliveries: DataFrame, at: str = "created_at", watermark: str = "3 days") -> DataFrame:
    """Each event once, as long as its copies arrive within the watermark."""
    return deliveries.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["event_id"])


def resolve_users(deliveries: DataFrame, users: DataFrame) -> DataFrame:
    """Stream-static joins against the user table."""
    return ev.resolve_user(deliveries, users)


def rate_limited(attempts: DataFrame, key: str, at: str, tie: str, limit: int, window_seconds: int, watermark: str = "1 hour") -> DataFrame:
    """Sliding-window decisions for attempts that arrive in time order, up to the watermark and within a
    micro-batch.  State per key: at most ``limit`` times, dropped when idle for a window."""
    step = limit_step(limit, window_seconds * 1_000_000)

    def decide(group_key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get[0]) if state.exists else ()
        rows = pd.concat(list(frames)).sort_values(["at_us", "tie"])
        decisions = []
        for moment in rows["at_us"]:
            held, out = step(held, int(moment))
            decisions.append(out)
        state.update((list(held),))
        state.setTimeoutTimestamp(max(int(rows["at_us"].max()) // 1000 + window_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({
            "key": [str(group_key[0])] * len(rows), "tie": rows["tie"].to_numpy(),
            "allowed": [d[0] for d in decisions], "remaining": [d[1] for d in decisions], "retry_after": [d[2] for d in decisions],
        })

    keyed = attempts.withWatermark(at, watermark).selectExpr(
        f"CAST({key} AS STRING) AS key", f"unix_micros({at}) AS at_us", f"CAST({tie} AS BIGINT) AS tie", at)
    return keyed.groupBy("key").applyInPandasWithState(
        decide, "key string, tie bigint, allowed boolean, remaining bigint, retry_after bigint",
        "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout,
    )


def subscription_rows(deliveries: DataFrame) -> DataFrame:
    """Current row of a subscription after every micro-batch that touches it (update mode), for events in time order.

    ``revisions.folded_again`` takes them in any order."""
    statuses = dict(lx.SUBSCRIPTION_STATUS_MAP)

    def fold(key, frames, state: GroupState):
        plan, status, period, resets = state.get if state.exists else (None, None, None, 0)
        rows = pd.concat(list(frames)).sort_values("delivery_id")
        for kind, new_plan, raw, new_period in zip(rows["type"], rows["plan"], rows["status"], rows["period"]):
            if kind == "customer.subscription.updated":
                resets += plan is not None and plan != new_plan
                plan, status, period = new_plan, statuses.get(raw, "INCOMPLETE"), int(new_period)
            elif plan is None:
                continue  # not created yet
            elif kind == "invoice.paid":
                resets += int(new_period) > period
                status, period = "ACTIVE", int(new_period)
            elif kind == "invoice.payment_failed":
                status = "PAST_DUE"
            else:
                status = "CANCELED"
        if plan is not None:
            state.update((plan, status, period, int(resets)))
            yield pd.DataFrame({"subscription_ref": [key[0]], "plan": [plan], "status": [status], "period": [period], "usage_resets": [int(resets)]})

    rows = deliveries.where(F.col("type").isin(*ev.SUBSCRIPTION_TYPES)).select(
        "subscription_ref", "delivery_id", "type", "plan", "status", "period")
    return rows.groupBy("subscription_ref").applyInPandasWithState(
        fold, "subscription_ref string, plan string, status string, period int, usage_resets bigint",
        "plan string, status string, period int, usage_resets bigint", "update", GroupStateTimeout.NoTimeout,
    )


def write_changes(path: str):
    """``foreachBatch`` sink of row changes: a batch that runs again replaces its own folder."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """Current rows out of the changes: the last one of each key."""
    changes = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in (key, "epoch")]
    return changes.groupBy(key).agg(F.max_by(F.struct(*values), F.struct("epoch", order)).alias("r")).select(key, "r.*")
