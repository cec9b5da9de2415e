"""Event intake in batch form; ``corpuscope.streaming`` runs the same rules on streams."""

from pyspark.sql import DataFrame, functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.functions.sqltext import let, listed, q
from corpuscope.operators.joins import lookup
from corpuscope.operators.ordered_fold import limit_step, ordered_fold, sliding_step
from corpuscope.operators.running import hour, running


def sanitized() -> list[str]:
    """Select list of a clean event: known name, allowed scalar properties, bounded texts."""
    def entry(key):
        read = f"named_struct('kind', schema_of_variant(variant_get(v, '$.{key}')), 'value', variant_get(v, '$.{key}', 'string'))"
        return let(read, lambda r: (
            f"CASE WHEN {r}.kind = 'STRING' THEN named_struct('key', {q(key)}, 'value', substring({r}.value, 1, 120))"
            f" WHEN {r}.kind IN ('BIGINT', 'DOUBLE', 'BOOLEAN') OR {r}.kind LIKE 'DECIMAL%'"
            f" THEN named_struct('key', {q(key)}, 'value', {r}.value) END"
        ))

    entries = [entry(key) for key in lx.ALLOWED_PROPERTY_KEYS]
    return [f"map_from_entries(array_compact(array({', '.join(entries)}))) AS properties"]


def event_sanitize(events: DataFrame) -> DataFrame:
    known = events.where(F.col("name").isin(*lx.ANALYTICS_EVENTS)).withColumn("v", F.try_parse_json("props"))
    return known.selectExpr(
        "event_id", "name", "user_id", "substring(session_key, 1, 64) AS session_key", "substring(path, 1, 200) AS path", *sanitized()
    )


def event_dedupe(deliveries: DataFrame) -> DataFrame:
    """First delivery of each event and how many came after it."""
    return deliveries.groupBy("event_id").agg(
        F.min("delivery_id").alias("delivery_id"), F.min_by("type", "delivery_id").alias("type"),
        (F.count("*") - 1).alias("duplicates"),
    )


def first_deliveries(deliveries: DataFrame) -> DataFrame:
    """Whole rows of the first deliveries."""
    kept = deliveries.groupBy("event_id").agg(F.min("delivery_id").alias("delivery_id")).select("delivery_id")
    return deliveries.join(kept, "delivery_id", "left_semi")


def credit_grants(deliveries: DataFrame) -> DataFrame:
    """Second guard: a paid checkout session grants once, whatever number of events names it."""
    paid = first_deliveries(deliveries).where("type = 'checkout.session.completed' AND payment_status = 'paid'")
    return paid.groupBy("session_ref").agg(F.min("delivery_id").alias("granted_by"), F.count("*").alias("events"))


def event_route(deliveries: DataFrame) -> DataFrame:
    handler = "CASE WHEN type IN " + listed(lx.PAYMENT_EVENT_TYPES) + " THEN type ELSE 'none' END"
    state = "CASE WHEN type IN " + listed(lx.PAYMENT_EVENT_TYPES) + " THEN 'PROCESSED' ELSE 'IGNORED' END"
    return first_deliveries(deliveries).groupBy(F.expr(handler).alias("handler"), F.expr(state).alias("status")).agg(
        F.count("*").alias("events"))


def resolve_user(deliveries: DataFrame, users: DataFrame) -> DataFrame:
    """First of metadata id, client reference and customer reference that names a user."""
    ids = users.selectExpr("CAST(user_id AS STRING) AS ref", "user_id AS hit")
    refs = users.selectExpr("customer_ref AS ref", "user_id AS hit")
    out = deliveries.select("delivery_id", "metadata_user", "client_reference", "customer_ref")
    for column, dim in (("metadata_user", ids), ("client_reference", ids), ("customer_ref", refs)):
        out = lookup(out, dim.withColumnsRenamed({"ref": column, "hit": f"by_{column}"}), [column], "delivery_id")
    return out.selectExpr(
        "delivery_id", "coalesce(by_metadata_user, by_client_reference, by_customer_ref) AS user_id",
        "CASE WHEN by_metadata_user IS NOT NULL THEN 'metadata' WHEN by_client_reference IS NOT NULL THEN 'client'"
        " WHEN by_customer_ref IS NOT NULL THEN 'customer' ELSE 'none' END AS matched_by",
    )


STATUS = "CASE status " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lx.SUBSCRIPTION_STATUS_MAP.items()) + " ELSE 'INCOMPLETE' END"
SUBSCRIPTION_TYPES = [
    "customer.subscription.updated", "customer.subscription.deleted", "invoice.paid", "invoice.payment_failed",
]


def subscription_state(deliveries: DataFrame) -> DataFrame:
    """Current row of every subscription.

    A subscription exists from its first update on.  Each field is what the last event that sets
    it said, so the fold is a set of ``max_by`` aggregates; usage resets (a new plan, a later
    period) compare an event with the value held before it, a running 'last'."""
    updated, paid = "type = 'customer.subscription.updated'", "type = 'invoice.paid'"
    rows = first_deliveries(deliveries).where(F.col("type").isin(*SUBSCRIPTION_TYPES)).select(
        "subscription_ref", "delivery_id", "created_at", "type", "plan", "status", "period")
    born = rows.where(updated).groupBy("subscription_ref").agg(F.min("delivery_id").alias("born"))
    alive = lookup(rows, born, ["subscription_ref"], "delivery_id", "inner").where("delivery_id >= born")
    held = running(
        alive, ["subscription_ref"], ["created_at", "delivery_id"],
        {"plan_before": ("last", F.expr(f"CASE WHEN {updated} THEN plan END"), "before"),
         "period_before": ("last", F.expr(f"CASE WHEN {updated} OR {paid} THEN period END"), "before")},
        hour("created_at"),
    )
    state = f"""CASE WHEN {updated} THEN {STATUS} WHEN {paid} THEN 'ACTIVE' WHEN type = 'invoice.payment_failed' THEN 'PAST_DUE' ELSE 'CANCELED' END"""
    reset = f"({updated} AND plan_before <> plan) OR ({paid} AND period > period_before)"
    return held.groupBy("subscription_ref").agg(
        F.expr(f"max_by(plan, CASE WHEN {updated} THEN delivery_id END)").alias("plan"),
        F.expr(f"max_by({state}, delivery_id)").alias("status"),
        F.expr(f"max_by(period, CASE WHEN {updated} OR {paid} THEN delivery_id END)").alias("period"),
        F.expr(f"count_if({reset})").alias("usage_resets"),
        F.count("*").alias("events"),
    )


def payment_upsert(deliveries: DataFrame) -> DataFrame:
    """Latest state of the payment behind each checkout session and each invoice.

    A session is paid or still open; an invoice was paid or its payment failed."""
    rows = first_deliveries(deliveries).where("type IN ('checkout.session.completed', 'invoice.paid', 'invoice.payment_failed')").selectExpr(
        "delivery_id", "amount_cents", "created_at", "type = 'checkout.session.completed' AS once",
        "CASE WHEN type = 'checkout.session.completed' THEN session_ref ELSE invoice_ref END AS payment_ref",
        "CASE type WHEN 'invoice.paid' THEN 'SUCCEEDED' WHEN 'invoice.payment_failed' THEN 'FAILED'"
        " ELSE CASE WHEN payment_status = 'paid' THEN 'SUCCEEDED' ELSE 'PENDING' END END AS status")
    last = rows.groupBy("payment_ref").agg(
        F.max_by(F.struct("status", "amount_cents", "created_at", "once"), "delivery_id").alias("p"), F.count("*").alias("updates"))
    return last.selectExpr(
        "payment_ref", "CASE WHEN p.once THEN 'ONE_TIME_AUDIT' ELSE 'SUBSCRIPTION' END AS kind", "p.status AS status",
        "p.amount_cents AS amount_cents", "CASE WHEN p.status = 'SUCCEEDED' THEN p.created_at END AS paid_at", "updates",
    )


def rate_limit(attempts: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Decision for every attempt; refused attempts do not count."""
    return ordered_fold(attempts, "user_id", "ts", "event_id", limit_step(limit, window_seconds * 1_000_000))


def rate_limit_rules(attempts: DataFrame, pepper: str, rules: list[tuple[str, int, int]] = lx.RATE_LIMITS) -> DataFrame:
    """Decision for every attempt (event_id, bucket, identifier, ts) under the rule of its bucket.

    Attempts count per bucket and identifier, which is kept only as a peppered hash; case doesn't
    matter and a null identifier is an empty one.  A bucket without a rule, or null, allows all with
    ``remaining`` null."""
    known = attempts.withColumns({"bucket": F.coalesce("bucket", F.lit("")), "identifier": F.coalesce("identifier", F.lit(""))})
    hashed = hash_identifier(known, "concat(bucket, ':', identifier)", pepper).drop("identifier")

    def of(field, otherwise):
        return F.expr("CASE bucket " + " ".join(f"WHEN {q(r[0])} THEN {r[field]}L" for r in rules) + f" ELSE {otherwise}L END")

    ruled = hashed.withColumns({"_limit": of(1, -1), "_window": of(2, 0) * 1_000_000})
    return ordered_fold(ruled, "identifier_hash", "ts", "event_id", sliding_step, given=("_limit", "_window")).drop("_limit", "_window")


def event_retention(rows: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    old = f"ts < TIMESTAMP '{as_of}' - INTERVAL {hours} HOURS"
    return rows.groupBy("event_type").agg(
        F.expr(f"count_if(NOT ({old}))").alias("kept"), F.expr(f"count_if({old})").alias("dropped"))


def hash_identifier(rows: DataFrame, column: str, pepper: str) -> DataFrame:
    """Peppered one-way hash of an identifier."""
    return rows.selectExpr("*", f"sha2(concat({q(pepper + ':id:')}, lower(trim({column}))), 256) AS identifier_hash")


def daily_event_window(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events")).selectExpr(
        "to_date(w.start) AS day", "event_type", "events")
