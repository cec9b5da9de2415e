"""Registered queries over business tables, ledgers and events."""

from pyspark.sql import functions as F

from corpuscope.operators import events as ev
from corpuscope.operators import ledger, metrics, recommend
from corpuscope.operators.credit_history import credit_history
from corpuscope.operators.running import trailing_count
from corpuscope.plans.audit_queries import checks_of
from corpuscope.sources import bindings as b, io

FROM, TO = "1995-01-01", "2001-08-01"
STATUSES = ["COMPLETED", "RUNNING", "QUEUED", "FAILED", "CANCELED"]
ALLOWANCE = 2


def bound(text):
    return lambda spark, sf: b.bind(spark, sf, text)


users, payments, audits, subscriptions = (bound(t) for t in (b.USERS_SQL, b.PAYMENTS_SQL, b.AUDITS_SQL, b.SUBSCRIPTIONS_SQL))
product_events, webhooks = bound(b.PRODUCT_EVENTS_SQL), bound(b.WEBHOOKS_SQL)


def raw_events(spark, sf):
    return io.scan_events(spark, f"{sf}/events.parquet")


def series(spark, sf):
    return metrics.daily_series(payments(spark, sf), users(spark, sf), audits(spark, sf), FROM, TO)


def _recorded(spark, sf):
    """Ledger with the balance that was written down, off by one in places."""
    entries = b.bind(spark, sf, b.LEDGER_SQL)
    return ledger.ledger_balance(entries).selectExpr(
        "entry_id", "user_id", "delta", "created_at", "balance + IF(entry_id % 97 = 0, 1, 0) AS recorded_balance")



def _sanitized(spark, sf):
    pairs = F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return ev.event_sanitize(io.spread(b.bind(spark, sf, b.RAW_EVENTS_SQL))).withColumn("properties", F.array_join(F.array_sort(pairs), "|"))


def _open_actions(spark, sf):
    return metrics.open_actions(recommend.recommendations(checks_of(spark, sf)), b.bind(spark, sf, b.SITE_AUDITS_SQL))


def _preview_domains(spark, sf, days=7, off=0.05):
    """Exact distinct domains of each week, and whether the merged sketches come within 5 % (three standard errors) of them."""
    runs = b.bind(spark, sf, b.PREVIEW_RUNS_SQL)
    both = metrics.exact_domains_in_windows(runs, days).join(metrics.domains_in_windows(metrics.domain_sketches(runs), days), "day")
    return both.selectExpr("day", "domains", f"abs(estimated_domains - domains) <= greatest(1, {off} * domains) AS estimate_is_near")


QUERIES = {
    "m1_overview_counts": lambda spark, sf: metrics.overview_counts(
        users(spark, sf), audits(spark, sf), b.bind(spark, sf, b.CONTACTS_SQL), b.AS_OF_ORDERS, subscriptions=subscriptions(spark, sf)),
    "m2_revenue_split": lambda spark, sf: metrics.revenue_split(payments(spark, sf), b.AS_OF_ORDERS),
    "m3_mrr": lambda spark, sf: metrics.mrr(subscriptions(spark, sf)),
    "m4_daily_series": series,
    "m5_series_totals": lambda spark, sf: metrics.series_totals(series(spark, sf), b.AS_OF_ORDERS, 1000),
    "m6_funnel_counts": lambda spark, sf: metrics.funnel_counts(product_events(spark, sf), "2024-01-05", "2024-01-25 12:00:00"),
    "m7_funnel_conversion": lambda spark, sf: metrics.funnel_conversion(metrics.funnel_counts(product_events(spark, sf))),
    "m8_top_events": lambda spark, sf: metrics.top_events(product_events(spark, sf), "2024-01-10"),
    "m9_job_health": lambda spark, sf: metrics.job_health(audits(spark, sf)),
    "m10_search_listing": lambda spark, sf: metrics.search_listing(users(spark, sf), "R#00000001", "ACTIVE", 2, 25),
    "m11_listing_with_parent": lambda spark, sf: metrics.listing_with_parent(payments(spark, sf), users(spark, sf), audits(spark, sf)),
    "m12_recent_per_user": lambda spark, sf: metrics.recent_per_user(payments(spark, sf), "created_at", "payment_id", 5).select(
        "user_id", "rank", "payment_id", "amount_cents"),
    "m13_open_actions": _open_actions,
    "m14_status_counts": lambda spark, sf: metrics.status_counts(audits(spark, sf), STATUSES),
    "m15_snapshot_totals": lambda spark, sf: metrics.snapshot_totals(
        metrics.daily_snapshot(raw_events(spark, sf)), "2024-01-03", "2024-01-20"),
    "m16_month_rollup": lambda spark, sf: metrics.month_rollup(payments(spark, sf), users(spark, sf)),
    "m16_recurring_by_month": lambda spark, sf: metrics.recurring_by_month(subscriptions(spark, sf)),
    "m17_demo_segregation": lambda spark, sf: metrics.demo_segregation(payments(spark, sf), users(spark, sf)),
    "m18_preview_run_stats": lambda spark, sf: metrics.preview_run_stats(b.bind(spark, sf, b.PREVIEW_RUNS_SQL)),
    "m18_preview_domains": _preview_domains,
    "l1_ledger_balance": lambda spark, sf: ledger.ledger_balance(b.bind(spark, sf, b.LEDGER_SQL)).select("entry_id", "user_id", "balance"),
    "l2_ledger_reconcile": lambda spark, sf: ledger.ledger_reconcile(_recorded(spark, sf), users(spark, sf).selectExpr(
        "user_id", "CAST(one_time_credits AS BIGINT) AS credits")),
    "l3_entitlements": lambda spark, sf: ledger.entitlements(users(spark, sf), subscriptions(spark, sf)),
    "l4_audit_limits": lambda spark, sf: ledger.audit_limits(ledger.entitlements(users(spark, sf), subscriptions(spark, sf))),
    "l5_credit_replay": lambda spark, sf: ledger.credit_replay(b.bind(spark, sf, b.CREDIT_LOG_SQL), ALLOWANCE),
    "l5_credit_history": lambda spark, sf: credit_history(b.bind(spark, sf, b.CREDIT_HISTORY_SQL), "STARTER"),
    "e1_event_sanitize": _sanitized,
    "e2_event_dedupe": lambda spark, sf: ev.event_dedupe(webhooks(spark, sf)),
    "e2_credit_grants": lambda spark, sf: ev.credit_grants(webhooks(spark, sf)),
    "e3_event_route": lambda spark, sf: ev.event_route(webhooks(spark, sf)),
    "e4_resolve_user": lambda spark, sf: ev.resolve_user(webhooks(spark, sf), users(spark, sf)),
    "e5_subscription_state": lambda spark, sf: ev.subscription_state(webhooks(spark, sf)),
    "e6_payment_upsert": lambda spark, sf: ev.payment_upsert(webhooks(spark, sf)),
    "e7_rate_limit": lambda spark, sf: ev.rate_limit(
        raw_events(spark, sf).select("event_id", "user_id", "ts"), 3, 86400).select(
        "event_id", "user_id", "allowed", "remaining", "retry_after"),
    "e7_rate_limit_rules": lambda spark, sf: ev.rate_limit_rules(b.bind(spark, sf, b.ATTEMPTS_SQL), "pepper").select(
        "event_id", "bucket", "identifier_hash", "allowed", "remaining", "retry_after"),
    "e8_rate_limit_usage": lambda spark, sf: trailing_count(raw_events(spark, sf), ["user_id"], "ts", 86400).select(
        "event_id", "user_id", "attempts"),
    "e9_event_retention": lambda spark, sf: ev.event_retention(raw_events(spark, sf), b.AS_OF_EVENTS, 240),
    "e10_hash_identifier": lambda spark, sf: ev.hash_identifier(b.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "pepper"),
    "e11_daily_event_window": lambda spark, sf: ev.daily_event_window(raw_events(spark, sf)),
}
