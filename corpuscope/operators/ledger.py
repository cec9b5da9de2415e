"""Credits and entitlements."""

from pyspark.sql import DataFrame, functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.functions.sqltext import listed, q
from corpuscope.operators.running import hour, running


def ledger_balance(entries: DataFrame) -> DataFrame:
    """Balance of each user after each entry."""
    return running(entries, ["user_id"], ["created_at", "entry_id"], {"balance": ("sum", F.col("delta"))}, hour("created_at"))


def ledger_reconcile(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Entries whose recorded balance is wrong, and accounts that differ from their last entry."""
    replayed = ledger_balance(entries)
    wrong = replayed.where("balance <> recorded_balance").selectExpr(
        "'entry' AS kind", "entry_id AS id", "CAST(recorded_balance AS BIGINT) AS recorded", "balance AS expected")
    last = entries.groupBy("user_id").agg(F.sum("delta").alias("expected"))
    off = accounts.join(last, "user_id", "left").where("coalesce(expected, 0L) <> credits").selectExpr(
        "'account' AS kind", "user_id AS id", "CAST(credits AS BIGINT) AS recorded", "coalesce(expected, 0L) AS expected")
    return wrong.unionByName(off)


def _plan(field: int) -> str:
    return "CASE plan " + " ".join(f"WHEN {q(p[0])} THEN {p[field]}" for p in lx.PLANS) + " END"


def entitlements(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Plan and remaining audits of every user, from the newest subscription that still counts."""
    live = subscriptions.where(F.col("status").isin(*lx.ENTITLED_STATUSES))
    newest = live.groupBy("user_id").agg(
        F.max_by(F.struct("plan", "audits_used", "subscription_id"), F.struct("created_at", "subscription_id")).alias("s")
    )
    base = users.join(newest, "user_id", "left").selectExpr(
        "user_id", "coalesce(s.plan, 'FREE') AS plan", "s IS NOT NULL AS subscription_active",
        "coalesce(s.audits_used, 0) AS audits_used", "one_time_credits",
    )
    left = f"greatest(0, CASE WHEN subscription_active THEN {_plan(2)} ELSE 0 END - audits_used)"
    return base.selectExpr("*", f"{left} AS audits_remaining").selectExpr(
        "*", "audits_remaining + one_time_credits AS total_available")


def audit_limits(entitled: DataFrame) -> DataFrame:
    pages, rivals = _plan(3), _plan(4)
    return entitled.selectExpr(
        "user_id", "plan", "total_available > 0 AS can_create",
        f"CASE WHEN audits_remaining > 0 THEN {pages} ELSE greatest(10, {pages}) END AS page_limit",
        f"CASE WHEN audits_remaining > 0 THEN {rivals} ELSE greatest(1, {rivals}) END AS competitor_limit",
    )


def credit_replay(log: DataFrame, allowance: int) -> DataFrame:
    """Outcome of every request against a user's allowance and credits, in arrival order.

    A reservation takes the period's allowance first, then a credit, and is refused at zero; a
    revocation stops at zero.  A balance that stops at zero is a reflected walk: with S the plain
    running sum, it is S minus the lowest S so far where that is negative.  So the replay needs
    running sums and minima only - no sequential pass."""
    order, at = ["created_at", "request_id"], hour("created_at")
    periods = running(log, ["user_id"], order, {"period": ("sum", F.expr("IF(action = 'renew', 1L, 0L)"))}, at)
    ranked = running(
        periods, ["user_id", "period"], order, {"nth": ("sum", F.expr("IF(action = 'reserve', 1L, 0L)"))}, at
    )
    free = f"action = 'reserve' AND nth <= {allowance}"
    change = f"CASE WHEN action = 'grant' THEN amount WHEN action = 'revoke' THEN -amount WHEN action = 'reserve' AND NOT ({free}) THEN -1 ELSE 0 END"
    walked = running(ranked.withColumn("change", F.expr(change).cast("bigint")), ["user_id"], order,
                     {"walk": ("sum", F.col("change"))}, at)
    # ``low_before`` gives the balance just before the row: the same formula without its own change.
    lows = running(walked, ["user_id"], order, {
        "low": ("min", F.col("walk")), "low_before": ("min", F.col("walk"), "before")}, at)
    balance = "walk - least(0L, low)"
    held = "walk - change - least(0L, coalesce(low_before, 0L))"
    outcome = (
        f"CASE WHEN action <> 'reserve' THEN upper(action) WHEN {free} THEN 'ALLOWANCE' WHEN {held} >= 1 THEN 'CREDIT' ELSE 'REFUSED' END"
    )
    return lows.selectExpr(
        "request_id", "user_id", "action", f"{outcome} AS outcome", f"{balance} AS balance_after",
        f"least({allowance}L, nth) AS allowance_used",
    )
