"""Credits with refunds and plan changes: every request of a log against allowance and balance."""

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.operators.ordered_fold import ordered_fold

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOTHING, MOVE, RESERVE, RESERVE_AND_KEEP, REFUND, RENEW, PLAN = range(7)
_KIND = f"""CASE WHEN action IN ('grant', 'revoke') THEN {MOVE} WHEN action = 'reserve' THEN IF(_kept, {RESERVE_AND_KEEP}, {RESERVE})
  WHEN action = 'refund' AND audit_id IS NOT NULL THEN {REFUND} WHEN action = 'renew' THEN {RENEW} WHEN action = 'plan' AND plan IS NOT NULL THEN {PLAN}
  ELSE {NOTHING} END"""
_MOVED = "greatest(coalesce(CAST(amount AS BIGINT), 0L), 0L) * CASE action WHEN 'grant' THEN 1L WHEN 'revoke' THEN -1L ELSE 0L END"


def account_step(start_plan: str, allowances: dict[str, int]):
    """One request; state = plan, used allowance, balance, and what each audit took that is refunded later."""

    def step(state, _, kind, moved, wanted, audit):
        plan, used, balance, took = state or (start_plan, 0, 0, {})
        outcome = None
        if kind == MOVE:
            balance = max(0, balance + moved)
        elif kind in (RESERVE, RESERVE_AND_KEEP):
            if used < allowances.get(plan, 0):
                used, outcome = used + 1, "ALLOWANCE"
            elif balance >= 1:
                balance, outcome = balance - 1, "CREDIT"
            else:
                outcome = "REFUSED"
            if kind == RESERVE_AND_KEEP and outcome != "REFUSED":
                took[audit] = outcome
        elif kind == REFUND:
            back = took.pop(audit, None)
            if back == "ALLOWANCE":
                used, outcome = max(0, used - 1), "ALLOWANCE_BACK"
            elif back == "CREDIT":
                balance, outcome = balance + 1, "CREDIT_BACK"
        elif kind == RENEW:
            used = 0
        elif kind == PLAN and wanted != plan:
            plan, used, outcome = wanted, 0, "PLAN_CHANGED"
        return (plan, used, balance, took), (plan, outcome, balance, used)

    return step


def _kept(log: DataFrame) -> DataFrame:
    """The first reservation of every audit that has a refund after it."""
    when = F.struct("created_at", "request_id")
    ends = log.where("action IN ('reserve', 'refund') AND audit_id IS NOT NULL").groupBy("user_id", "audit_id").agg(
        F.min(F.when(F.expr("action = 'reserve'"), when)).alias("reserved"), F.max(F.when(F.expr("action = 'refund'"), when)).alias("refunded"))
    return ends.where("refunded > reserved").select("user_id", "reserved.*", F.lit(True).alias("_kept"))


def credit_history(log: DataFrame, start_plan: str = "FREE", partitions: int | None = None) -> DataFrame:
    """Outcome of every request in arrival order, with the plan, balance and used allowance after it.

    ``reserve`` takes the plan's allowance first, then a credit, and is refused at zero; ``grant`` and
    ``revoke`` move the balance, which stops at zero; ``renew`` and a change of ``plan`` start a fresh
    allowance; ``refund`` gives back, once for each audit, what its first reservation took - to the
    allowance of the period it falls in, or to the balance.  A refund of a refused, unknown or later
    audit, or of another user's, returns nothing.  An unknown or null plan has no allowance or changes
    none.  Requests without a user or time are left out; amounts below zero or null count as zero.

    What a refund returns depends on an outcome before it, which may depend on other refunds, so the
    log is folded in order.  A user's state holds only the audits whose refund is still to come; a user
    with many requests is spread over ``partitions`` of the fold, each of which hands its state on."""
    placed = log.where("user_id IS NOT NULL AND created_at IS NOT NULL").select(
        "request_id", "user_id", "created_at", "action", "amount", "plan", "audit_id")
    rows = placed.join(_kept(placed), ["user_id", "created_at", "request_id"], "left").selectExpr(
        "request_id", "user_id", "created_at", "action", f"{_KIND} AS _kind", f"{_MOVED} AS _moved", "coalesce(plan, '') AS _wanted",
        "IF(action = 'refund' OR _kept, coalesce(CAST(audit_id AS STRING), ''), '') AS _audit")
    step = account_step(start_plan, {p[0]: p[2] for p in lx.PLANS})
    folded = ordered_fold(rows, "user_id", "created_at", "request_id", step, partitions, ("_kind", "_moved", "_wanted", "_audit"),
                          "_plan string, _outcome string, balance_after bigint, allowance_used bigint", ("request_id", "user_id", "action"))
    other = "CASE action WHEN 'refund' THEN 'NOTHING' WHEN 'plan' THEN 'PLAN_KEPT' ELSE upper(action) END"
    return folded.selectExpr("request_id", "user_id", "action", "_plan AS plan", f"coalesce(_outcome, {other}) AS outcome",
                             "balance_after", "allowance_used")
