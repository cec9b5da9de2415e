"""Bounded running values and the replay of credits, against one sequential pass."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.operators.clamp_scan import clamp_scan
from corpuscope.operators.credit_history import credit_history

ALLOWED = {p[0]: p[2] for p in lx.PLANS}
LOG = "request_id long, user_id long, created_at timestamp, action string, amount int, plan string, audit_id long"


@pytest.mark.parametrize("block", [2, 7, 64])
def test_clamp_scan(spark, block):
    rnd = random.Random(block)
    rows, want = [], {}
    for key, size in (("hot", 700), ("few", 3), ("one", 1)):
        x = 2
        for at in range(1, size + 1):
            add, lo = rnd.randrange(-3, 4), rnd.randrange(0, 3)
            hi = lo if rnd.random() < 0.05 else lo + rnd.randrange(0, 9)
            after = min(hi, max(lo, x + add))
            rows.append((key, at, add, lo, hi, f"{key}{at}"))
            want[f"{key}{at}"], x = (x, after), after
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, a int, l int, h int, label string")
    got = clamp_scan(df, ["k"], "at", "a", "l", "h", "v", start=2, block=block)
    assert got.columns == [*df.columns, "v_before", "v_after"]
    assert {r.label: (r.v_before, r.v_after) for r in got.collect()} == want
    assert clamp_scan(df.where("at < 0"), ["k"], "at", "a", "l", "h", "v", block=block).count() == 0


def _sequential(rows, plan):
    accounts, out = {}, {}
    for request, user, at, action, amount, wanted, audit in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        s = accounts.setdefault(user, {"bal": 0, "used": 0, "plan": plan, "took": {}})
        amount, outcome = max(amount or 0, 0), action.upper()
        if action == "grant":
            s["bal"] += amount
        elif action == "revoke":
            s["bal"] = max(0, s["bal"] - amount)
        elif action == "renew":
            s["used"] = 0
        elif action == "plan":
            outcome = "PLAN_KEPT"
            if wanted is not None and wanted != s["plan"]:
                s["plan"], s["used"], outcome = wanted, 0, "PLAN_CHANGED"
        elif action == "reserve":
            if s["used"] < ALLOWED.get(s["plan"], 0):
                s["used"], outcome = s["used"] + 1, "ALLOWANCE"
            elif s["bal"] >= 1:
                s["bal"], outcome = s["bal"] - 1, "CREDIT"
            else:
                outcome = "REFUSED"
            s["took"].setdefault(audit, outcome)
        else:
            took, outcome = s["took"].get(audit), "NOTHING"
            if took == "ALLOWANCE":
                s["used"], outcome = max(0, s["used"] - 1), "ALLOWANCE_BACK"
            elif took == "CREDIT":
                s["bal"], outcome = s["bal"] + 1, "CREDIT_BACK"
            if took is not None:
                s["took"][audit] = "GONE"
        out[request] = (outcome, s["plan"], s["bal"], s["used"])
    return out


@pytest.mark.parametrize("block", [3, 64])
def test_credit_history(spark, block):
    rnd = random.Random(11)
    rows, audits = [], [(0, 1)]
    for i in range(900):
        user = 0 if rnd.random() < 0.4 else rnd.randrange(1, 6)  # one user owns many of the rows
        action = rnd.choices(["grant", "reserve", "refund", "revoke", "renew", "plan"], [2, 6, 5, 1, 1, 1])[0]
        audit, plan = None, None
        if action == "reserve":
            audit = i
            audits.append((user, i))
        elif action == "refund":
            owner, audit = rnd.choice(audits[-12:])
            user = owner if rnd.random() < 0.9 else user  # some ask for the audit of another user
        elif action == "plan":
            plan = rnd.choice(["FREE", "STARTER", "STARTER", "GROWTH", "unheard of", None])
        at = datetime(2024, 1, 1) + timedelta(minutes=17 * (i // 3))  # ties in time
        rows.append((i, user, at, action, rnd.choice([1, 1, 2, -3, None]), plan, audit))
    rows += [(900, None, datetime(2024, 2, 1), "grant", 1, None, None), (901, 0, None, "grant", 1, None, None),
             (902, 0, datetime(2024, 2, 1), "refund", 0, None, None), (903, 0, datetime(2023, 1, 1), "refund", 0, None, 5)]
    rnd.shuffle(rows)
    want = _sequential(rows, "STARTER")
    got = credit_history(spark.createDataFrame(rows, LOG), "STARTER", block)
    assert {r.request_id: (r.outcome, r.plan, r.balance_after, r.allowance_used) for r in got.collect()} == want
    assert {w[0] for w in want.values()} == {"GRANT", "REVOKE", "RENEW", "PLAN_KEPT", "PLAN_CHANGED", "ALLOWANCE", "CREDIT", "REFUSED",
                                             "ALLOWANCE_BACK", "CREDIT_BACK", "NOTHING"}


def test_credit_history_of_nothing(spark):
    assert credit_history(spark.createDataFrame([], LOG)).count() == 0
    lone = spark.createDataFrame([(1, 1, datetime(2024, 1, 1), "refund", 0, None, 7)], LOG)
    assert credit_history(lone).first().outcome == "NOTHING"


def test_a_refund_opens_the_way_for_the_next(spark):
    """A chain: with one credit every reservation depends on the refund before it."""
    rows = [(0, 1, datetime(2024, 1, 1), "grant", 1, None, None)]
    for i in range(5):
        rows += [(2 * i + 1, 1, datetime(2024, 1, 2 + i), "reserve", 0, None, i), (2 * i + 2, 1, datetime(2024, 1, 2 + i, 5), "refund", 0, None, i)]
    got = credit_history(spark.createDataFrame(rows, LOG)).groupBy("outcome").agg(F.count("*").alias("n")).collect()
    assert {r.outcome: r.n for r in got} == {"GRANT": 1, "CREDIT": 5, "CREDIT_BACK": 5}


def test_a_longer_chain_of_refunds_takes_no_more_jobs(spark):
    """Each reservation depends on the refund before it; the last request lies beyond the years that pandas knows."""
    def jobs(links):
        rows = [(0, 1, datetime(2024, 1, 1), "grant", 1, None, None), (1, 1, datetime(9000, 1, 1), "reserve", 0, None, 999)]
        for i in range(links):
            rows += [(2 * i + 2, 1, datetime(2024, 1, 2 + i), "reserve", 0, None, i), (2 * i + 3, 1, datetime(2024, 1, 2 + i, 5), "refund", 0, None, i)]
        log = spark.createDataFrame(rows, LOG).repartition(4)
        group = f"chain of {links}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            got = credit_history(log).groupBy("outcome").count().collect()
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        assert {r["outcome"]: r["count"] for r in got} == {"GRANT": 1, "CREDIT": links + 1, "CREDIT_BACK": links}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) == jobs(3) > 0
