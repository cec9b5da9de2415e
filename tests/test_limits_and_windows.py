"""Limits by bucket, recurring revenue over time and mergeable counts, against plain loops."""

import hashlib
import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.operators import events, metrics

PRICES = {p[0]: p[1] for p in lx.PLANS}


def test_each_bucket_has_its_rule(spark):
    rnd, rules = random.Random(5), {r[0]: r[1:] for r in lx.RATE_LIMITS}
    assert len(rules) == 8
    rows = []
    for i in range(3000):
        bucket = rnd.choice([*rules, "report:download", "report:download", "audit:create", "other", None])
        rows.append((i, bucket, rnd.choice(["A@x.example.com", "a@x.example.com", "b", None]), datetime(2024, 1, 1) + timedelta(seconds=7 * (i // 2)), "kept"))
    schema = "event_id long, bucket string, identifier string, ts timestamp, note string"
    got = {r.event_id: r for r in events.rate_limit_rules(spark.createDataFrame(rows, schema).repartition(7), "p").collect()}
    accepted, refused = defaultdict(list), set()
    for i, bucket, who, at, _ in rows:
        bucket, key = bucket or "", f"{bucket or ''}:{who or ''}".lower()
        assert got[i].identifier_hash == hashlib.sha256(f"p:id:{key}".encode()).hexdigest() and got[i].note == "kept"
        if bucket not in rules:
            want = (True, None, 0)
        else:
            most, window = rules[bucket]
            live = [t for t in accepted[key] if t >= at - timedelta(seconds=window)]
            if len(live) < most:
                accepted[key].append(at)
                want = (True, most - len(live) - 1, 0)
            else:
                refused.add(bucket)
                want = (False, 0, max(1, -int((at - live[0] - timedelta(seconds=window)).total_seconds() // 1)))
        assert (got[i].allowed, got[i].remaining, got[i].retry_after) == want, i
    assert refused == set(rules)
    assert events.rate_limit_rules(spark.createDataFrame([], schema), "p").count() == 0


def test_recurring_revenue_of_every_month(spark):
    rnd, rows = random.Random(8), []
    for i in range(400):
        at = datetime(2022, 1, 5) + timedelta(hours=rnd.randrange(24 * 500))
        if (at.year, at.month) != (2022, 9):  # a month without a change still has its row
            rows.append((i, 0 if rnd.random() < 0.4 else rnd.randrange(1, 9), rnd.choice([*PRICES, "unheard of", None]),
                         rnd.choice(["ACTIVE", "TRIALING", "CANCELED", "PAST_DUE", None]), at, i % 11 == 0))
    rows += [(401, None, "AGENCY", "ACTIVE", datetime(2022, 3, 1), False), (402, 1, "AGENCY", "ACTIVE", None, False)]
    schema = "subscription_id long, user_id long, plan string, status string, created_at timestamp, is_demo boolean"
    got = [tuple(r) for r in metrics.recurring_by_month(spark.createDataFrame(rows, schema)).orderBy("month").collect()]
    real = [r for r in rows if r[1] is not None and r[4] is not None and not r[5]]
    months, m = [], min(r[4] for r in real).replace(day=1, hour=0)
    while m <= max(r[4] for r in real):
        months.append(m)
        m = (m + timedelta(days=32)).replace(day=1)
    want = []
    for m in months:
        end, held = (m + timedelta(days=32)).replace(day=1), {}
        for r in sorted(real, key=lambda r: (r[4], r[0])):
            if r[4] < end:
                held[r[1]] = r
        live = [r for r in held.values() if r[3] in ("ACTIVE", "TRIALING")]
        want.append((m.strftime("%Y-%m"), len(live), sum(PRICES.get(r[2], 0) for r in live)))
    assert got == want and "2022-09" in dict((w[0], w) for w in want)
    assert metrics.recurring_by_month(spark.createDataFrame([], schema)).count() == 0


def test_sketches_merge_over_windows(spark):
    runs = spark.range(60000).select(
        F.expr("timestamp'2024-01-01' + make_dt_interval(CAST(id % 12 AS INT) + IF(id % 12 > 8, 3, 0))").alias("created_at"),
        F.expr("CASE WHEN id % 50 = 0 THEN NULL ELSE concat('d', id * 7919 % 20011, '.example') END").alias("domain"))
    estimated = {r.day: r.estimated_domains for r in metrics.domains_in_windows(metrics.domain_sketches(runs), 5).collect()}
    exact = {r.day: r.domains for r in metrics.exact_domains_in_windows(runs, 5).collect()}
    by_day = defaultdict(set)
    for r in runs.select(F.to_date("created_at").alias("day"), "domain").collect():
        by_day[r.day].add(r.domain)
    want = {d: len(set().union(*(by_day.get(d - timedelta(days=k), set()) for k in range(5))) - {None}) for d in by_day}
    assert exact == want and len(want) == 12 and date(2024, 1, 10) not in want
    assert set(estimated) == set(want) and all(abs(estimated[d] - want[d]) <= 0.05 * want[d] for d in want)
