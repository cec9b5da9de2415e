"""Scoring, robots, crawl, ledger and limiter rules against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.operators import compare, crawl, events, ledger, recommend, robots, scoring
from corpuscope.operators.ordered_fold import limit_step, ordered_fold
from corpuscope.operators.running import running, trailing_count
from corpuscope.operators.signals import page_signals

CHECK = "site_key string, check_id string, category string, status string, severity string, points double, max_points double, applicable boolean, effort string, impact string"


def _checks(spark, points):
    rows = [("s", f"c{i}", c[0], "PASS", "PASSED", p, 10.0, True, "LOW", "HIGH") for i, (c, p) in enumerate(zip(lx.CATEGORIES, points)) if p is not None]
    return spark.createDataFrame(rows, CHECK)


def _overall(spark, points):
    return scoring.overall(scoring.rebalance(scoring.category_scores(_checks(spark, points)))).first().overall_score


def test_scores(spark):
    assert _overall(spark, [10.0] * 7) == 100
    assert _overall(spark, [0.0] * 7) == 0
    assert _overall(spark, [10.0] + [0.0] * 6) == 15
    assert _overall(spark, [12.0] * 7) == 100


def test_weights_move_to_available_categories(spark):
    weighted = scoring.rebalance(scoring.category_scores(_checks(spark, [5.0, 5.0] + [None] * 5))).collect()
    got = {r.category: r.effective_weight for r in weighted}
    assert got["TECHNICAL_ACCESSIBILITY"] == round(0.15 / 0.32, 4) and got["ENTITY_CLARITY"] == 0.5313  # a tie rounds up
    assert got["COMPETITIVE_VISIBILITY"] == 0


def test_bands(spark):
    df = spark.createDataFrame([(s,) for s in (None, 34, 35, 54, 55, 69, 70, 84, 85)], "overall_score int")
    assert [r.band for r in scoring.with_band(df).collect()] == [
        "critical", "critical", "poor", "poor", "fair", "fair", "good", "good", "excellent"]


def test_order_of_fixes(spark):
    rows = [("s", "b", "ENTITY_CLARITY", "FAIL", "HIGH", 0.0, 6.0, True, "HIGH", "HIGH"),
            ("s", "a", "TECHNICAL_ACCESSIBILITY", "FAIL", "CRITICAL", 0.0, 9.0, True, "LOW", "LOW"),
            ("s", "c", "CONTENT_AUTHORITY", "WARN", "HIGH", 0.0, 6.0, True, "LOW", "HIGH"),
            ("s", "d", "CONTENT_AUTHORITY", "PASS", "PASSED", 6.0, 6.0, True, "LOW", "HIGH")]
    got = recommend.recommendations(spark.createDataFrame(rows, CHECK)).orderBy("priority").collect()
    assert [(r.check_id, r.horizon) for r in got] == [("a", "DO_FIRST"), ("c", "DO_FIRST"), ("b", "LONGER_TERM")]


ROBOTS = """# site
User-agent: one
User-agent: site-audit
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$

User-agent: *
Disallow: /
Sitemap: https://x.com/s.xml
"""


def test_robots(spark):
    files = spark.createDataFrame([("x", "/robots.txt", 200, ROBOTS), ("y", "/robots.txt", 404, ROBOTS)],
                                  "site_key string, path string, status_code int, body string")
    lines = robots.robots_lines(files)
    paths = ["/", "/private/a", "/private/open/b", "/doc.pdf", "/doc.pdf?x", "/privateer"]
    pages = spark.createDataFrame([(s, i, p) for s in "xy" for i, p in enumerate(paths)], "site_key string, page_id long, path string")
    got = {(r.site_key, r.path): r.allowed for r in robots.check_paths(pages, lines).collect()}
    assert [got["x", p] for p in paths] == [True, False, True, False, True, False]
    assert all(got["y", p] for p in paths)
    other = {r.path: r.allowed for r in robots.check_paths(pages.where("site_key = 'x'"), lines, "other").collect()}
    assert not any(other.values())


def test_crawl_follows_the_queue(spark):
    site = {"/": ["/z", "/about", "/services/a", "/cart", "/missing"], "/about": ["/faq", "/z", "/blog"], "/services/a": ["/blog", "/deep/x"],
            "/z": ["/late"], "/faq": ["/pricing"], "/blog": [], "/deep/x": [], "/pricing": [], "/late": []}
    pages = [(i, f"https://s.com{p}", "".join(f'<a href="{t}">t</a>' for t in links)) for i, (p, links) in enumerate(site.items())]
    signals = page_signals(spark.createDataFrame(pages, "page_id long, url string, html string"))
    sites = spark.createDataFrame([("s.com", 0)], "site_key string, seed_page_id long")  # the limit is added below
    rules = spark.createDataFrame([("s.com", [(0, "disallow", "/blog")])], "site_key string, rules array<struct<pos:int,type:string,path:string>>")

    def brute(limit):
        rank = {"/about": 1, "/services/a": 2, "/faq": 3, "/blog": 7, "/pricing": 8}

        def best(links):
            kept = [t for t in dict.fromkeys(links) if t != "/cart"]
            return sorted(kept, key=lambda t: rank.get(t, 11 + len([x for x in t.split("/") if x])))

        queue, seen, read, out = best(site["/"]), {"/"}, 1, [("/", "READ")]
        for t in queue:
            if read >= limit:
                break
            if t in seen:
                continue
            seen.add(t)
            if t == "/blog":
                out.append((t, "ROBOTS_DISALLOWED"))
            elif t not in site:
                out.append((t, "NOT_FETCHED"))
            else:
                out.append((t, "READ"))
                read += 1
                if read < limit:
                    queue.extend([x for x in best(site[t]) if x not in seen and x not in queue][:5])
        return set(out)

    for limit in (2, 4, 10):
        got = crawl.crawl_select(signals, sites.withColumn("page_limit", F.lit(limit)), rules).collect()
        assert {(r.url.replace("https://s.com", ""), r.outcome) for r in got} == brute(limit), limit


def _attempts(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    start, rows, t = datetime(2024, 1, 1), [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 5, 40, 900])
        # one key owns most rows
        rows.append((i, 7 if rnd.random() < 0.7 else rnd.randrange(20), start + timedelta(seconds=t)))
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def test_limiter_equals_one_pass(spark):
    rows, df = _attempts(spark)
    step, states, want = limit_step(4, 600_000_000), {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        us = int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        states[k], want[i] = step(states.get(k, ()), us)
    for partitions in (1, 3, 16):
        got = ordered_fold(df, "user_id", "ts", "event_id", step, partitions).collect()
        assert {r.event_id: (r.allowed, r.remaining, r.retry_after) for r in got} == want


def test_trailing_count(spark):
    rows, df = _attempts(spark, 800)
    got = {r.event_id: r.attempts for r in trailing_count(df, ["user_id"], "ts", 600).collect()}
    for i, k, t in rows[::37]:
        assert got[i] == sum(1 for _, k2, t2 in rows if k2 == k and t - timedelta(seconds=600) <= t2 <= t)


def test_running_equals_plain_window(spark):
    rows, df = _attempts(spark, 1000)
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.col("event_id") % 7 - 3
    got = running(df, ["user_id"], ["ts", "event_id"], {"s": ("sum", value), "m": ("min", value)}, F.date_trunc("hour", "ts"))
    want = df.withColumn("s", F.sum(value).over(w)).withColumn("m", F.min(value).over(w))
    assert sorted(got.select("event_id", "s", "m").collect()) == sorted(want.select("event_id", "s", "m").collect())


def test_credits(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(4), datetime(2024, 1, 1) + timedelta(minutes=i), rnd.choice(["grant", "reserve", "reserve", "revoke", "renew"]), rnd.randrange(1, 4)) for i in range(600)]
    df = spark.createDataFrame(rows, "request_id long, user_id long, created_at timestamp, action string, amount int")
    got = {r.request_id: (r.outcome, r.balance_after, r.allowance_used) for r in ledger.credit_replay(df, 2).collect()}
    state = {}
    for i, user, _, action, amount in rows:
        bal, used = state.get(user, (0, 0))
        outcome = action.upper()
        if action == "grant":
            bal += amount
        elif action == "revoke":
            bal -= min(amount, bal)
        elif action == "renew":
            used = 0
        elif used < 2:
            used, outcome = used + 1, "ALLOWANCE"
        elif bal >= 1:
            bal, outcome = bal - 1, "CREDIT"
        else:
            outcome = "REFUSED"
        state[user] = (bal, used)
        assert got[i] == (outcome, bal, used), i


def test_retention_and_hash(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 3))], "event_type string, ts timestamp")
    assert events.event_retention(df, "2024-01-03 12:00:00").first()[1:] == (1, 1)
    got = events.hash_identifier(spark.createDataFrame([(" A@b ",)], "e string"), "e", "p").first().identifier_hash
    import hashlib
    assert got == hashlib.sha256(b"p:id:a@b").hexdigest()


def test_competitors_up_to_the_limit_of_each_site(spark):
    rows = [(site, pos, f"https://{site}{pos}.example.org/", limit) for site, limit in (("agency", 5), ("starter", 1), ("free", 0)) for pos in range(7)]
    asked = spark.createDataFrame(rows, "site_key string, pos int, raw string, competitor_limit int")
    asked = asked.withColumn("raw", F.regexp_replace("raw", r"//(\w+)\.example\.org", "//$1-site.org"))
    picked = compare.pick_competitors(asked, "competitor_limit").groupBy("site_key").count().collect()
    assert {r["site_key"]: r["count"] for r in picked} == {"agency": 5, "starter": 1}
