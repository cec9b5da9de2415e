"""Where redirects of link targets end."""

import random

from corpuscope.operators import links

SCHEMA = "url_key string, status int, location_key string, error string"


def walk(log, url, most=5):
    at, hops = url, 0
    while at in log and 300 <= (log[at][0] or 0) < 400 and log[at][1] is not None:
        at, hops = log[at][1], hops + 1
        if hops > most:
            return None, "TOO_MANY_REDIRECTS"
    if at not in log:
        return None, None
    status, _, error = log[at]
    if error:
        return status, {"ETIMEDOUT": "TIMEOUT", "ENOTFOUND": "DNS_FAILURE"}.get(error, "CONNECTION_FAILED")
    return status, "HTTP_ERROR" if status and status >= 400 else "OK"


def test_ends_equal_a_walk(spark):
    r = random.Random(4)
    log = {}
    for i in range(400):  # chains to later URLs of any length, some out of the log, a page that many move to, a redirect without target
        kind = r.random()
        moved = f"u{r.choice([i + 1, i + 1, i + 3, 399, 900])}" if kind < 0.7 else None
        log[f"u{i}"] = (301, moved, None) if kind < 0.75 else (r.choice([200, 404, 503]), None, None) if kind < 0.9 else (None, None, r.choice(["ETIMEDOUT", "ENOTFOUND", "ECONNREFUSED"]))
    log |= {"a": (302, "b", None), "b": (302, "a", None), "self": (302, "self", None), "u399": (404, None, None)}
    got = links.link_ends(spark.createDataFrame([(u, *v) for u, v in log.items()], SCHEMA))
    assert {x.url_key: (x.status, x.code) for x in got.collect()} == {u: walk(log, u) for u in log}
    assert got.count() == len(log)


def test_chains_at_the_limit(spark):
    chain = [(f"c{i}", 301, f"c{i + 1}", None) for i in range(7)] + [("c7", 503, None, None)]
    ends = links.link_ends(spark.createDataFrame(chain, SCHEMA))
    assert {x.url_key: (x.hops if x.hops <= 5 else None, x.code) for x in ends.collect()} == {
        f"c{i}": (7 - i, "HTTP_ERROR") if i >= 2 else (None, "TOO_MANY_REDIRECTS") for i in range(8)}
    targets = spark.createDataFrame([("s", f"c{i}", (1, 0, "p", f"t{i}")) for i in (0, 3, 9)],
                                    "site_key string, url_key string, seen struct<page_id: long, pos: int, url: string, absolute: string>")
    assert [tuple(x) for x in links.broken_links(targets, ends).collect()] == [("s", "p", "t3", 503)]


def test_nothing_was_fetched(spark):
    assert links.link_ends(spark.createDataFrame([], SCHEMA)).count() == 0
