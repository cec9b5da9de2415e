"""Which pages of a site an audit reads: bounded breadth-first selection over a fetched corpus.

The queue of a site is its home page's targets by priority; every page that is read may append its
five best targets that are not queued yet.  Such a queue is worked off level by level, so each
level is a few joins over all sites at once.  Per site a level holds the targets of at most
``page_limit`` pages; nothing grows with the number of pages a site has in the corpus.
"""

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.functions import urls as u
from corpuscope.operators.joins import lookup
from corpuscope.operators.links import candidates_text
from corpuscope.operators.robots import path_allowed
from corpuscope.sources.io import materialize


def page_targets(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """Candidates of each page against its site's origin: (page_id, url_key, targets in order)."""
    home = sites.selectExpr("site_key", "seed_page_id").join(
        signals.selectExpr("page_id AS seed_page_id", f"{u.origin('url')} AS site_origin"), "seed_page_id"
    ).select("site_key", "site_origin")
    targets = lookup(signals, home, ["site_key"], "page_id", "inner").selectExpr(
        "page_id", "site_key", f"{u.key('url')} AS url_key", f"{candidates_text('site_origin')} AS targets"
    )
    # One page per key: the first that was fetched.
    return targets.groupBy("site_key", "url_key").agg(
        F.min("page_id").alias("page_id"), F.min_by("targets", "page_id").alias("targets"))


def _ranked(rows: DataFrame) -> DataFrame:
    """(site_key, parent, url, url_key, priority, pos): targets of pages, best first per parent."""
    return rows.select("site_key", F.col("position").alias("parent"), F.posexplode("targets").alias("pos", "candidate")).selectExpr(
        "site_key", "parent", "pos", "candidate AS url", f"{u.key('candidate')} AS url_key", f"{u.crawl_priority('candidate')} AS priority"
    )


def _append(fresh: DataFrame, page_limit: int) -> DataFrame:
    """Parents in order, each appending its best targets that no earlier parent appended.

    A parent can lose at most ``5 * (parents before it)`` of its targets to earlier ones, so its
    best ``5 * page_limit`` decide; the fold per site sees no more than that."""
    best = Window.partitionBy("site_key", "parent").orderBy("priority", "pos")
    few = fresh.withColumn("n", F.row_number().over(best)).where(F.col("n") <= lx.DISCOVERED_PER_PAGE * page_limit)
    item = F.struct("n", "url", "url_key")
    parents = few.groupBy("site_key", "parent").agg(F.array_sort(F.collect_list(item)).alias("items"))
    lists = parents.groupBy("site_key").agg(F.array_sort(F.collect_list(F.struct("parent", "items"))).alias("lists"))
    step = (
        f"(acc, p) -> concat(acc, slice(filter(p.items, i -> NOT exists(acc, a -> a.url_key = i.url_key)), 1, {lx.DISCOVERED_PER_PAGE}))"
    )
    folded = lists.selectExpr("site_key", f"aggregate(lists, slice(flatten(lists.items), 1, 0), {step}) AS queue")
    return folded.select("site_key", F.posexplode("queue").alias("position", "i")).select(
        "site_key", "position", F.col("i.url").alias("url"), F.col("i.url_key").alias("url_key"))


def crawl_select(signals: DataFrame, sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages read and refused per site: (site_key, level, position, url, page_id, outcome).

    Each site has its own ``page_limit``; the largest bounds the number of levels."""
    largest = sites.agg(F.max("page_limit")).first()[0] or 0
    corpus = materialize(page_targets(signals, sites))
    seeds = sites.select("site_key", F.col("seed_page_id").alias("page_id")).join(
        corpus.drop("site_key"), "page_id")
    start = seeds.selectExpr("site_key", "0 AS position", "url_key", "page_id", "targets")
    done = [start.selectExpr("site_key", "0 AS level", "position", "url_key AS url", "page_id", "'READ' AS outcome")]
    queued = start.select("site_key", "url_key")
    used = start.join(sites.select("site_key", "page_limit"), "site_key").selectExpr("site_key", "page_limit", "1 AS used")
    parents = start
    for level in range(1, largest):
        ranked = _ranked(parents)
        fresh = ranked.join(queued, ["site_key", "url_key"], "left_anti")
        if level == 1:
            first = fresh.groupBy("site_key", "url_key").agg(F.min(F.struct("priority", "pos", "url")).alias("b"))
            order = Window.partitionBy("site_key").orderBy("b.priority", "b.pos")
            queue = first.select("site_key", "url_key", F.col("b.url").alias("url"), (F.row_number().over(order) - 1).alias("position"))
        else:
            queue = _append(fresh, largest)
        known = queue.join(corpus.select("site_key", "url_key", "page_id", "targets"), ["site_key", "url_key"], "left")
        ruled = known.join(rules.select("site_key", "rules"), "site_key", "left").selectExpr(
            "site_key", "position", "url", "url_key", "page_id", "targets",
            f"CASE WHEN NOT {path_allowed(u.path('url'))} THEN 'ROBOTS_DISALLOWED' WHEN page_id IS NULL THEN 'NOT_FETCHED' ELSE 'READ' END AS outcome")
        # A page counts against the limit when it is read; what comes after the last one stays queued.
        before = Window.partitionBy("site_key").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
        counted = materialize(
            ruled.withColumn("read_before", F.coalesce(F.sum(F.expr("IF(outcome = 'READ', 1, 0)")).over(before), F.lit(0)))
        )
        taken = counted.join(used, "site_key").where("used + read_before < page_limit").drop("used", "read_before", "page_limit")
        if taken.isEmpty():
            break
        done.append(taken.selectExpr("site_key", f"{level} AS level", "position", "url", "page_id", "outcome"))
        queued = queued.unionByName(counted.select("site_key", "url_key"))
        read = taken.where("outcome = 'READ'")
        more = read.groupBy("site_key").agg(F.count("*").cast("int").alias("more"))
        used = materialize(used.join(more, "site_key", "left").selectExpr("site_key", "page_limit", "used + coalesce(more, 0) AS used"))
        parents = read.join(used.where("used < page_limit").select("site_key"), "site_key", "left_semi")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
