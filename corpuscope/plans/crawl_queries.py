"""Registered queries over links, fetches and robots files."""

from pyspark.sql import functions as F

from corpuscope.functions import urls as u
from corpuscope.operators import links, robots
from corpuscope.plans.page_queries import signals
from corpuscope.sources import bindings as b, io


def _files(spark, sf):
    return b.bind(spark, sf, b.SITE_FILES_SQL)


def _lines(spark, sf):
    return robots.robots_lines(_files(spark, sf))


def _broken_links(spark, sf):
    targets = io.materialize(links.unseen_targets(signals(spark, sf)))
    return links.broken_links(targets, links.link_ends(b.link_fetches(targets)))


def _link_ends(spark, sf):
    return links.link_ends(b.link_fetches(io.materialize(links.unseen_targets(signals(spark, sf)))))  # the log reads them twice


def _selected_rules(spark, sf):
    chosen = robots.select_group(_lines(spark, sf))
    text = F.transform("rules", lambda r: F.concat(r["type"], F.lit(" "), r["path"]))
    return chosen.select("site_key", "match_rank", F.array_join(text, " | ").alias("rules"), "crawl_delay")


def _path_allowed(spark, sf):
    pages = b.bind(spark, sf, b.SITE_PAGES_SQL).selectExpr("page_id", "site_key", f"{u.path('url')} AS path")
    return robots.check_paths(pages, _lines(spark, sf))


def _ai_blocked(spark, sf):
    return robots.ai_access(_lines(spark, sf)).withColumn("blocked_agents", F.array_join("blocked_agents", " | "))


QUERIES = {
    "k1_page_links": lambda spark, sf: links.page_links(signals(spark, sf)),
    "k2_crawl_candidates": lambda spark, sf: links.crawl_candidates(signals(spark, sf)),
    "k3_crawl_priority": lambda spark, sf: links.with_priority(links.crawl_candidates(signals(spark, sf))).select(
        "page_id", "candidate", "priority"),
    "k5_broken_links": _broken_links,
    "k5_link_ends": _link_ends,
    "k6_fetch_outcomes": lambda spark, sf: links.fetch_outcomes(b.bind(spark, sf, b.FETCH_LOG_SQL)),
    "k7_robots_parse": _lines,
    "k8_robots_select_group": _selected_rules,
    "k9_robots_path_allowed": _path_allowed,
    "k10_robots_ai_blocked": _ai_blocked,
    "k11_site_file_facts": lambda spark, sf: robots.site_file_facts(_files(spark, sf)),
}
