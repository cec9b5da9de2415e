"""Registered queries of the audit."""

from pyspark.sql import functions as F

from corpuscope.functions import urls as u
from corpuscope.operators import compare, recommend, scoring
from corpuscope.operators.checks.site_facts import check_examples
from corpuscope.plans import audit as plan
from corpuscope.plans.page_queries import signals
from corpuscope.sources import bindings as b, io


def audit_of(spark, sf):
    return plan.bound_audit(spark, sf)


def checks_of(spark, sf):
    """Check rows of a run of its own, from markup on; kept because most queries read them twice."""
    return io.materialize(plan.bound_audit(spark, sf, plan.UNCHECKED).checks())


def weighed(checks):
    return scoring.rebalance(scoring.category_scores(checks))


def weighted_of(spark, sf):
    return scoring.rebalance(scoring.category_scores(checks_of(spark, sf)))


def family(name):
    return lambda spark, sf: plan.bound_audit(spark, sf, plan.UNCHECKED).family(name)


def snaps(*columns):
    return lambda spark, sf: compare.snapshots(signals(spark, sf)).selectExpr("page_id", *columns)


def _summary(spark, sf):
    checks = checks_of(spark, sf)
    return scoring.site_summary(checks, weighed(checks), recommend.strengths(checks), recommend.weaknesses(checks))


def _search(spark, sf):
    sites = b.bind(spark, sf, b.SITES_SQL).selectExpr("*", f"{u.registrable_domain('site_key')} AS domain")
    seen = compare.search_observations(b.bind(spark, sf, b.SEARCH_RESULTS_SQL), sites)
    return seen.withColumn("top_domains", F.array_join("top_domains", " | "))


QUERIES = {
    **{f"c{i}_checks_{n}": family(n) for i, n in enumerate(plan.FAMILIES, 1)},
    "c5_checks_structured_data": plan.structured_data,
    "c7_checks_competitive": lambda spark, sf: audit_of(spark, sf).competitive(),
    "c8_checks_all": checks_of,
    "c8_check_examples": lambda spark, sf: check_examples(audit_of(spark, sf).signals),
    "c0_make_check": lambda spark, sf: checks_of(spark, sf).groupBy("status", "severity", "applicable").agg(
        F.count("*").alias("n"), F.round(F.sum("points"), 2).alias("points"), F.sum("max_points").alias("max_points")),
    "g1_category_scores": lambda spark, sf: scoring.category_scores(checks_of(spark, sf)),
    "g2_rebalance_weights": lambda spark, sf: weighted_of(spark, sf).select(
        "site_key", "category", "available", "base_weight", "effective_weight"),
    "g3_overall_score": lambda spark, sf: scoring.overall(weighted_of(spark, sf)),
    "g4_score_band": lambda spark, sf: scoring.with_band(scoring.overall(weighted_of(spark, sf))),
    "g4_category_summary": lambda spark, sf: scoring.category_summaries(weighted_of(spark, sf)).select(
        "site_key", "category", "score", "tier", "summary"),
    "g5_site_summary": _summary,
    "g6_score_history": lambda spark, sf: scoring.score_history(b.bind(spark, sf, b.AUDITS_SQL)),
    "r1_recommendations": lambda spark, sf: recommend.recommendations(checks_of(spark, sf)).select(
        "site_key", "priority", "check_id", "category", "severity", "impact", "effort"),
    "r2_horizon": lambda spark, sf: recommend.horizon_counts(recommend.recommendations(checks_of(spark, sf))),
    "r3_expected_impact": lambda spark, sf: recommend.recommendations(checks_of(spark, sf)).select(
        "site_key", "check_id", "horizon", "shortfall", "expected_impact"),
    "r4_strengths": lambda spark, sf: recommend.strengths(checks_of(spark, sf)),
    "r5_weaknesses": lambda spark, sf: recommend.weaknesses(checks_of(spark, sf)),
    "r6_cross_site_rollup": lambda spark, sf: recommend.cross_site_rollup(checks_of(spark, sf)),
    "x1_competitor_pick": lambda spark, sf: plan.asked_competitors(spark, sf, plan.bound_sites(spark, sf)),
    "x2_quick_score": snaps("quick_score"),
    "x3_competitor_category_scores": snaps(*compare.CATEGORY_SCORES),
    "x4_competitor_name": snaps("name"),
    "x5_competitor_highlights_gaps": snaps(
        "array_join(highlights, ' | ') AS highlights", "array_join(gaps, ' | ') AS gaps"),
    "x6_competitor_compare": lambda spark, sf: audit_of(spark, sf).compared().withColumn(
        "missing_types", F.array_join("missing_types", " | ")),
    "v1_preview_score": lambda spark, sf: compare.preview_score(signals(spark, sf)),
    "v2_preview_findings": lambda spark, sf: compare.preview_findings(signals(spark, sf)),
    "q1_search_queries": lambda spark, sf: compare.search_queries(b.bind(spark, sf, b.SITES_SQL)),
    "q2_search_observations": _search,
}
