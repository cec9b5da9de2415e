"""From check rows to category scores, the overall score, its band and the summary."""

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.functions.sqltext import q
from corpuscope.operators.checks.framework import stairs
from corpuscope.operators.running import running

_ORDER = {c[0]: i for i, c in enumerate(lx.CATEGORIES)}


def _per_category(field: int) -> str:
    kind = (lambda v: q(v)) if field == 1 else (lambda v: f"{v}D")
    return "CASE category " + " ".join(f"WHEN {q(c[0])} THEN {kind(c[field])}" for c in lx.CATEGORIES) + " END"


def category_order(column: str = "category") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(c)} THEN {i}" for c, i in _ORDER.items()) + " END"


def category_scores(checks: DataFrame) -> DataFrame:
    """Score, points and outcome counts per site and category; all seven categories present."""
    counts = "applicable AND max_points > 0"
    folded = checks.groupBy("site_key", "category").agg(
        # points have three decimals: summed as whole thousandths, so the order does not matter
        F.expr(f"coalesce(sum(CASE WHEN {counts} THEN CAST(round(points * 1000) AS BIGINT) END), 0L)").alias("raw"),
        F.expr(f"coalesce(sum(CASE WHEN {counts} THEN CAST(round(max_points * 1000) AS BIGINT) END), 0L)").alias("most"),
        F.expr(f"count_if({counts})").alias("applicable"),
        *[F.expr(f"count_if(status = '{s}' AND applicable)").alias(n) for s, n in
          [("PASS", "passed"), ("WARN", "warned"), ("FAIL", "failed")]],
    )
    names = "array(" + ", ".join(q(c[0]) for c in lx.CATEGORIES) + ")"
    grid = checks.select("site_key").distinct().selectExpr("site_key", f"explode({names}) AS category")
    return grid.join(folded, ["site_key", "category"], "left").selectExpr(
        "site_key", "category", f"{category_order()} AS category_order",
        "coalesce(applicable, 0) > 0 AS available",
        "CASE WHEN most > 0 THEN CAST(floor(least(1D, greatest(0D, CAST(raw AS DOUBLE) / most)) * 100 + 0.5) AS INT) ELSE 0 END AS score",
        "floor((coalesce(raw, 0L) + 5) / 10D) / 100D AS raw_points", "floor((coalesce(most, 0L) + 5) / 10D) / 100D AS max_points",
        "coalesce(passed, 0) AS passed", "coalesce(warned, 0) AS warned", "coalesce(failed, 0) AS failed",
        f"{_per_category(2)} AS base_weight",
    )


def rebalance(scores: DataFrame) -> DataFrame:
    """Spread the weight of unavailable categories over the others in proportion."""
    weight = "CASE WHEN available THEN base_weight ELSE 0D END"
    total = F.sum(F.expr(weight)).over(Window.partitionBy("site_key"))
    return scores.withColumn("_total", total).selectExpr(
        *scores.columns, f"CASE WHEN _total > 0 THEN round({weight} / _total, 4) ELSE 0D END AS effective_weight"
    )


def band(score: str) -> str:
    return f"CASE WHEN {score} IS NULL THEN 'critical' ELSE {stairs(score, lx.BANDS[:-1], lx.BANDS[-1][1])} END"


def overall(weighted: DataFrame) -> DataFrame:
    """Overall score from the rounded category scores and the rounded weights, in that order."""
    total = "sum(CASE WHEN available THEN score * effective_weight ELSE 0D END)"
    return weighted.groupBy("site_key").agg(
        F.expr(f"CAST(floor(least(100D, greatest(0D, round({total}, 6))) + 0.5) AS INT)").alias("overall_score"),
        F.expr("count_if(available)").alias("categories"),
    )


def with_band(scores: DataFrame) -> DataFrame:
    return scores.selectExpr("*", f"{band('overall_score')} AS band")


def category_summaries(scores: DataFrame) -> DataFrame:
    """Tier and a line of counts for each category."""
    counts = "concat(': passed ', passed, ', partly met ', warned, ', failed ', failed)"
    text = f"concat({_per_category(1)}, CASE WHEN available THEN {counts} ELSE ': not measured' END)"
    return scores.selectExpr("*", f"{band('score')} AS tier", f"{text} AS summary")


def site_summary(checks: DataFrame, weighted: DataFrame, strengths: DataFrame, weaknesses: DataFrame) -> DataFrame:
    """One sentence set per site: best and worst category, severe findings, top three each way."""
    extremes = weighted.where("available").groupBy("site_key").agg(
        F.expr("max_by(category, score * 10 - category_order)").alias("best"),
        F.expr("min_by(category, score * 10 - category_order)").alias("worst"),
        F.max("score").alias("best_score"), F.min("score").alias("worst_score"),
    )
    severe = checks.groupBy("site_key").agg(
        F.expr("count_if(severity = 'CRITICAL')").alias("critical"), F.expr("count_if(severity = 'HIGH')").alias("high")
    )

    def titles(df, name):
        return df.groupBy("site_key").agg(F.array_sort(F.collect_list(F.struct("rank", "check_id"))).alias("_l")).selectExpr(
            "site_key", f"array_join(transform(_l, x -> x.check_id), ', ') AS {name}")

    out = (
        overall(weighted).join(extremes, "site_key", "left").join(severe, "site_key", "left")
        .join(titles(strengths, "strengths"), "site_key", "left").join(titles(weaknesses, "weaknesses"), "site_key", "left")
    )
    text = """concat(site_key, ' scores ', overall_score, ' of 100. ',
      CASE WHEN best <> worst THEN concat('Best: ', best, ' (', best_score, '); weakest: ', worst, ' (', worst_score, '). ') ELSE '' END,
      CASE WHEN critical > 0 THEN concat(critical, ' critical and ', high, ' high findings come first.')
           WHEN high > 0 THEN concat('No critical finding; ', high, ' high ones remain.') ELSE 'No severe finding.' END)"""
    return out.selectExpr(
        "site_key", "overall_score", "best", "worst", "critical", "high", "coalesce(strengths, '') AS strengths",
        "coalesce(weaknesses, '') AS weaknesses", f"{text} AS summary",
    )


def score_history(audits: DataFrame) -> DataFrame:
    """Each completed audit with the score of the one before it for the same user and domain."""
    done = audits.where("status = 'COMPLETED' AND NOT is_deleted")
    held = running(
        done, ["user_id", "domain"], ["created_at", "audit_id"],
        {"previous_score": ("last", F.col("overall_score"), "before")}, F.date_trunc("month", "created_at"),
    )
    return held.selectExpr(
        "audit_id", "user_id", "domain", "overall_score", "previous_score", "overall_score - previous_score AS delta"
    )
