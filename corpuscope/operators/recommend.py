"""The fix list.  A site has at most one row per check, so per-site windows are bounded."""

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.functions.sqltext import q
from corpuscope.operators.checks.catalog import CATALOG


def _rank(column: str, names) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(names)) + " END"


SEVERITY_RANK = _rank("severity", lx.SEVERITIES)
IMPACT_RANK = _rank("impact", ["HIGH", "MEDIUM", "LOW"])
EFFORT_RANK = _rank("effort", ["LOW", "MEDIUM", "HIGH"])
CATEGORY_RANK = "CASE category " + " ".join(f"WHEN {q(c[0])} THEN {c[3]}" for c in lx.CATEGORIES) + " END"
ACTIONABLE = "applicable AND status IN ('FAIL', 'WARN') AND severity <> 'PASSED'"


def recommendations(checks: DataFrame) -> DataFrame:
    order = Window.partitionBy("site_key").orderBy(
        *[F.expr(t) for t in (SEVERITY_RANK, IMPACT_RANK, EFFORT_RANK, CATEGORY_RANK)], "check_id"
    )
    ranked = checks.where(ACTIONABLE).withColumn("priority", F.row_number().over(order))
    horizon = """CASE WHEN severity = 'CRITICAL' THEN 'DO_FIRST' WHEN severity = 'HIGH' AND effort <> 'HIGH' THEN 'DO_FIRST'
      WHEN effort = 'LOW' AND priority <= 8 THEN 'DO_FIRST' WHEN effort = 'HIGH' THEN 'LONGER_TERM'
      WHEN severity = 'LOW' THEN 'LONGER_TERM' ELSE 'NEXT_30_DAYS' END"""
    lost = "max_points - points"
    size = f"CASE WHEN {lost} >= 7 THEN 'large' WHEN {lost} >= 4 THEN 'meaningful' WHEN {lost} >= 2 THEN 'modest' ELSE 'small' END"
    return ranked.selectExpr(
        "site_key", "priority", "check_id", "category", "severity", "impact", "effort", f"{horizon} AS horizon",
        f"round({lost}, 3) AS shortfall", f"{size} AS expected_impact",
    )


def horizon_counts(recommended: DataFrame) -> DataFrame:
    return recommended.groupBy("site_key").agg(
        *[F.expr(f"count_if(horizon = '{h}')").alias(h.lower()) for h in ("DO_FIRST", "NEXT_30_DAYS", "LONGER_TERM")]
    )


def _top(checks: DataFrame, order: list, limit: int) -> DataFrame:
    w = Window.partitionBy("site_key").orderBy(*order)
    return checks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        "site_key", "rank", "check_id", "category", "severity"
    )


def strengths(checks: DataFrame, limit: int = 3) -> DataFrame:
    good = checks.where("status = 'PASS' AND applicable AND max_points >= 5")
    return _top(good, [F.desc("max_points"), F.col("check_id")], limit)


def weaknesses(checks: DataFrame, limit: int = 3) -> DataFrame:
    bad = checks.where("applicable AND status IN ('FAIL', 'WARN')")
    return _top(bad, [F.expr(SEVERITY_RANK), F.expr("points - max_points"), F.col("check_id")], limit)


def cross_site_rollup(checks: DataFrame) -> DataFrame:
    """Findings over all sites by category, pivoted on severity."""
    severities = {f"severity_{s.lower()}": f"count_if(severity = '{s}')" for s in lx.SEVERITIES}
    return checks.groupBy("category").agg(
        F.count("*").alias("findings"), F.expr("count_if(applicable)").alias("applicable"),
        *[F.expr(t).alias(n) for n, t in severities.items()],
    )


def titled(checks: DataFrame) -> DataFrame:
    """Check rows with their titles (a constant map, not a join)."""
    pairs = ", ".join(f"{q(row[0])}, {q(row[5])}" for row in CATALOG)
    return checks.selectExpr("*", f"map({pairs})[check_id] AS title")
