"""From one wide row per site to one row per check."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpuscope.functions.sqltext import q
from corpuscope.operators.checks.catalog import BY_ID


@dataclass(frozen=True)
class Check:
    """SQL texts over the site row; ``when`` tells for which sites the check exists."""

    check_id: str
    ratio: str
    status: str
    evidence: dict[str, str]
    when: str = "true"
    impact: str | None = None


def by_ratio(ratio: str, pass_at: float = 0.85, warn_at: float = 0.4) -> str:
    return f"CASE WHEN {ratio} >= {pass_at}D THEN 'PASS' WHEN {ratio} >= {warn_at}D THEN 'WARN' ELSE 'FAIL' END"


def share(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN CAST(({part}) AS DOUBLE) / ({whole}) ELSE 0D END"


def toward(value: str, target: str) -> str:
    return f"least(1D, greatest(0D, CAST({value} AS DOUBLE) / ({target})))"


def stairs(value: str, cuts, otherwise) -> str:
    """First cut from the top that the value reaches."""
    whens = " ".join(f"WHEN {value} >= {at} THEN {_lit(r)}" for at, r in cuts)
    return f"CASE {whens} ELSE {_lit(otherwise)} END"


def ladder(value: str, cuts, otherwise) -> str:
    """First cut from the bottom that the value does not exceed."""
    whens = " ".join(f"WHEN {value} <= {upto} THEN {_lit(r)}" for upto, r in cuts)
    return f"CASE {whens} ELSE {_lit(otherwise)} END"


def _lit(v) -> str:
    return q(v) if isinstance(v, str) else f"{float(v)}D"


def _severity(status: str, ratio: str, max_points: str) -> str:
    lost = f"{max_points} * (1D - {ratio})"
    return (
        f"CASE WHEN {status} = 'PASS' THEN 'PASSED' WHEN {status} IN ('INFO', 'NOT_APPLICABLE') THEN 'INFORMATIONAL'"
        f" WHEN {status} = 'FAIL' THEN {stairs(lost, [(8, 'CRITICAL'), (5, 'HIGH'), (2.5, 'MEDIUM')], 'LOW')}"
        f" ELSE {stairs(lost, [(6, 'HIGH'), (3, 'MEDIUM')], 'LOW')} END"
    )


def _entry(c: Check) -> str:
    order, category, points, effort, impact, _title = BY_ID[c.check_id]
    evidence = "concat_ws(';', " + ", ".join(
        f"concat({q(k + '=')}, CAST({v} AS STRING))" for k, v in c.evidence.items()
    ) + ")"
    return (
        f"named_struct('sort_order', {order}, 'check_id', {q(c.check_id)}, 'category', {q(category)},"
        f" 'status', {c.status}, 'ratio', least(1D, greatest(0D, {c.ratio})), 'points', {points}D, 'effort', {q(effort)},"
        f" 'impact', {c.impact or q(impact)}, 'evidence', {evidence}, 'present', {c.when})"
    )


def make_checks(sites: DataFrame, checks: list[Check]) -> DataFrame:
    """One row per site and check.  The catalogue is part of the expressions: no join."""
    entries = "array(" + ", ".join(_entry(c) for c in checks) + ")"
    long = sites.selectExpr("site_key", f"explode({entries}) AS c").where(F.col("c.present"))
    return long.selectExpr(
        "site_key", "c.check_id", "c.category", "c.sort_order", "c.status",
        f"{_severity('c.status', 'c.ratio', 'c.points')} AS severity",
        "CASE WHEN c.status = 'NOT_APPLICABLE' THEN 0D ELSE round(c.ratio * c.points, 3) END AS points",
        "CASE WHEN c.status = 'NOT_APPLICABLE' THEN 0D ELSE c.points END AS max_points",
        "c.status <> 'NOT_APPLICABLE' AS applicable",
        "c.effort", "c.impact", "c.evidence",
    )
