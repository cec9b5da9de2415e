"""One nested document per audit."""

from pyspark.sql import DataFrame, functions as F



def _listed(rows: DataFrame, name: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of a site as one ordered array.  Only for results with a bounded number per site."""
    return rows.groupBy("site_key").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))


def assemble(
    sites: DataFrame, scores: DataFrame, categories: DataFrame, checks: DataFrame, recommended: DataFrame,
    compared: DataFrame, pages: DataFrame, failures: DataFrame,
) -> DataFrame:
    """Scores, findings, fix list and competitors of each site in one row.

    The pages of a site have no bound, so they stay a table of their own (``page_section``); the
    document carries their number."""
    read = pages.groupBy("site_key").agg(F.count("*").alias("pages_crawled"))
    lost = failures.groupBy("site_key").agg(F.count("*").alias("pages_failed"))
    parts = [
        scores.select("site_key", "overall_score", "band"),
        _listed(categories, "categories", "category_order", ["category", "score", "available", "base_weight", "effective_weight", "summary"]),
        _listed(checks, "findings", "sort_order", ["check_id", "category", "status", "severity", "points", "max_points", "evidence"]),
        _listed(recommended, "recommendations", "priority", ["check_id", "horizon", "impact", "effort", "expected_impact"]),
        _listed(compared, "competitors", "rank", ["url", "name", "status", "quick_score", "missing_types"]),
        read, lost,
    ]
    out = sites.select("site_key", "business_name", "location", "primary_services", "page_limit")
    for part in parts:
        out = out.join(part, "site_key", "left")
    return out.fillna(0, ["pages_crawled", "pages_failed", "overall_score"])


def as_json(documents: DataFrame) -> DataFrame:
    return documents.select("site_key", F.to_json(F.struct(*documents.columns)).alias("document"))


def page_section(signals: DataFrame, failures: DataFrame) -> DataFrame:
    """Page rows of the report, failures included."""
    good = signals.selectExpr("site_key", "url", "role", "title", "status_code", "word_count", "schema_types",
                              "size(question_headings) > 0 AS has_questions", "CAST(NULL AS STRING) AS error")
    bad = failures.selectExpr("site_key", "url", "CAST(NULL AS STRING) AS role", "CAST(NULL AS STRING) AS title", "CAST(NULL AS INT) AS status_code",
                              "CAST(NULL AS INT) AS word_count", "CAST(NULL AS ARRAY<STRING>) AS schema_types", "false AS has_questions", "code AS error")
    return good.unionByName(bad)
