"""Registered queries that write, assemble, or walk the corpus."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from corpuscope.operators import crawl, recommend, robots, scoring
from corpuscope.plans import report
from corpuscope.plans.audit import bound_signals
from corpuscope.plans.audit_queries import audit_of, checks_of, weighed
from corpuscope.sources import audit_store, io


def _write_results(spark, sf):
    """Page results written twice as one audit per site: the second run replaces the first."""
    path = f"{io.shared_folder(spark)}/results-{uuid.uuid4().hex}"
    rows = io.materialize(bound_signals(spark, sf).selectExpr("site_key AS audit_id", "page_id", "url", "title", "role", "word_count"))
    audits = rows.select("audit_id").distinct()
    io.write_results(rows, path, ["page_id"], audits)
    io.write_results(rows.where("word_count >= 0"), path, ["page_id"], audits)
    return spark.read.parquet(path).select("audit_id", "page_id", "url", "title", "role", "word_count")


AUDIT_TABLES = {  # what an audit leaves, and the columns that tell its rows apart
    "pages": (["page_id"], "CAST(page_id AS STRING)", "concat_ws(' ', role, CAST(word_count AS STRING))"),
    "findings": (["check_id"], "check_id", "concat_ws(' ', status, severity)"),
    "category_scores": (["category"], "category", "concat_ws(' ', CAST(score AS STRING), tier)"),
    "scores": ([], "''", "concat_ws(' ', CAST(overall_score AS STRING), band)"),
    "fixes": (["check_id"], "check_id", "concat_ws(' ', CAST(priority AS STRING), horizon)"),
}


def _write_audit(spark, sf):
    """All tables of all audits, published; then those of some sites once more, which must leave the store as it is."""
    path = f"{io.shared_folder(spark)}/audits-{uuid.uuid4().hex}"
    audit = audit_of(spark, sf)
    checks = io.materialize(audit.checks())
    weighted = weighed(checks)
    parts = {"pages": audit.signals, "findings": checks, "category_scores": scoring.category_summaries(weighted),
             "scores": scoring.with_band(scoring.overall(weighted)), "fixes": recommend.recommendations(checks)}
    tables = {name: (df.withColumnRenamed("site_key", "audit_id"), AUDIT_TABLES[name][0]) for name, df in parts.items()}
    audits = checks.select(F.col("site_key").alias("audit_id")).distinct()
    audit_store.publish(spark, path, tables, audits)
    audit_store.publish(spark, path, {name: tables[name] for name in ("findings", "fixes")}, audits.where("xxhash64(audit_id) % 2 = 0"))
    number, _ = audit_store.manifest(spark, path)
    read = [audit_store.results(spark, path, name, number).selectExpr("audit_id", f"'{name}' AS part", f"{key} AS key", f"{value} AS value")
            for name, (_, key, value) in AUDIT_TABLES.items()]
    return reduce(DataFrame.unionByName, read)


def _export_csv(spark, sf):
    path = f"{io.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = recommend.recommendations(checks_of(spark, sf))
    io.export_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


def _documents(spark, sf):
    audit = audit_of(spark, sf)
    checks = io.materialize(audit.checks())
    weighted = weighed(checks)
    return report.assemble(
        audit.sites, scoring.with_band(scoring.overall(weighted)), scoring.category_summaries(weighted), checks,
        recommend.recommendations(checks), audit.compared(), audit.signals, audit.failures,
    )


def _outline(spark, sf):
    """What each document holds, flattened so that it can be compared."""
    return _documents(spark, sf).selectExpr(
        "site_key", "business_name", "overall_score", "band", "pages_crawled", "pages_failed",
        "array_join(transform(categories, c -> concat(c.category, '=', c.score)), ' ') AS categories",
        "array_join(transform(findings, f -> concat(f.check_id, '=', f.status)), ' ') AS findings",
        "array_join(transform(slice(recommendations, 1, 5), r -> r.check_id), ' ') AS first_fixes",
        "coalesce(array_join(transform(competitors, c -> concat(c.url, '=', c.status)), ' '), '') AS competitors",
    )


def _crawl(spark, sf):
    audit = audit_of(spark, sf)
    rules = robots.select_group(robots.robots_lines(audit.files))
    return crawl.crawl_select(audit.signals, audit.sites, rules)


def _page_section(spark, sf):
    audit = audit_of(spark, sf)
    return report.page_section(audit.signals, audit.failures).withColumn("schema_types", F.array_join("schema_types", " | "))


QUERIES = {
    "k4_crawl_select": _crawl,
    "s3_write_results": _write_results,
    "s3_write_audit": _write_audit,
    "s4_export_csv": _export_csv,
    "t1_report_assemble": lambda spark, sf: report.as_json(_documents(spark, sf)),
    "t1_report_outline": _outline,
    "t1_page_section": _page_section,
}
