"""Home pages against competitors' home pages, the one-page preview, search observations."""

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.functions import html as h
from corpuscope.functions import lexicon as lx
from corpuscope.functions import urls as u
from corpuscope.functions.sqltext import each, first, keep, let, q, strings
from corpuscope.operators.checks.framework import Check, stairs, toward
from corpuscope.operators.joins import lookup

_CORE_ORG = f"arrays_overlap(schema_types, {strings(lx.CORE_ORG_TYPES)})"


def _when(test: str, points: float) -> str:
    return f"IF({test}, {points}, 0)"


def _pick(cases, otherwise=0) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {p}" for t, p in cases) + f" ELSE {otherwise} END"


QUICK_SCORE = "least(100, " + " + ".join([
    _when("is_https", 8), _when("canonical IS NOT NULL", 4), _when("lang_attr IS NOT NULL", 4), _when("viewport IS NOT NULL", 4),
    _pick([("title_length >= 25", 8), ("title IS NOT NULL", 4)]),
    _pick([("meta_description_length >= 50", 7), ("meta_description IS NOT NULL", 3)]),
    _pick([("size(h1) = 1", 7), ("size(h1) > 1", 3)]),
    _pick([("word_count >= 800", 18), ("word_count >= 500", 14), ("word_count >= 300", 9), ("word_count >= 150", 4)]),
    _when(_CORE_ORG, 10), _pick([("size(schema_types) >= 3", 6), ("size(schema_types) >= 1", 3)]),
    _when("array_contains(schema_types, 'FAQPage')", 4),
    _pick([("size(question_headings) >= 3", 7), ("size(question_headings) >= 1", 4)]),
    _when("has_faq_signals", 3), _when("list_count >= 2", 2), _when("size(phones) > 0 OR size(emails) > 0", 4),
    _when("size(address_signals) > 0", 2), _when("size(authors) > 0", 2), _when("size(open_graph) >= 3", 2),
]) + ")"

CATEGORY_SCORES = {
    "technical": " + ".join([_when("is_https", 35), _when("canonical IS NOT NULL", 20), _when("lang_attr IS NOT NULL", 15),
                             _when("viewport IS NOT NULL", 15), _when("is_indexable", 15)]),
    "entity": " + ".join([
        _pick([("title_length >= 25", 30), ("title IS NOT NULL", 15)]),
        _pick([("meta_description_length >= 50", 25), ("meta_description IS NOT NULL", 12)]),
        _pick([("size(h1) = 1", 25), ("size(h1) > 1", 12)]), _when("size(open_graph) >= 3", 20)]),
    "content": " + ".join([
        _pick([("word_count >= 800", 45), ("word_count >= 500", 35), ("word_count >= 300", 22)], 8),
        _pick([("paragraph_count >= 6", 25), ("paragraph_count >= 3", 15)], 5),
        _pick([("factual_data_points >= 3", 20), ("factual_data_points >= 1", 10)]), _when("size(vague_phrases) = 0", 10)]),
    "answer": " + ".join([
        _pick([("size(question_headings) >= 3", 35), ("size(question_headings) >= 1", 20)]), _when("has_faq_signals", 25),
        _pick([("list_count >= 2", 20), ("list_count >= 1", 10)]), _when("table_count >= 1", 10), _when("size(headings) >= 5", 10)]),
    "structured": " + ".join([
        _when(_CORE_ORG, 40), _pick([("size(schema_types) >= 3", 25), ("size(schema_types) >= 1", 12)]),
        _when("array_contains(schema_types, 'FAQPage')", 20),
        _when("size(json_ld) > 0 AND forall(json_ld, b -> b.valid)", 15)]),
    "trust": " + ".join([
        _when("size(phones) > 0", 25), _when("size(emails) > 0", 20), _when("size(address_signals) > 0", 25),
        _when("size(authors) > 0", 15), _when("outbound_citation_links > 0", 15)]),
}


def _name() -> str:
    def choose(parts):
        last = f"element_at({parts}, -1)"
        return (
            f"CASE WHEN size({parts}) = 0 THEN NULL WHEN length({last}) BETWEEN 3 AND 40 THEN {last}"
            f" ELSE substring({first(parts)}, 1, 60) END"
        )

    pieces = keep(each(f"split(coalesce(title, ''), {q('[|—–·-]')})", h.trim_ws), lambda p: f"{p} <> ''")
    return f"coalesce({let(pieces, choose)}, {u.registrable_domain(u.host('url'))})"


HIGHLIGHTS = [
    ("size(schema_types) >= 3", "concat('schema-types=', array_join(schema_types, '+'))"),
    ("word_count >= 600", "concat('long-copy=', word_count)"),
    ("size(question_headings) >= 3", "concat('questions=', size(question_headings))"),
    ("has_faq_signals", "'faq'"),
    ("size(address_signals) > 0 AND size(phones) > 0", "'address-and-phone'"),
    ("factual_data_points >= 3", "concat('facts=', factual_data_points)"),
]
GAPS = [
    ("size(schema_types) = 0", "'no-schema'"),
    ("word_count < 300", "concat('short-copy=', word_count)"),
    ("size(question_headings) = 0", "'no-questions'"),
    ("meta_description IS NULL", "'no-description'"),
    ("size(phones) = 0 AND size(emails) = 0", "'no-contact'"),
    ("size(vague_phrases) > 2", "concat('filler=', size(vague_phrases))"),
]


def _notes(rules) -> str:
    """Codes of the rules that hold, with the figure that made them; wording is left to the reader's side."""
    return "array_compact(array(" + ", ".join(f"CASE WHEN {t} THEN {m} END" for t, m in rules) + "))"


def snapshots(signals: DataFrame) -> DataFrame:
    """Home-page figures that a comparison needs (a projection)."""
    return signals.selectExpr(
        "page_id", "site_key", "url", f"{_name()} AS name", f"{QUICK_SCORE} AS quick_score",
        *[f"least(100, {text}) AS {name}" for name, text in CATEGORY_SCORES.items()],
        f"{_notes(HIGHLIGHTS)} AS highlights", f"{_notes(GAPS)} AS gaps",
        "schema_types", "word_count", "size(question_headings) AS question_count", "has_faq_signals",
    )


def pick_competitors(requested: DataFrame, limit: int | str) -> DataFrame:
    """Requested addresses, valid ones, one per registrable domain (the first), at most ``limit``.

    ``requested(site_key, pos, raw)``: the rows of a site come from one form and are few.  ``limit`` is a
    number, or an expression over the other columns of ``requested``, such as the limit of the owner's plan.
    """
    valid = requested.where(f"{u.rejection_code('raw')} IS NULL").selectExpr(
        "site_key", "pos", f"{u.normalize('raw')} AS url", f"{u.registrable_domain(u.host(u.with_scheme('raw')))} AS domain", f"{limit} AS bound",
    )
    firsts = valid.groupBy("site_key", "domain").agg(F.min("pos").alias("pos"), F.min_by("url", "pos").alias("url"), F.max("bound").alias("bound"))
    order = Window.partitionBy("site_key").orderBy("pos")
    return firsts.withColumn("rank", F.row_number().over(order)).where("rank <= bound").drop("bound")


def _compare_key(c: str) -> str:
    return f"lower(concat({u.bare_host(c)}, {h.replace(u.path(c), '/+$')}))"


def compare(snaps: DataFrame, seeds: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per requested competitor: its snapshot when its page is in the corpus."""
    pages = snaps.selectExpr(
        f"{_compare_key('url')} AS compare_key", "page_id", "name", "quick_score", "schema_types", "word_count",
        "question_count", "has_faq_signals",
    )
    asked = chosen.selectExpr("site_key", "rank", "url", f"{_compare_key('url')} AS compare_key")
    pages = pages.join(asked.select("compare_key").distinct(), "compare_key", "left_semi")  # few of all pages go on
    best = pages.groupBy("compare_key").agg(F.min_by(F.struct(*[c for c in pages.columns if c != "compare_key"]), "page_id").alias("c"))
    ours = seeds.select("site_key", F.col("schema_types").alias("own_types"))
    joined = asked.join(best, "compare_key", "left").join(ours, "site_key", "left")
    return joined.select(
        "site_key", "rank", "url", F.col("c.name").alias("name"),
        F.when(F.col("c").isNotNull(), "ANALYZED").otherwise("FAILED").alias("status"),
        F.col("c.quick_score").alias("quick_score"),
        F.col("c.word_count").alias("word_count"), F.col("c.question_count").alias("question_count"),
        F.size("c.schema_types").alias("type_count"),
        F.array_except("c.schema_types", F.coalesce("own_types", F.array().cast("array<string>"))).alias("missing_types"),
    )


def competitor_facts(compared: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row per site that asked for a comparison."""
    ok = "status = 'ANALYZED'"
    folded = compared.groupBy("site_key").agg(
        F.count("*").alias("requested"), F.count_if(F.expr(ok)).alias("analyzed"),
        F.avg("quick_score").alias("avg_score"), F.max("quick_score").alias("best_score"),
        F.avg("word_count").alias("avg_words"),
        F.avg("question_count").alias("avg_questions"),
        F.expr(f"avg(CASE WHEN {ok} THEN type_count END)").alias("avg_types"),
        F.expr(f"max_by(url, CASE WHEN {ok} THEN quick_score * 1000 - rank END)").alias("strongest"),
    )
    own = seeds.selectExpr(
        "site_key", "quick_score AS own_score", "word_count AS own_words", "question_count AS own_questions", "size(schema_types) AS own_types"
    )
    return folded.join(own, "site_key", "left").fillna(0, ["own_score", "own_words", "own_questions", "own_types"])


def competitive_checks() -> list[Check]:
    seen = "analyzed > 0"
    gap = "(own_score - avg_score)"

    def against(own, avg, floor):
        return f"CASE WHEN {avg} = 0 THEN {floor} ELSE {toward(own, f'greatest(1D, {avg})')} END"

    def level(own, avg):
        return f"CASE WHEN {own} >= {avg} THEN 'PASS' WHEN {own} > 0 THEN 'WARN' ELSE 'FAIL' END"

    return [
        Check("competitive.unavailable", "0D", "'NOT_APPLICABLE'", {"requested": "requested"}, when="analyzed = 0"),
        Check("competitive.overall-signals", f"0.5D + {gap} / 100", stairs(gap, [(5, "PASS"), (-10, "WARN")], "FAIL"),
              {"own": "own_score", "best": "best_score", "analyzed": "analyzed"}, when=seen),
        Check("competitive.structured-data", against("own_types", "avg_types", "CASE WHEN own_types > 0 THEN 1D ELSE 0.5D END"),
              level("own_types", "avg_types"), {"own": "own_types"}, when=seen),
        Check("competitive.content-depth", against("own_words", "avg_words", "1D"),
              "CASE WHEN own_words >= avg_words * 0.9D THEN 'PASS' WHEN own_words >= avg_words * 0.5D THEN 'WARN' ELSE 'FAIL' END",
              {"own": "own_words"}, when=seen),
        Check("competitive.answer-readiness", against("own_questions", "avg_questions", "CASE WHEN own_questions > 0 THEN 1D ELSE 0.5D END"),
              level("own_questions", "avg_questions"), {"own": "own_questions"}, when=seen),
    ]


# ---- preview of one page ----------------------------------------------------------------

PREVIEW = [  # title, category, weight, severity, test
    ("Served over HTTPS", "TECHNICAL_ACCESSIBILITY", 10, "HIGH", "is_https"),
    ("May be indexed", "TECHNICAL_ACCESSIBILITY", 10, "CRITICAL", "is_indexable"),
    ("Title has a useful length", "ENTITY_CLARITY", 9, "MEDIUM", "title_length BETWEEN 25 AND 70"),
    ("Description is present", "ENTITY_CLARITY", 8, "MEDIUM", "meta_description_length >= 50"),
    ("One main heading", "ENTITY_CLARITY", 7, "MEDIUM", "size(h1) = 1"),
    ("Organisation is declared", "STRUCTURED_DATA", 12, "HIGH", _CORE_ORG),
    ("Structured data parses", "STRUCTURED_DATA", 6, "HIGH", "size(json_ld) > 0 AND forall(json_ld, b -> b.valid)"),
    ("Copy has substance", "CONTENT_AUTHORITY", 11, "HIGH", "word_count >= 350"),
    ("Headings ask questions", "ANSWER_READINESS", 9, "MEDIUM", "size(question_headings) >= 2"),
    ("Frequent questions", "ANSWER_READINESS", 6, "MEDIUM", "has_faq_signals"),
    ("Contact details", "TRUST_AND_EVIDENCE", 8, "MEDIUM", "size(phones) > 0 OR size(emails) > 0 OR size(address_signals) > 0"),
    ("Canonical address", "ENTITY_CLARITY", 5, "LOW", "canonical IS NOT NULL"),
]


def preview_checks(signals: DataFrame) -> DataFrame:
    rank = {s: i for i, s in enumerate(lx.SEVERITIES)}
    entries = ", ".join(
        f"named_struct('position', {i}, 'title', {q(t)}, 'category', {q(c)}, 'weight', {w}, 'severity', {q(s)}, 'rank', {rank[s]}, 'passed', {test})"
        for i, (t, c, w, s, test) in enumerate(PREVIEW)
    )
    return signals.selectExpr("page_id", "url", f"array({entries}) AS checks")


def preview_score(signals: DataFrame) -> DataFrame:
    total = sum(row[2] for row in PREVIEW)
    earned = "aggregate(checks, 0, (a, c) -> a + IF(c.passed, c.weight, 0))"
    return preview_checks(signals).selectExpr(
        "page_id", "url", f"CAST(floor(100D * {earned} / {total} + 0.5) AS INT) AS score",
        "size(filter(checks, c -> NOT c.passed)) AS issues",
    )


def preview_findings(signals: DataFrame) -> DataFrame:
    """Failed checks by severity and weight, filled up with passed ones; five per page.

    The twelve checks of a page are sorted inside its row: no shuffle."""
    key = "named_struct('p', c.passed, 'r', IF(c.passed, 0, c.rank), 'w', -c.weight, 'i', c.position, 'c', c)"
    ordered = f"slice(array_sort(transform(checks, c -> {key})), 1, {lx.PREVIEW_MAX_FINDINGS})"
    return preview_checks(signals).selectExpr("page_id", f"posexplode({ordered}) AS (pos, s)").selectExpr(
        "page_id", "pos + 1 AS rank", "s.c.title", "s.c.category", "IF(s.p, 'PASSED', s.c.severity) AS severity", "s.p AS passed"
    )


# ---- search -----------------------------------------------------------------------------


def search_queries(sites: DataFrame) -> DataFrame:
    service = "nullif(trim(split(coalesce(primary_services, ''), '[,;]')[0]), '')"
    asked = (
        f"array(concat(business_name, ' ', coalesce({service}, 'services')), concat(business_name, ' ', coalesce(location, 'reviews')),"
        f" concat(business_name, ' reviews'),"
        f" CASE WHEN {service} IS NULL THEN concat(business_name, ' expertise') ELSE trim(concat('best ', {service}, ' ', coalesce(location, ''))) END)"
    )
    return sites.selectExpr("site_key", f"posexplode(slice(array_distinct({asked}), 1, 4)) AS (pos, query)")


def search_observations(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Whether the brand shows in the results of each query, and which hosts lead.

    Hosts are made distinct by an aggregate before the eight best per query are ranked."""
    dim = sites.select("site_key", "business_name", "domain")
    hosted = results.selectExpr("site_key", "query", "rank", "lower(link) AS link", "lower(title) AS title", f"{u.bare_host('link')} AS host")
    shown = (F.col("link").contains(F.lower("domain"))) | F.col("title").contains(F.lower("business_name"))
    seen = lookup(hosted, dim, ["site_key"], "rank", "inner").groupBy("site_key", "query").agg(
        F.count("*").alias("result_count"), F.coalesce(F.bool_or(shown), F.lit(False)).alias("brand_appears")
    )
    firsts = hosted.where("host <> ''").groupBy("site_key", "query", "host").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("site_key", "query").orderBy("rank", "host")
    top = (
        firsts.withColumn("n", F.row_number().over(order)).where("n <= 8").groupBy("site_key", "query")
        .agg(F.array_sort(F.collect_list(F.struct("n", "host"))).alias("hosts"))
    )
    return seen.join(top, ["site_key", "query"], "left").select(
        "site_key", "query", "result_count", "brand_appears",
        F.coalesce(F.transform("hosts", lambda x: x["host"]), F.array().cast("array<string>")).alias("top_domains"),
    )
