"""A controlled site with planted strengths and weaknesses, a bare site, and order independence."""

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import compare, scoring
from corpuscope.operators.checks import site_facts
from corpuscope.operators.links import unseen_targets
from corpuscope.operators.signals import page_signals
from corpuscope.plans.audit import Audit, run

SITE = "ridgevale.com"
FOOTER = ("<footer>Ridgevale Roofing, <address>4 Mill Lane, Denver, CO 80211</address> (720) 555-0168 "
          "hello@ridgevale.com <a href='/privacy-policy'>Privacy</a><a href='/terms'>Terms</a></footer>")
ORG = ('{"@type":"LocalBusiness","name":"Ridgevale Roofing","url":"https://ridgevale.com","telephone":"+1-720-555-0168",'
       '"logo":"l.png","description":"d","email":"e","address":{"name":"4 Mill Lane"},"sameAs":["https://x.example"],"areaServed":"Denver"}')
SAME = "<p>Ridgevale Roofing offers inspections for homeowners and property managers across Colorado every week of the year.</p>"


def _page(path, title, body, schema=None, description=True, words=200):
    head = (f"<title>{title} | Ridgevale Roofing</title><meta name=viewport content=w><link rel=canonical href='{path}'>"
            "<meta property='og:title' content=t><meta property='og:description' content=d>")
    if description:
        head += f"<meta name=description content='Ridgevale Roofing provides {title} in Denver for every kind of home, page {path}.'>"
    if schema:
        head += f"<script type='application/ld+json'>{schema}</script>"
    nav = "".join(f"<li><a href='{p}'>{p}</a> </li>" for p in ("/", "/about", "/contact", "/faq", "/services/repair", "/blog/ice"))
    filler = "<p>" + f"For {title} we measured, compared and noted every slope in words of {path} alone. " * (words // 14) + "</p>"
    return f"<html lang=en><head>{head}</head><body><ul>{nav}</ul><h1>{title}</h1>{body}{filler if words else ''}{FOOTER}</body></html>"


PAGES = {
    "/": _page("/", "Roof repair and inspection", "<p>Ridgevale Roofing is a licensed contractor that serves homeowners and property managers across Denver; established 1998, license #4471.</p><h2>What does it cost?</h2><a href='/gone'>old</a>", ORG, words=500),
    "/about": _page("/about", "About the Ridgevale crew", "<p>We are certified master roofers, founded in 1998 in Denver, with 40 projects a year.</p>", ORG, words=450),
    "/services/repair": _page("/services/repair", "Slate repair for homes", SAME + "<h2>How long does it take?</h2>", words=300),
    "/services/replace": _page("/services/replace", "Full roof replacement", SAME + "<h2>Steps</h2><p>Our process: step 1 inspection, a world-class crew and the best slate in town for you.</p>", words=300),
    "/services/gutter": _page("/services/gutter", "Gutter work and care", "<p>Gutters carry rain away from walls, and we clean 30 homes each month in autumn.</p><img src=a><img src=b>", words=300),
    "/faq": _page("/faq", "Frequently asked questions", "<h2>Is it safe?</h2><h2>Who pays?</h2><h2>When do you come?</h2>", '{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Q"}]}', words=250),
    "/contact": _page("/contact", "Contact the office today", "<p>Call us.</p>", words=0),
    "/blog/ice": _page("/blog/ice", "Ice dams, explained well", "<p class=byline>By Marcus Vail</p><time datetime='2024-03-14'>x</time><p>An Ice Dam is a ridge at the eave, according to the 2021 code of Colorado roofs.</p><a href='https://code.example.org'>Building code</a>",
                        '{"@type":"BlogPosting","author":{"@type":"Person","name":"Marcus Vail"},"datePublished":"2024-03-14"}', words=300),
    "/privacy-policy": _page("/privacy-policy", "Privacy policy of the firm", "", description=False, words=200),
}
ROBOTS = "User-agent: *\nDisallow: /cart\n\nUser-agent: GPTBot\nAllow: /\nSitemap: https://ridgevale.com/sitemap.xml\n"


def _audit(spark, shuffle=False):
    rows = [(i, SITE, f"https://{SITE}{p}", h) for i, (p, h) in enumerate(PAGES.items())]
    rows.append((100, "bare.com", "http://bare.com/", "<title>x</title><h1>x</h1>"))
    pages = spark.createDataFrame(rows, "page_id long, site_key string, url string, html string").withColumn("fetch_ms", F.lit(300))
    if shuffle:
        pages = pages.orderBy(F.desc("url")).repartition(5, "html")
    signals = page_signals(pages).cache()
    sites = spark.createDataFrame(
        [(SITE, 0, "Ridgevale Roofing", "roof repair, inspection", 10), ("bare.com", 100, "Bare Things", None, 10)],
        "site_key string, seed_page_id long, business_name string, primary_services string, page_limit int")
    files = spark.createDataFrame(
        [(SITE, "/robots.txt", 200, ROBOTS), (SITE, "/sitemap.xml", 200, "<urlset>" + "<url><loc>u</loc></url>" * 9)],
        "site_key string, path string, status_code int, body string")
    failures = spark.createDataFrame([], "site_key string, url string, code string")
    asked = spark.createDataFrame([(SITE, 0, "http://bare.com")], "site_key string, pos int, raw string")
    fetched = unseen_targets(signals).selectExpr("url_key", "404 AS status", "CAST(NULL AS STRING) AS location_key", "CAST(NULL AS STRING) AS error")
    return Audit(signals, sites, failures, files, fetched, compare.pick_competitors(asked, 1), as_of="2024-06-30 00:00:00")


@pytest.fixture(scope="module")
def tables(spark):
    return run(_audit(spark))


@pytest.fixture(scope="module")
def found(tables):
    return {(r.site_key, r.check_id): r for r in tables["site_checks"].collect()}


PASS = [
    "schema.organization-present", "schema.same-as", "schema.faq", "schema.organization-completeness", "schema.author", "trust.contact-details",
    "trust.contact-page", "tech.robots-txt", "tech.sitemap", "tech.ai-crawler-access", "tech.https", "tech.viewport", "tech.lang", "tech.canonical",
    "entity.brand-name-prominence", "entity.what-we-do", "entity.audience-definition", "entity.about-page", "content.freshness",
    "answer.faq-coverage", "trust.legitimacy-markers", "competitive.overall-signals", "tech.response-time",
]
NOT_PASS = ["content.vague-language", "content.unsupported-superlatives", "content.thin-pages", "content.duplication", "answer.comparison-content", "tech.image-alt"]


def test_planted_strengths(found):
    assert {c: found[SITE, c].status for c in PASS} == dict.fromkeys(PASS, "PASS")


def test_planted_weaknesses(found):
    assert all(found[SITE, c].status in ("WARN", "FAIL") for c in NOT_PASS), {c: found[SITE, c].status for c in NOT_PASS}
    assert found[SITE, "tech.llms-txt"].status == "INFO" and found[SITE, "tech.llms-txt"].points == 0 and found[SITE, "tech.llms-txt"].applicable
    assert found[SITE, "tech.broken-links"].status in ("WARN", "FAIL")


def test_bounds(found):
    assert len([1 for s, _ in found if s == SITE]) == 75
    assert len([1 for s, _ in found if s == "bare.com"]) == 71  # asked for no comparison
    assert all(0 <= r.points <= r.max_points for r in found.values())
    assert all(r.points == r.max_points == 0 for r in found.values() if not r.applicable)


def test_scores(tables):
    got = {r.site_key: r.overall_score for r in tables["site_scores"].collect()}
    assert 45 <= got[SITE] <= 92 and got["bare.com"] < got[SITE]


def test_order_of_input_does_not_matter(spark, tables):
    again = run(_audit(spark, shuffle=True))
    for name in ("site_checks", "site_scores", "recommendations"):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, tables[name].collect()))


def test_one_hot_site_gives_the_same_rows(spark):
    """Copies of a page under one site only move counts: every site keeps its own result."""
    rows = [(i, f"https://hot.com/p{i}", PAGES["/about"]) for i in range(300)] + [(1000, "https://cold.com/about", PAGES["/about"])]
    signals = page_signals(spark.createDataFrame(rows, "page_id long, url string, html string"))
    counts = signals.groupBy("site_key").agg(F.countDistinct("word_count").alias("kinds"), F.count("*").alias("n"))
    assert {r.site_key: (r.kinds, r.n) for r in counts.collect()} == {"hot.com": (1, 300), "cold.com": (1, 1)}


def test_bands_of_run(tables):
    for r in tables["site_scores"].collect():
        assert r.band in {"excellent", "good", "fair", "poor", "critical"}
    assert scoring.band("overall_score").startswith("CASE")


def test_opening_goes_on_after_a_short_first_paragraph(spark):
    greeting, late = "<p>Welcome to the roofing pages of our firm in Denver.</p>", "<p>" + "word " * 80 + "</p>"
    answer = "<p>Ridgevale Roofing provides slate repair for homes in Denver, and every inspection takes one visit of an hour or less.</p>"
    rows = [(0, greeting + answer), (1, answer), (2, late + answer), (3, greeting)]
    pages = spark.createDataFrame([(i, f"https://a{i}.com/", f"<html><body><h1>x</h1>{h}</body></html>") for i, h in rows],
                                  "page_id long, url string, html string")
    tests = site_facts._page_facts()
    got = page_signals(pages).selectExpr("page_id", f"{tests['front_loaded']} AS front", f"{tests['summarised']} AS summary")
    assert {r.page_id: (r.front, r.summary) for r in got.collect()} == {
        0: (True, True), 1: (True, True), 2: (False, False), 3: (False, False)}
