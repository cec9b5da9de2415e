"""Signals and URL rules on hand-written pages."""

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import urls as u
from corpuscope.operators.signals import page_signals

RICH = """<!doctype html><html lang="en-US"><head><!-- <title>no</title> --><title> Ridge &amp; Vale &#8212; slate </title>
<meta content="Slate > tile: we provide &quot;repair&quot; for homes of every age in the county" name="description">
<link rel="canonical" href="/about/"><meta property="og:title" content="A"><meta property='og:title' content='B'>
<script type="application/ld+json">{"@type":"Organization","name":"Ridge","sameAs":["x"],"address":{"@type":"PostalAddress","name":"12 St"},"author":{"@id":"me"}}</script>
<script type="application/ld+json">{bad</script><script>var x = "<h1>no</h1> words here";</script></head>
<body class="x"><h1>What is slate?</h1><h3>Jump</h3><p>This paragraph is surely longer than forty characters &copy; &nbsp; ok<p>short<div>y</div>
<a href="../x?a=1#f" rel=nofollow>T</a><a href="mailto:a@b.co">mail me</a><A HREF="//Foo.com:443">foo bar</A><a href="#top">x</a>
<img alt="" src=a><img src=b><img alt=ok src=c><span class="byline big">By Jane Doe</span>
<address>1 Main <b>St</b></address> call 303-555-0142 CO 80211 12 years 5% unparalleled
<time datetime="2024-01-02">x</time><div itemscope itemtype="https://schema.org/Product"></div></body></html>"""


@pytest.fixture(scope="module")
def rich(spark):
    pages = spark.createDataFrame([(1, "https://www.foo.com/a/b/c", RICH)], "page_id long, url string, html string")
    return page_signals(pages).first()


def test_head(rich):
    assert rich.title == "Ridge & Vale — slate"
    assert rich.meta_description.startswith('Slate > tile: we provide "repair"')
    assert rich.canonical == "https://www.foo.com/about/" and not rich.canonical_is_self
    assert rich.lang_attr == "en-US" and rich.open_graph == {"og:title": "B"}


def test_body(rich):
    assert rich.h1 == ["What is slate?"] and rich.question_headings == ["What is slate?"]
    assert not rich.heading_hierarchy_valid
    assert rich.paragraph_count == 1 and rich.first_paragraph.endswith("characters © ok")
    assert (rich.image_count, rich.images_with_alt, rich.images_with_empty_alt) == (3, 1, 1)
    assert rich.phones == ["303-555-0142"] and rich.emails == ["a@b.co"]
    assert rich.address_signals == ["1 Main St", "CO 80211", "12 St"]
    assert rich.factual_data_points == 2 and rich.vague_phrases == ["unparalleled"]
    assert rich.microdata_types == ["Product"] and rich.published_date == "2024-01-02"


def test_links(rich):
    got = [(n.absolute, n.internal, n.nofollow) for n in rich.links]
    assert got == [("https://www.foo.com/a/x?a=1#f", True, True), ("mailto:a@b.co", False, False), ("https://foo.com/", True, False)]
    assert (rich.internal_links, rich.external_links, rich.outbound_citation_links) == (2, 1, 1)


def test_structured_data(rich):
    assert [b.valid for b in rich.json_ld] == [True, False]
    assert rich.schema_types == ["Organization", "PostalAddress"]
    assert dict(rich.json_ld[0]["values"]) == {"name": "Ridge", "author": "me", "address": "12 St"}
    assert rich.authors == ["me", "Jane Doe"]


def test_filters_on_structured_columns(spark):
    pages = spark.createDataFrame([(1, "https://foo.com/", RICH), (2, "https://foo.com/b", "<p>x</p>")], "page_id long, url string, html string")
    kept = page_signals(pages).where(F.array_contains("schema_types", "Organization") & F.size("json_ld").isNotNull())
    assert [r.page_id for r in kept.select("page_id", "title").collect()] == [1]


def test_odd_markup_does_not_break_a_task(spark):
    long = "<a " + "x" * 200_000
    html = ["<p title='" + "y" * 100_000, long, "", "<" * 50_000, "&#xFFFFFF; &#55555555; &bogus; " * 200, "<html><body>" + "<div>" * 20_000]
    pages = spark.createDataFrame([(i, "https://foo.com/", t) for i, t in enumerate(html)], "page_id long, url string, html string")
    assert page_signals(pages).count() == len(html)
    assert page_signals(pages).agg(F.sum("word_count")).first()[0] >= 0


URLS = [
    ("example.com", None), ("  https://example.com./a ", None), ("https://1.1.1.1/", None), ("", "EMPTY"), ("ftp://x.com", "UNSUPPORTED_SCHEME"),
    ("javascript:alert(1)", "UNSUPPORTED_SCHEME"), ("https://u:p@x.com", "CREDENTIALS_IN_URL"), ("http://10.1.2.3", "PRIVATE_ADDRESS"),
    ("http://127.0.0.1:80", "LOOPBACK_ADDRESS"), ("http://169.254.169.254", "METADATA_ENDPOINT"), ("http://169.254.1.1", "LINK_LOCAL_ADDRESS"),
    ("http://[::1]/", "LOOPBACK_ADDRESS"), ("http://[::ffff:10.0.0.1]/", "PRIVATE_ADDRESS"), ("http://[fc00::1]/", "PRIVATE_ADDRESS"),
    ("http://localhost", "BLOCKED_HOSTNAME"), ("http://a.internal", "BLOCKED_HOSTNAME"), ("http://intranet", "BLOCKED_HOSTNAME"),
    ("http://x.com:22", "BLOCKED_PORT"), ("http://x.com:99999", "MALFORMED"), ("https://x.com:443", None), ("http://x.com:8080", None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(r,) for r, _ in URLS], "raw string").selectExpr("raw", f"{u.rejection_code('raw')} AS code")
    assert {r.raw: r.code for r in df.collect()} == dict(URLS)


def test_url_normalize(spark):
    cases = {
        "Example.COM": "https://example.com/",
        "https://x.com:443/a/../b?utm_source=q&b=1&ref=z#t": "https://x.com/b?b=1",
        "http://x.com/é?flag": "http://x.com/%C3%A9?flag=",
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw string").selectExpr("raw", f"{u.normalize('raw')} AS n")
    assert {r.raw: r.n for r in df.collect()} == cases


def test_registrable_domain(spark):
    cases = {"www.a.b.com": "b.com", "x.y.co.uk": "y.co.uk", "b.com": "b.com", "127.0.0.1": "127.0.0.1"}
    df = spark.createDataFrame([(c,) for c in cases], "h string").selectExpr("h", f"{u.registrable_domain('h')} AS d")
    assert {r.h: r.d for r in df.collect()} == cases


def test_patterns_cost_one_pass_and_find_the_same(spark):
    import time

    from corpuscope.functions import html as h
    from corpuscope.functions import lexicon as lx
    from corpuscope.operators.signals import EMAIL, link_nodes, paragraph_texts, word_count

    texts = ["a@b.com_x@c.de", "x.@y@z.org,q@r.s t%u@v-w.info", "no mail @ all", "a   b  c\td  ", "-- a1,b --- 7\n(c) !", "<p>" + "long enough words " * 3 + "<b>x</b> < y</p>z<p>short"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").selectExpr(
        "i", f"{h.extract_all('t', EMAIL)} AS mails", f"{h.extract_all('t', lx.EMAIL_PATTERN)} AS plain", f"{h.squeeze('t')} AS squeezed",
        f"{word_count('t')} AS words", f"{paragraph_texts('t')} AS paragraphs", f"{link_nodes('t', repr('https://a.b/'), repr('a.b'))} AS links").orderBy("i").collect()
    assert all(r.mails == r.plain for r in rows) and rows[0].mails == ["a@b.com", "_x@c.de"]
    assert rows[3].squeezed == "a b c d" and rows[4].words == 3
    assert rows[5].paragraphs == ["long enough words " * 3 + "x < y"]
    began = time.time()
    run = spark.range(1).selectExpr("1L AS page_id", "'https://a.b/' AS url", "concat(repeat('a', 400000), ' m@n.org') AS html")
    assert page_signals(run).select("emails").first().emails == ["m@n.org"] and time.time() - began < 60


def test_word_scan_trim_and_addresses_equal_the_plain_patterns(spark):
    from corpuscope.functions import html as h
    from corpuscope.functions import lexicon as lx
    from corpuscope.operators.signals import EMAIL, email_texts

    words = {"a-dfghik-pr-w": lx.US_STATE_PATTERN, "0-9": lx.PROJECT_COUNT_PATTERN, "elr": lx.LICENCE_PATTERN, "acdpvw": lx.COMPARISON_TEXT_PATTERN}
    texts = ["TEXAS", "xtexas, texass; (new york)", "a12 homes 12 homes", "12homes", "public lic. #7", "éein: 5", "a vs. b", "vs.", "", "...", "x@y.org,p@q.com@r.net z@", "@", "a@b.c@d.ef g"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(
        "t", *[f"{h.matches_word('t', s, p)} = {h.matches('t', p)} AS same{i}" for i, (s, p) in enumerate(words.items())],
        f"{email_texts('t')} <=> {h.extract_all('t', EMAIL)} AS mails").collect()
    assert all(all(r[1:]) for r in rows)
    ends = spark.createDataFrame([("  a b \n",), ("a \u0085",)], "t string").selectExpr(f"{h.trim_ws('t')} AS t").collect()
    assert [r.t for r in ends] == ["a b", "a \u0085"]  # "$" also ended before a last line end, and took the blank there
