"""What an audit parses, and shortcuts that leave its results as they are."""

from corpuscope.functions import html as h
from corpuscope.functions import lexicon as lx
from corpuscope.functions import urls as u
from corpuscope.functions.sqltext import let
from corpuscope.operators import ledger, links
from corpuscope.operators.checks import site_facts
from corpuscope.plans import audit, audit_queries, output_queries
from corpuscope.sources import bindings as b, io

SF = "/root/testdata/sf0.001"


def test_written_results_need_only_their_columns(spark, monkeypatch):
    stored, keep = [], io.materialize
    monkeypatch.setattr(io, "materialize", lambda df: stored.append(df.columns) or keep(df))
    got = output_queries.QUERIES["s3_write_results"](spark, SF)
    assert got.count() > 0 and not [c for c in stored if "links" in c or "main_text" in c]


def test_structured_data_stores_no_signals(spark, monkeypatch):
    whole = audit.bound_audit(spark, SF).family("structured_data").collect()
    stored, keep = [], io.materialize
    monkeypatch.setattr(io, "materialize", lambda df: stored.append(df.columns) or keep(df))
    got = audit_queries.QUERIES["c5_checks_structured_data"](spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole)) != []
    assert not [c for c in stored if "links" in c or "main_text" in c]


def test_sites_are_stored_with_the_limits_of_all_owners(spark):
    sites = audit.bound_sites(spark, SF)
    assert not [f for f in sites.inputFiles() if "orders" in f or "customer" in f]
    entitled = ledger.entitlements(b.bind(spark, SF, b.USERS_SQL), b.bind(spark, SF, b.SUBSCRIPTIONS_SQL))
    limits = {r.user_id: (r.page_limit, r.competitor_limit) for r in ledger.audit_limits(entitled).collect()}
    got = {r.owner_id: (r.page_limit, r.competitor_limit) for r in sites.collect()}
    _, _, _, *free = lx.PLANS[0]
    assert got and got == {owner: limits.get(owner, tuple(free)) for owner in got}


def test_checks_find_targets_once_and_parse_what_they_read(spark, monkeypatch):
    whole = audit.bound_audit(spark, SF).checks().collect()
    stored, keep, asked, find = [], io.materialize, [], links.unseen_targets
    monkeypatch.setattr(io, "materialize", lambda df: stored.append(df.columns) or keep(df))
    monkeypatch.setattr(links, "unseen_targets", lambda signals: asked.append(1) or find(signals))
    got = audit_queries.checks_of(spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole)) != []
    assert len(asked) == 1
    assert [c for c in stored if "main_text" in c] and not [c for c in stored if set(c) & {"twitter_card", "microdata_types", "charset"}]


def test_hints_lose_no_match(spark):
    texts = [
        "", "Nothing here.", "A TESTIMONIAL", "see one Review.", "the Client said so", "What our customers say", "Rated 4 of 5", "rated well",
        "Our Data", "our research", "OUR SURVEY", "our study", "our analysis", "We surveyed", "we analyzed", "we measured", "we tested",
        "35 projects", "12  Installations", "40 client", "99customers", "20 HOMES", "17 jobs", "7 jobs", "tile vs. slate", "Versus", "compared to",
        "a comparison", "difference between", "which is better", "Pros and cons", "alternatives to", "Step 2", "How to", "our process",
        "the process", "what to expect", "Certified", "licensed", "accredited", "years of experience", "degree", "qualified", "member of",
        "board-certified", "board certified", "Master", "journeyman", "registered", "According to", "source:x", "Sources:x", "data from",
        "published by", "as reported by", "per the", "based on data", "what our clients say", "Case stud", "success stor", "reviewed us",
        "a ★b", "é★é", "RATED 4.5 out of", "License #44", "lic. # 7", "LIC 5", "EIN: 12", "ein#3", "Registration number", "registration #",
        "Since 1998", "established  2004", "founded in 1911", "Founded 2020", "founded 3020", "I\u0307stanbul since 1999", "\u0130 our data",
        "Arkansas", "kansas", "WEST VIRGINIA", "new york", "new yorker", "North Dakota", "mississippi", "missouri", "Nevada.", "Oregonian",
        "The Barrier is a membrane", "Terms are the rule", "Slate means an answer", "Ridge refers to the top", "it is a test",
    ]
    rows = spark.createDataFrame([(t, t.lower()) for t in texts], "main_text string, plain string").selectExpr("main_text", "lower(main_text) AS lower_text")
    facts = site_facts._page_facts()
    patterns = {
        "testimonial": lx.TESTIMONIAL_PATTERN, "own_data": lx.ORIGINAL_DATA_PATTERN, "project_counts": lx.PROJECT_COUNT_PATTERN,
        "compares": lx.COMPARISON_TEXT_PATTERN, "process": lx.PROCESS_PATTERN, "credentials": lx.CREDENTIAL_PATTERN, "sources": lx.SOURCE_PATTERN,
        "proof": lx.PROOF_PATTERN, "licence": lx.LICENCE_PATTERN, "founded": lx.FOUNDED_YEAR_PATTERN, "us_state": lx.US_STATE_PATTERN,
    }
    assert set(site_facts.HINTS) == set(patterns.values()) - {lx.US_STATE_PATTERN}
    for name, pattern in patterns.items():
        got = rows.selectExpr("main_text", f"{facts[name]} AS got", f"{h.matches('main_text', pattern)} AS want").collect()
        assert [r for r in got if r.want] and not [r for r in got if r.got != r.want], name
    got = rows.selectExpr(f"{facts['definitions']} AS got", f"{h.count_matches('main_text', lx.DEFINITION_PATTERN)} AS want").collect()
    assert sum(r.want for r in got) > 3 and all(r.got == r.want for r in got)


def test_plain_paths_resolve_like_all_others(spark):
    hrefs = ["/", "/a", "/a/", "/a/b.html", "/a//b", "//x.example/a", "/./a", "/a/../b", "/a/..", "/a/.b", "/a./b", "/a?x=/../y#z", "/a#b?c", "/a#b#c",
             "/?q", "/#f", "/a b", "/\u00e9", "/a%20b", "/a|b", "/a{b}", "/a:80/b@c", "/a\n", "/a?x y", "/a?\u00e9", "b/c", "?q", "https://Y.example/a"]
    bases = ["https://www.X.example/p/q?r", "http://u:p@x.example:80/p", "https://x.example:8443", "ftp://x.example/p", "https:///p", "http://[::1]:80/p", "http://x.example:80:80/p"]
    rows = spark.createDataFrame([(f, base) for f in hrefs for base in bases], "href string, url string")
    plain = let(u.base_parts("url"), lambda p: f"CASE WHEN {u.is_plain('href', p)} THEN named_struct('a', concat({p}.origin, href), 'h', {p}.host) END")
    got = rows.selectExpr("*", f"{plain} AS plain", f"{u.resolve('href', 'url')} AS a").selectExpr("*", f"{u.bare_host('a')} AS h").where("plain IS NOT NULL").collect()
    assert len({r.href for r in got}) > 8
    assert not [r for r in got if (r.plain.a, r.plain.h) != (r.a, r.h)]
