"""Checks for the audit: site facts, the seven families, scores, fix list, comparison, preview, search."""

from corpuscope.functions import lexicon as lx
from corpuscope.operators.checks.catalog import CATALOG
from corpuscope.operators.compare import PREVIEW
from corpuscope.sources import bindings as b
from oracles import fragments as f
from oracles.crawl_sql import BROKEN, ROBOTS
from oracles.fragments import let, members, q, strings
from oracles.limits import SITES
from oracles.page_sql import _KEPT, _TEXTUAL, URL_CTE
from oracles.signals import SIGNALS

m = "main_text"


def re(text, pattern):
    return f"regexp_matches({text}, {q(pattern)})"


def n(test):
    return f"count(*) FILTER (WHERE {test})"


def any_(test):
    return f"coalesce(bool_or({test}), false)"


# The analysed pages only; the rest are failures.
FETCHED = SIGNALS.replace(
    "rp AS (", f"allp AS ({b.SITE_PAGES_SQL}), rp AS (SELECT * FROM allp WHERE {_TEXTUAL} AND status_code < 400), unused AS (", 1
)
_H = "FILTER (WHERE seed)"
FACTS = f"""
ps AS (SELECT sig.*, page_id = seed_page_id AS seed, list_filter(string_split_regex(lower(business_name), '\\s+'), lambda t: length(t) > 2 AND t NOT IN {members(lx.BRAND_STOP_WORDS)}) AS tok,
  list_filter(string_split_regex(lower(business_name), '\\s+'), lambda t: length(t) > 2) AS tok2, primary_services FROM sig JOIN sites USING (site_key)),
orgb AS (SELECT page_id, min(bpos) AS bpos FROM typed WHERE type_name IN {members(lx.ORG_TYPES)} GROUP BY 1),
orgc AS (SELECT o.page_id, (SELECT count(*) FROM vals v WHERE v.page_id = o.page_id AND v.bpos = o.bpos AND key IN {members(lx.ORG_REQUIRED)}) / 2.0 * 0.5
   + (SELECT count(*) FROM vals v WHERE v.page_id = o.page_id AND v.bpos = o.bpos AND key IN {members(lx.ORG_VALUABLE)}) / 6.0 * 0.5 AS complete FROM orgb o),
sameas AS (SELECT DISTINCT page_id FROM (SELECT page_id FROM props WHERE key = 'sameAs' UNION ALL SELECT page_id FROM vals WHERE key = 'sameAs') AS x),
tok AS (SELECT site_key, page_id, unnest(list_filter(list_transform(string_split_regex(lower(coalesce(primary_services, '')), '[,;]'), lambda t: trim(t)), lambda t: length(t) > 3)) AS term, {m} FROM ps),
termf AS (SELECT site_key, count(*) AS terms, count(*) FILTER (WHERE hit) AS terms_found FROM (SELECT site_key, term, bool_or(contains(lower({m}), term)) AS hit FROM tok GROUP BY ALL) AS x GROUP BY 1),
dup AS (SELECT site_key, count(*) AS repeats FROM (SELECT site_key, 't' AS k, title AS v FROM ps WHERE title IS NOT NULL UNION ALL SELECT site_key, 'd', meta_description FROM ps WHERE meta_description IS NOT NULL) AS x
  GROUP BY site_key, k, v HAVING count(*) > 1),
dups AS (SELECT site_key, count(*) AS repeats FROM dup GROUP BY 1),
agg AS (SELECT ps.site_key, count(*) AS pages, {n("is_https")} AS https, max(status_code) {_H} AS home_status, max(redirect_hops) AS chain, {n("is_indexable")} AS indexable,
  coalesce(bool_or(is_indexable) {_H}, false) AS home_indexable, {n("canonical IS NOT NULL")} AS canonicals, {n("viewport IS NOT NULL")} AS viewports, {n("lang_attr IS NOT NULL")} AS langs,
  sum(image_count) AS images, sum(images_with_alt + images_with_empty_alt) AS with_alt, count(fetch_ms) AS timed, sum(fetch_ms) AS ms, bool_or(len(tok) = 0) AS no_tokens,
  coalesce(bool_or(len(list_filter(tok, lambda t: contains(lower(title), t))) > 0) {_H}, false) AS b1,
  coalesce(bool_or(len(list_filter(tok, lambda t: contains(lower(array_to_string(h1, ' ~ ')), t))) > 0) {_H}, false) AS b2,
  coalesce(bool_or(len(tok) > 0 AND len(list_filter(tok, lambda t: contains(lower({m}), t))) = len(tok)) {_H}, false) AS b3,
  coalesce(bool_or(len(list_filter(tok2, lambda t: contains(lower({m}), t))) > 0) {_H}, false) AS brand_any,
  coalesce(bool_or({re(f"coalesce(meta_description, {m})", lx.ACTIVITY_VERB_PATTERN)}) {_H}, false) AS home_verb, coalesce(max(length({f.trim(f"coalesce(meta_description, {m})")})) {_H}, 0) AS home_chars,
  len(list_distinct(flatten(list(list_filter({strings(lx.AUDIENCE_TERMS)}, lambda t: contains(lower({m}), t)))))) AS audience,
  {n("role IN ('SERVICE', 'PRODUCT', 'CATEGORY')")} AS offers, sum(len(list_filter(headings, lambda h: h.level IN (2, 3)))) AS subheadings,
  {any_("len(address_signals) > 0")} AS addresses, {any_(re(m, lx.US_STATE_PATTERN))} AS us_state, {any_("ld_areaServed IS NOT NULL")} AS area,
  arg_min(word_count, ps.page_id) FILTER (WHERE role = 'ABOUT') AS about_words, count(title) AS titles, {n("title IS NOT NULL AND len(list_filter(tok, lambda t: contains(lower(title), t))) > 0")} AS brand_titles,
  {n("title_length BETWEEN 25 AND 65")} AS sized, {n("meta_description_length >= 50")} AS described,
  {n("len(list_filter(og, lambda o: o LIKE 'og:title=_%')) > 0 AND len(list_filter(og, lambda o: o LIKE 'og:description=_%')) > 0")} AS with_og,
  sum(word_count) AS words, {n("word_count < 150")} AS thin, {n("role IN ('ARTICLE', 'BLOG_INDEX', 'CASE_STUDY')")} AS editorial, sum(factual_data_points) AS facts,
  len(list_distinct(flatten(list(vague_phrases)))) AS vague, len(list_distinct(flatten(list(superlatives)))) AS supers,
  {n("coalesce(modified_date, published_date) IS NOT NULL")} AS dated, max(TRY_CAST(replace(coalesce(modified_date, published_date), 'Z', '') AS TIMESTAMP)) AS newest,
  sum(internal_links) AS internal, {n("heading_hierarchy_valid")} AS hier, {n("len(h1) = 1")} AS one_h1, {n("role = 'CASE_STUDY'")} AS cases,
  {any_(re(m, lx.TESTIMONIAL_PATTERN))} AS testimonial, {any_(re(m, lx.ORIGINAL_DATA_PATTERN))} AS own_data, {any_(re(m, lx.PROJECT_COUNT_PATTERN))} AS projects,
  {n(f"length({m}) > 100")} AS exc, count(DISTINCT {m}) FILTER (WHERE length({m}) > 100) AS exc_d, {n("length(trim(first_paragraph)) > 60")} AS opn,
  count(DISTINCT trim(first_paragraph)) FILTER (WHERE length(trim(first_paragraph)) > 60) AS opn_d, coalesce(max(word_count) {_H}, 0) AS home_words,
  sum(len(question_headings)) AS questions, {n("role = 'FAQ' OR has_faq_signals")} AS faq_pages, {any_("has_faq_signals")} AS faq_content,
  {n("paragraph_count > 0 AND floor(word_count / paragraph_count + 0.5) BETWEEN 25 AND 130")} AS quotable, sum(list_count) AS lists, sum(table_count) AS tables,
  sum(len(regexp_extract_all({m}, {q(lx.DEFINITION_PATTERN)}, 0))) + sum(definition_count) AS defs, {any_(re(m, lx.COMPARISON_TEXT_PATTERN))} AS compares,
  {n(re("coalesce(title, '') || ' ' || url", lx.COMPARISON_PAGE_PATTERN))} AS comp_pages, {n(f"length(substr({m}, 1, 350)) >= 80 AND {re(f"substr({m}, 1, 350)", lx.DECLARATIVE_PATTERN)}")} AS front,
  coalesce(bool_or(length(substr({m}, 1, 300)) >= 100 AND {re(f"substr({m}, 1, 300)", lx.SUMMARY_VERB_PATTERN)}) {_H}, false) AS home_summary, {any_(re(m, lx.PROCESS_PATTERN))} AS process,
  {n("n_blocks > 0")} AS with_schema, sum(n_blocks) AS blocks, sum(n_blocks - n_valid) AS bad, coalesce(list_distinct(flatten(list(schema_types))), []) AS st,
  {any_("orgc.page_id IS NOT NULL")} AS has_org, arg_min(complete, ps.page_id) FILTER (WHERE complete IS NOT NULL) AS complete, {any_("sameas.page_id IS NOT NULL")} AS same_as, {any_("ld_author IS NOT NULL")} AS ld_auth,
  arg_min(ld_name, ps.page_id) FILTER (WHERE ld_name IS NOT NULL) AS ld_name, any_value(tok2) AS tok2, {any_("len(emails) > 0")} AS email, {any_("len(phones) > 0")} AS phone, {n("role = 'CONTACT'")} AS contact_pages,
  {n("role = 'AUTHOR'")} AS author_pages, {any_("len(list_filter(authors, lambda a: length(a) > 2)) > 0")} AS named, {n("len(authors) > 0 OR has_byline_text")} AS bylines, sum(outbound_citation_links) AS cites,
  {any_(re(m, lx.CREDENTIAL_PATTERN))} AS cred, {any_(re(m, lx.SOURCE_PATTERN))} AS src, {any_(re(m, lx.PROOF_PATTERN))} AS proof,
  {any_("(url || ' ' || coalesce(title, '')) ILIKE '%privacy%' OR len(list_filter(links, lambda l: l.href ILIKE '%privacy%')) > 0")} AS privacy,
  {any_("len(list_filter(links, lambda l: l.href ILIKE '%terms%' OR l.href ILIKE '%conditions%')) > 0")} AS terms_link, {any_(re(m, lx.LICENCE_PATTERN))} AS lic, {any_(re(m, lx.FOUNDED_YEAR_PATTERN))} AS founded
  FROM ps LEFT JOIN orgc ON orgc.page_id = ps.page_id LEFT JOIN sameas ON sameas.page_id = ps.page_id GROUP BY ps.site_key),
fail AS (SELECT site_key, count(*) AS failures FROM allp WHERE NOT {_TEXTUAL} OR status_code >= 400 GROUP BY 1),
nbrk AS (SELECT site_key, count(*) AS broken FROM brk GROUP BY 1),
fx0 AS (SELECT s.site_key, s.page_limit, agg.* EXCLUDE (site_key), repeats, terms, terms_found, failures, broken, len(ai.blocked_agents) AS blocked, ai.blocks_everything AS shut, ai.rule_count AS rules, ai.sitemaps,
  sfacts.* EXCLUDE (site_key) FROM sites s LEFT JOIN agg USING (site_key) LEFT JOIN dups USING (site_key) LEFT JOIN termf USING (site_key) LEFT JOIN fail USING (site_key) LEFT JOIN nbrk USING (site_key)
  LEFT JOIN ai USING (site_key) LEFT JOIN sfacts USING (site_key)),
fx AS (SELECT site_key, about_words, home_status, newest, complete, ld_name, tok2, coalesce(st, []) AS st,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in "page_limit pages https chain indexable canonicals viewports langs images with_alt timed ms home_chars audience offers subheadings titles brand_titles sized described with_og words thin editorial facts vague supers dated internal hier one_h1 cases exc exc_d opn opn_d home_words questions faq_pages quotable lists tables defs comp_pages front with_schema blocks bad contact_pages author_pages bylines cites repeats terms terms_found failures broken blocked rules sitemaps sitemap_urls llms_bytes".split())},
  {", ".join(f"coalesce({c}, false) AS {c}" for c in "home_indexable no_tokens b1 b2 b3 brand_any home_verb addresses us_state area testimonial own_data projects faq_content compares home_summary process has_org same_as ld_auth email phone named cred src proof privacy terms_link lic founded shut robots_found sitemap_found llms_found".split())}
  FROM fx0)"""


def div(a, c):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({c}, 0), 0)"


def cap(x):
    return f"least(1.0, greatest(0.0, {x}))"


def sfr(r, p=0.85, w=0.4):
    return f"CASE WHEN {r} >= {p} THEN 'PASS' WHEN {r} >= {w} THEN 'WARN' ELSE 'FAIL' END"


def cond(*parts):
    body = " ".join(f"WHEN {a} THEN {q(r) if isinstance(r, str) else r}" for a, r in parts[:-1])
    last = parts[-1]
    return f"CASE {body} ELSE {q(last) if isinstance(last, str) else last} END"


def cnt(*flags):
    return "(" + " + ".join(f"CAST({x} AS INT)" for x in flags) + ")"


def has(*types):
    return "(" + " OR ".join(f"list_contains(st, '{t}')" for t in types) + ")"


def yes(flag, other=0.0):
    return cond((flag, 1.0), other)


def level(x, good, some=1):
    return cond((f"{x} >= {good}", "PASS"), (f"{x} >= {some}", "WARN"), "FAIL")


def ratio(rid, a, c, p, w, ev):
    return rid, div(a, c), sfr(div(a, c), p, w), ev


_AVG, _MS = div("words", "pages"), "(CAST(ms AS DOUBLE) / timed)"
_NAME, _GEO = cnt("b1", "b2", "b3"), cnt("addresses", "us_state", "area")
_DO = cond(("home_verb AND home_chars >= 80", 1.0), ("home_verb OR home_chars >= 80", 0.5), 0.0)
_OFF = f"greatest({cap('offers / 3.0')}, 0.7 * {cap('subheadings / 12.0')})"
_FACT = cap("facts / CAST(greatest(6, 2 * pages) AS DOUBLE)")
_MON = f"(epoch_us(TIMESTAMP '{b.AS_OF_PAGES}') - epoch_us(newest)) / 2592000000000.0"
_LNK = div("internal", "pages")
_HD = f"(0.5 * {div('hier', 'pages')} + 0.5 * {div('one_h1', 'pages')})"
_OWN = cnt("cases > 0", "testimonial", "own_data", "projects")
_UNL = "least(CASE WHEN exc > 0 THEN exc_d / CAST(exc AS DOUBLE) ELSE 1 END, CASE WHEN opn > 0 THEN opn_d / CAST(opn AS DOUBLE) ELSE 1 END)"
_FULL = cond(("pages > 0", "1"), "0").replace("'1'", "1 - CAST(thin AS DOUBLE) / pages").replace("'0'", "0.0")
_Q = cap("questions / CAST(greatest(5, 2 * pages) AS DOUBLE)")
_FAQ = f"(0.6 * CAST(faq_pages > 0 AS INT) + 0.4 * CAST({has('FAQPage')} AS INT))"
_STR = f"least(1.0, 0.7 * {cap('lists / CAST(greatest(4, pages) AS DOUBLE)')} + 0.3 * {cap('tables / 2.0')})"
_DEF = cap("defs / CAST(greatest(3, pages) AS DOUBLE)")
_TRM = "CASE WHEN terms = 0 THEN 0.6 ELSE CAST(terms_found AS DOUBLE) / terms END"
_STEP = f"(process OR {has('HowTo')})"
_VAL = "CASE WHEN blocks = 0 THEN 0.0 ELSE 1 - bad / CAST(blocks AS DOUBLE) END"
_KIND = f"len(list_filter(st, lambda t: t IN {members(lx.CONTENT_TYPES)}))"
_AUT, _REV = f"({has('Person')} OR ld_auth)", has("Review", "AggregateRating")
_FIT = "(ld_name IS NOT NULL AND len(list_filter(tok2, lambda t: contains(lower(ld_name), t))) > 0)"
_CON, _EXP = cnt("email", "phone", "addresses"), cnt("author_pages > 0", "cred", "named")
_BYL = cond(("editorial > 0", "X"), ("named", 1.0), 0.3).replace("'X'", "least(1.0, CAST(bylines AS DOUBLE) / editorial)")
_CIT = cap("cites / CAST(greatest(3, pages) AS DOUBLE)")
_PRF, _LEG = cnt("proof", "cases > 0", _REV), cnt("privacy", "terms_link", "lic", "founded")
_CLR = cnt("brand_any", has(*lx.CORE_ORG_TYPES), "email")

OWN = {
    "technical": [
        ("tech.https", div("https", "pages"), f"CASE WHEN pages = 0 THEN 'FAIL' ELSE {sfr(div('https', 'pages'), 1, 0.5)} END", {"https": "https", "pages": "pages"}),
        ("tech.homepage-status", yes("home_status BETWEEN 200 AND 299"), cond(("home_status BETWEEN 200 AND 299", "PASS"), "FAIL"), {"status": "coalesce(home_status, 0)"}),
        ("tech.redirect-chains", "CASE chain WHEN 0 THEN 1 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0 END", "CASE WHEN chain <= 1 THEN 'PASS' WHEN chain = 2 THEN 'WARN' ELSE 'FAIL' END", {"hops": "chain"}),
        ("tech.indexability", f"CASE WHEN home_indexable THEN {div('indexable', 'pages')} ELSE 0 END", f"CASE WHEN home_indexable THEN {sfr(div('indexable', 'pages'), 0.95, 0.7)} ELSE 'FAIL' END", {"indexable": "indexable"}),
        ("tech.robots-txt", cond(("NOT robots_found", 0.35), ("shut", 0.0), 1.0), cond(("shut", "FAIL"), ("robots_found", "PASS"), "WARN"), {"rules": "rules", "sitemaps": "sitemaps"}),
        ("tech.ai-crawler-access", cond(("blocked = 0", 1.0), ("blocked <= 2", 0.5), 0.0), cond(("blocked = 0", "PASS"), ("blocked <= 2", "WARN"), "FAIL"), {"blocked": "blocked"}),
        ("tech.sitemap", cond(("NOT sitemap_found", 0.0), ("sitemap_urls > 0", 1.0), 0.6), cond(("NOT sitemap_found", "FAIL"), ("sitemap_urls > 0", "PASS"), "WARN"), {"urls": "sitemap_urls"}),
        ("tech.llms-txt", yes("llms_found"), cond(("llms_found", "PASS"), "INFO"), {"bytes": "llms_bytes"}),
        ratio("tech.canonical", "canonicals", "pages", 0.9, 0.5, {"canonicals": "canonicals"}),
        ratio("tech.viewport", "viewports", "pages", 0.9, 0.5, {"viewports": "viewports"}),
        ratio("tech.lang", "langs", "pages", 0.9, 0.5, {"langs": "langs"}),
        ("tech.broken-links", cond(("broken = 0", 1.0), ("broken <= 2", 0.6), ("broken <= 5", 0.3), 0.0), cond(("broken = 0", "PASS"), ("broken <= 2", "WARN"), "FAIL"), {"broken": "broken"}),
        ("tech.image-alt", f"CASE WHEN images = 0 THEN 1 ELSE {div('with_alt', 'images')} END", f"CASE WHEN images = 0 THEN 'NOT_APPLICABLE' ELSE {sfr(div('with_alt', 'images'), 0.9, 0.6)} END", {"images": "images", "with_alt": "with_alt"}),
        ratio("tech.crawl-success", "pages", "pages + failures", 0.9, 0.6, {"pages": "pages", "failures": "failures"}),
        ("tech.response-time", cond(("timed = 0 OR ms = 0", 0.0), (f"{_MS} <= 800", 1.0), (f"{_MS} <= 1800", 0.7), (f"{_MS} <= 3500", 0.4), 0.1), cond(("timed = 0", "NOT_APPLICABLE"), (f"{_MS} <= 1800", "PASS"), (f"{_MS} <= 3500", "WARN"), "FAIL"), {"timed": "timed"}),
        ("tech.discoverable-pages", cap("pages / CAST(least(page_limit, 6) AS DOUBLE)"), level("pages", 5, 2), {"pages": "pages"}),
    ],
    "entity": [
        ("entity.brand-name-prominence", f"CASE WHEN no_tokens THEN 0 ELSE {_NAME} / 3.0 END", level(_NAME, 2), {"signals": _NAME}),
        ("entity.what-we-do", _DO, cond((f"{_DO} = 1", "PASS"), (f"{_DO} > 0", "WARN"), "FAIL"), {"chars": "home_chars"}),
        ("entity.audience-definition", cond(("audience >= 2", 1.0), ("audience = 1", 0.6), 0.0), level("audience", 2), {"terms": "audience"}),
        ("entity.service-specificity", _OFF, sfr(_OFF, 0.75, 0.35), {"offers": "offers", "subheadings": "subheadings"}),
        ("entity.geographic-clarity", f"{_GEO} / 3.0", level(_GEO, 2), {"signals": _GEO}),
        ("entity.about-page", cond(("about_words IS NULL", 0.0), ("about_words >= 400", 1.0), ("about_words >= 200", 0.65), 0.3), cond(("about_words IS NULL", "FAIL"), ("about_words >= 400", "PASS"), "WARN"), {"words": "coalesce(about_words, 0)"}),
        ratio("entity.name-consistency", "brand_titles", "titles", 0.7, 0.35, {"branded": "brand_titles", "titles": "titles"}),
        ratio("entity.title-quality", "sized", "pages", 0.7, 0.4, {"sized": "sized"}),
        ratio("entity.meta-description", "described", "pages", 0.8, 0.4, {"described": "described"}),
        ("entity.duplicate-metadata", cond(("repeats = 0", 1.0), ("repeats = 1", 0.6), ("repeats <= 3", 0.3), 0.0), cond(("repeats = 0", "PASS"), ("repeats = 1", "WARN"), "FAIL"), {"repeats": "repeats"}),
        ratio("entity.open-graph", "with_og", "pages", 0.7, 0.3, {"with_og": "with_og"}),
    ],
    "content": [
        ("content.average-depth", cond((f"{_AVG} >= 800", 1.0), (f"{_AVG} >= 500", 0.8), (f"{_AVG} >= 300", 0.55), (f"{_AVG} >= 150", 0.3), 0.1), level(_AVG, 500, 250), {"words": "words", "pages": "pages"}),
        ("content.thin-pages", _FULL, cond(("thin = 0", "PASS"), (f"{_FULL} >= 0.75", "WARN"), "FAIL"), {"thin": "thin"}),
        ("content.editorial-presence", cap("editorial / 3.0"), level("editorial", 3), {"editorial": "editorial"}),
        ("content.factual-specificity", _FACT, sfr(_FACT, 0.7, 0.3), {"facts": "facts"}),
        ("content.vague-language", cond(("vague = 0", 1.0), ("vague <= 2", 0.65), ("vague <= 4", 0.35), 0.0), cond(("vague = 0", "PASS"), ("vague <= 2", "WARN"), "FAIL"), {"phrases": "vague"}),
        ("content.unsupported-superlatives", cond(("supers = 0", 1.0), ("supers <= 2", 0.6), 0.2), cond(("supers = 0", "PASS"), ("supers <= 2", "WARN"), "FAIL"), {"phrases": "supers"}),
        ("content.freshness", cond(("newest IS NULL", 0.0), (f"{_MON} <= 6", 1.0), (f"{_MON} <= 12", 0.7), (f"{_MON} <= 24", 0.4), 0.15), cond(("newest IS NULL", "FAIL"), (f"{_MON} <= 12", "PASS"), (f"{_MON} <= 24", "WARN"), "FAIL"), {"dated": "dated", "newest": "coalesce(strftime(newest, '%Y-%m-%d'), '')"}),
        ("content.internal-linking", cond((f"{_LNK} >= 15", 1.0), (f"{_LNK} >= 8", 0.75), (f"{_LNK} >= 4", 0.45), 0.15), level(_LNK, 8, 4), {"links": "internal"}),
        ("content.heading-structure", _HD, sfr(_HD, 0.8, 0.5), {"valid": "hier", "single": "one_h1"}),
        ("content.first-party-evidence", f"{_OWN} / 4.0", level(_OWN, 3), {"signals": _OWN}),
        ("content.duplication", _UNL, f"CASE WHEN greatest(exc, opn) < 2 THEN 'NOT_APPLICABLE' ELSE {sfr(_UNL, 0.95, 0.75)} END", {"excerpts": "exc_d", "openings": "opn_d"}),
        ("content.homepage-substance", cond(("home_words >= 600", 1.0), ("home_words >= 350", 0.75), ("home_words >= 150", 0.4), 0.1), level("home_words", 350, 150), {"words": "home_words"}),
    ],
    "answer": [
        ("answer.question-headings", _Q, sfr(_Q, 0.7, 0.3), {"questions": "questions"}),
        ("answer.faq-coverage", _FAQ, cond((f"{_FAQ} >= 0.9", "PASS"), (f"{_FAQ} > 0", "WARN"), "FAIL"), {"pages": "faq_pages"}),
        ratio("answer.passage-sizing", "quotable", "pages", 0.7, 0.35, {"pages": "quotable"}),
        ("answer.lists-and-tables", _STR, sfr(_STR, 0.7, 0.3), {"lists": "lists", "tables": "tables"}),
        ("answer.definitions", _DEF, sfr(_DEF, 0.7, 0.3), {"definitions": "defs"}),
        ("answer.comparison-content", cond(("comp_pages > 0", 1.0), ("compares", 0.5), 0.0), cond(("comp_pages > 0", "PASS"), ("compares", "WARN"), "FAIL"), {"pages": "comp_pages"}),
        ratio("answer.front-loaded", "front", "pages", 0.7, 0.35, {"pages": "front"}),
        ("answer.terminology-consistency", _TRM, f"CASE WHEN terms = 0 THEN 'INFO' ELSE {sfr(_TRM.join('()'), 0.8, 0.4)} END", {"found": "terms_found", "terms": "terms"}),
        ("answer.homepage-summary", yes("home_summary"), cond(("home_summary", "PASS"), "FAIL"), {"summary": "home_summary"}),
        ("answer.process-content", yes(_STEP, 0.2), cond((_STEP, "PASS"), "WARN"), {"process": "process"}),
    ],
    "structured_data": [
        ratio("schema.presence", "with_schema", "pages", 0.8, 0.3, {"pages": "with_schema"}),
        ("schema.validity", _VAL, cond(("blocks = 0", "NOT_APPLICABLE"), ("bad = 0", "PASS"), "FAIL"), {"blocks": "blocks", "invalid": "bad"}),
        ("schema.organization-present", yes("has_org"), cond(("has_org", "PASS"), "FAIL"), {"found": "has_org"}),
        ("schema.organization-completeness", "coalesce(complete, 0)", f"CASE WHEN has_org THEN {sfr('complete', 0.75, 0.4)} ELSE 'NOT_APPLICABLE' END", {"found": "has_org"}),
        ("schema.same-as", yes("same_as"), cond(("same_as", "PASS"), "FAIL"), {"found": "same_as"}),
        ("schema.website", yes(has("WebSite")), cond((has("WebSite"), "PASS"), "WARN"), {"found": has("WebSite")}),
        ("schema.breadcrumbs", yes(has("BreadcrumbList")), cond((has("BreadcrumbList"), "PASS"), "WARN"), {"found": has("BreadcrumbList")}),
        ("schema.content-types", cap(f"{_KIND} / 2.0"), level(_KIND, 2), {"types": _KIND}),
        ("schema.faq", yes(has("FAQPage")), cond((has("FAQPage"), "PASS"), ("faq_content", "FAIL"), "WARN"), {"content": "faq_content"}),
        ("schema.author", yes(_AUT), cond((_AUT, "PASS"), "WARN"), {"found": _AUT}),
        ("schema.reviews", yes(_REV), cond((_REV, "PASS"), "INFO"), {"found": _REV}),
        ("schema.name-agreement", yes(_FIT), cond(("ld_name IS NULL", "NOT_APPLICABLE"), (_FIT, "PASS"), "FAIL"), {"fits": _FIT}),
    ],
    "trust": [
        ("trust.contact-details", f"{_CON} / 3.0", level(_CON, 2), {"signals": _CON}),
        ("trust.contact-page", yes("contact_pages > 0"), cond(("contact_pages > 0", "PASS"), "FAIL"), {"pages": "contact_pages"}),
        ("trust.author-attribution", _BYL, f"CASE WHEN NOT named THEN 'FAIL' ELSE {sfr(_BYL.join('()'), 0.7, 0.3)} END", {"bylines": "bylines", "editorial": "editorial"}),
        ("trust.author-expertise", f"{_EXP} / 3.0", level(_EXP, 2), {"signals": _EXP}),
        ("trust.outbound-citations", _CIT, sfr(_CIT, 0.7, 0.25), {"links": "cites"}),
        ("trust.source-transparency", yes("src"), cond(("src", "PASS"), "WARN"), {"found": "src"}),
        ("trust.customer-proof", f"{_PRF} / 3.0", level(_PRF, 2), {"signals": _PRF}),
        ("trust.legitimacy-markers", f"{_LEG} / 4.0", level(_LEG, 3), {"signals": _LEG}),
        ("trust.attribution-clarity", f"{_CLR} / 3.0", level(_CLR, 2), {"signals": _CLR}),
        ratio("trust.update-dates", "dated", "pages", 0.6, 0.25, {"dated": "dated"}),
    ],
}
_CAT = {row[0]: (i, *row[1:5]) for i, row in enumerate(CATALOG)}


def rows(checks, source, when=lambda cid: "true"):
    out = []
    for cid, r, status, ev in checks:
        i, category, points, effort, impact = _CAT[cid]
        impact_sql = "CASE WHEN shut THEN 'HIGH' ELSE 'MEDIUM' END" if cid == "tech.robots-txt" else q(impact)
        ev_sql = " || ';' || ".join(f"'{k}=' || CAST({v} AS VARCHAR)" for k, v in ev.items())
        out.append(
            f"{{'check_id': {q(cid)}, 'category': {q(category)}, 'sort_order': {i}, 'status': {status}, 'r': CAST({cap(r)} AS DOUBLE), 'mx': CAST({points} AS DOUBLE),"
            f" 'effort': {q(effort)}, 'impact': {impact_sql}, 'evidence': {ev_sql}, 'ok': {when(cid)}}}"
        )
    return f"SELECT site_key, unnest([{', '.join(out)}]) AS c FROM {source}"


def checks_cte(name, body):
    lost = "c.mx * (1 - c.r)"
    return f"""{name} AS (SELECT site_key, c.check_id AS check_id, c.category AS category, c.sort_order AS sort_order, c.status AS status,
  CASE WHEN c.status = 'PASS' THEN 'PASSED' WHEN c.status IN ('INFO', 'NOT_APPLICABLE') THEN 'INFORMATIONAL'
    WHEN c.status = 'FAIL' THEN CASE WHEN {lost} >= 8 THEN 'CRITICAL' WHEN {lost} >= 5 THEN 'HIGH' WHEN {lost} >= 2.5 THEN 'MEDIUM' ELSE 'LOW' END
    ELSE CASE WHEN {lost} >= 6 THEN 'HIGH' WHEN {lost} >= 3 THEN 'MEDIUM' ELSE 'LOW' END END AS severity,
  CASE WHEN c.status = 'NOT_APPLICABLE' THEN 0 ELSE round(c.r * c.mx, 3) END AS points, CASE WHEN c.status = 'NOT_APPLICABLE' THEN 0 ELSE c.mx END AS max_points,
  c.status <> 'NOT_APPLICABLE' AS applicable, c.effort AS effort, c.impact AS impact, c.evidence AS evidence FROM ({body}) AS x WHERE c.ok)"""


BASE = f"{FETCHED}, {BROKEN}, {ROBOTS}, {FACTS}"

# ---- comparison -------------------------------------------------------------------------

_CORE = "(" + " OR ".join(f"list_contains(schema_types, '{t}')" for t in lx.CORE_ORG_TYPES) + ")"


def pts(*cases):
    return "CASE " + " ".join(f"WHEN {t} THEN {p}" for t, p in cases) + " ELSE 0 END"


_QUICK = "least(100, " + " + ".join([
    pts(("is_https", 8)), pts(("canonical IS NOT NULL", 4)), pts(("lang_attr IS NOT NULL", 4)), pts(("viewport IS NOT NULL", 4)),
    pts(("length(title) >= 25", 8), ("title IS NOT NULL", 4)), pts(("length(meta_description) >= 50", 7), ("meta_description IS NOT NULL", 3)),
    pts(("len(h1) = 1", 7), ("len(h1) > 1", 3)), pts(("word_count >= 800", 18), ("word_count >= 500", 14), ("word_count >= 300", 9), ("word_count >= 150", 4)),
    pts((_CORE, 10)), pts(("len(schema_types) >= 3", 6), ("len(schema_types) >= 1", 3)), pts(("list_contains(schema_types, 'FAQPage')", 4)),
    pts(("len(question_headings) >= 3", 7), ("len(question_headings) >= 1", 4)), pts(("has_faq_signals", 3)), pts(("list_count >= 2", 2)),
    pts(("len(phones) + len(emails) > 0", 4)), pts(("len(address_signals) > 0", 2)), pts(("len(authors) > 0", 2)), pts(("len(og) >= 3", 2)),
]) + ")"
_CATS = {
    "technical": [pts(("is_https", 35)), pts(("canonical IS NOT NULL", 20)), pts(("lang_attr IS NOT NULL", 15)), pts(("viewport IS NOT NULL", 15)), pts(("is_indexable", 15))],
    "entity": [pts(("title_length >= 25", 30), ("title_length > 0", 15)), pts(("meta_description_length >= 50", 25), ("meta_description_length > 0", 12)), pts(("len(h1) = 1", 25), ("len(h1) > 1", 12)), pts(("len(og) >= 3", 20))],
    "content": ["CASE WHEN word_count >= 800 THEN 45 WHEN word_count >= 500 THEN 35 WHEN word_count >= 300 THEN 22 ELSE 8 END", "CASE WHEN paragraph_count >= 6 THEN 25 WHEN paragraph_count >= 3 THEN 15 ELSE 5 END",
                pts(("factual_data_points >= 3", 20), ("factual_data_points >= 1", 10)), pts(("len(vague_phrases) = 0", 10))],
    "answer": [pts(("len(question_headings) >= 3", 35), ("len(question_headings) >= 1", 20)), pts(("has_faq_signals", 25)), pts(("list_count >= 2", 20), ("list_count >= 1", 10)), pts(("table_count >= 1", 10)), pts(("len(headings) >= 5", 10))],
    "structured": [pts((_CORE, 40)), pts(("len(schema_types) >= 3", 25), ("len(schema_types) >= 1", 12)), pts(("list_contains(schema_types, 'FAQPage')", 20)), pts(("n_blocks > 0 AND n_valid = n_blocks", 15))],
    "trust": [pts(("len(phones) > 0", 25)), pts(("len(emails) > 0", 20)), pts(("len(address_signals) > 0", 25)), pts(("len(authors) > 0", 15)), pts(("outbound_citation_links > 0", 15))],
}
_DOM = let(
    f.bare_host("url"), "hh",
    f"CASE WHEN len(string_split(hh, '.')) <= 2 THEN hh WHEN string_split(hh, '.')[-2] IN {members(lx.SECOND_LEVEL_SUFFIXES)} THEN array_to_string(string_split(hh, '.')[-3:], '.') ELSE array_to_string(string_split(hh, '.')[-2:], '.') END",
)
_NM = "coalesce(" + let(
    "list_filter(list_transform(string_split_regex(coalesce(title, ''), '[|—–·-]'), lambda p: trim(p)), lambda p: p <> '')", "ps_",
    "CASE WHEN len(ps_) = 0 THEN NULL WHEN length(ps_[-1]) BETWEEN 3 AND 40 THEN ps_[-1] ELSE ps_[1][:60] END") + f", {_DOM})"
_HI = "list_filter([CASE WHEN len(schema_types) >= 3 THEN 'schema-types=' || array_to_string(schema_types, '+') END, CASE WHEN word_count >= 600 THEN 'long-copy=' || word_count END, CASE WHEN len(question_headings) >= 3 THEN 'questions=' || len(question_headings) END, CASE WHEN has_faq_signals THEN 'faq' END, CASE WHEN len(address_signals) > 0 AND len(phones) > 0 THEN 'address-and-phone' END, CASE WHEN factual_data_points >= 3 THEN 'facts=' || factual_data_points END], lambda x: x IS NOT NULL)"
_GP = "list_filter([CASE WHEN len(schema_types) = 0 THEN 'no-schema' END, CASE WHEN word_count < 300 THEN 'short-copy=' || word_count END, CASE WHEN len(question_headings) = 0 THEN 'no-questions' END, CASE WHEN meta_description IS NULL THEN 'no-description' END, CASE WHEN len(phones) + len(emails) = 0 THEN 'no-contact' END, CASE WHEN len(vague_phrases) > 2 THEN 'filler=' || len(vague_phrases) END], lambda x: x IS NOT NULL)"
SNAP = f"snap AS (SELECT *, {_QUICK} AS quick_score, {_NM} AS name, len(question_headings) AS question_count, {', '.join(f'least(100, {chr(32).join([chr(43).join(v)])}) AS {k}' for k, v in _CATS.items())}, {_HI} AS highlights, {_GP} AS gaps FROM sig)"
_PICK_URLS = URL_CTE.replace("raws AS (" + b.RAW_URLS_SQL + ")", f"raws AS (SELECT site_key || '~' || pos AS url_id, raw FROM ({b.COMPETITORS_SQL}) AS cc)")
PICK = f"""{_PICK_URLS},
pk0 AS (SELECT string_split(url_id, '~')[1] AS site_key, CAST(string_split(url_id, '~')[2] AS INT) AS pos, {f.origin('v')} || {f.clean_path(f.path('v'))} || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END AS url,
  {let("regexp_replace(name, '^www[.]', '')", "hh", f"CASE WHEN len(string_split(hh, '.')) <= 2 THEN hh WHEN string_split(hh, '.')[-2] IN {members(lx.SECOND_LEVEL_SUFFIXES)} THEN array_to_string(string_split(hh, '.')[-3:], '.') ELSE array_to_string(string_split(hh, '.')[-2:], '.') END")} AS domain
  FROM codes WHERE code = 'OK'),
pk1 AS (SELECT * FROM pk0 QUALIFY row_number() OVER (PARTITION BY site_key, domain ORDER BY pos) = 1),
pick AS (SELECT pk1.*, row_number() OVER (PARTITION BY site_key ORDER BY pos) AS rank FROM pk1 JOIN sites USING (site_key) QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY pos) <= competitor_limit)"""
_KEY = lambda c: f"lower({f.bare_host(c)} || regexp_replace({f.path(c)}, '/+$', ''))"
COMPARED = f"""{SNAP}, {PICK},
home AS (SELECT snap.* FROM snap JOIN sites ON snap.page_id = sites.seed_page_id),
cp AS (SELECT {_KEY('url')} AS ck, * FROM snap QUALIFY row_number() OVER (PARTITION BY {_KEY('url')} ORDER BY page_id) = 1),
cmp AS (SELECT p.site_key, p.rank, p.url, c.name, CASE WHEN c.page_id IS NOT NULL THEN 'ANALYZED' ELSE 'FAILED' END AS status, c.quick_score, c.word_count, c.question_count, len(c.schema_types) AS type_count,
  list_filter(c.schema_types, lambda t: NOT list_contains(coalesce(h.schema_types, []), t)) AS missing_types FROM pick p LEFT JOIN cp c ON c.ck = {_KEY('p.url')} LEFT JOIN home h ON h.site_key = p.site_key),
cf AS (SELECT c.*, coalesce(h.quick_score, 0) AS own_score, coalesce(h.word_count, 0) AS own_words, coalesce(h.question_count, 0) AS own_questions, coalesce(len(h.schema_types), 0) AS own_types FROM (
  SELECT site_key, count(*) AS requested, count(*) FILTER (WHERE status = 'ANALYZED') AS analyzed, avg(quick_score) AS avg_score, max(quick_score) AS best_score, avg(word_count) AS avg_words, avg(question_count) AS avg_questions, avg(type_count) AS avg_types
  FROM cmp GROUP BY 1) AS c LEFT JOIN home h USING (site_key))"""
_GAP = "(own_score - avg_score)"


def _rel(own, avg, zero):
    return f"CASE WHEN {avg} = 0 THEN {zero} ELSE {cap(f'{own} / greatest(1.0, {avg})')} END"


def _lev(own, avg):
    return cond((f"{own} >= {avg}", "PASS"), (f"{own} > 0", "WARN"), "FAIL")


COMPETITIVE = [
    ("competitive.unavailable", "0", "'NOT_APPLICABLE'", {"requested": "requested"}),
    ("competitive.overall-signals", f"0.5 + {_GAP} / 100", cond((f"{_GAP} >= 5", "PASS"), (f"{_GAP} >= -10", "WARN"), "FAIL"), {"own": "own_score", "best": "best_score", "analyzed": "analyzed"}),
    ("competitive.structured-data", _rel("own_types", "avg_types", "CASE WHEN own_types > 0 THEN 1.0 ELSE 0.5 END"), _lev("own_types", "avg_types"), {"own": "own_types"}),
    ("competitive.content-depth", _rel("own_words", "avg_words", "1.0"), cond(("own_words >= avg_words * 0.9", "PASS"), ("own_words >= avg_words * 0.5", "WARN"), "FAIL"), {"own": "own_words"}),
    ("competitive.answer-readiness", _rel("own_questions", "avg_questions", "CASE WHEN own_questions > 0 THEN 1.0 ELSE 0.5 END"), _lev("own_questions", "avg_questions"), {"own": "own_questions"}),
]
_WHEN = lambda cid: "analyzed = 0" if cid == "competitive.unavailable" else "analyzed > 0"
ALL_BODY = "SELECT * FROM own_rows UNION ALL BY NAME SELECT * FROM comp_rows"
ALL = f"""{BASE}, {COMPARED}, {checks_cte('own_rows', rows([c for v in OWN.values() for c in v], 'fx'))}, {checks_cte('comp_rows', rows(COMPETITIVE, 'cf', _WHEN))},
chk AS ({ALL_BODY})"""
_ORD = "CASE category " + " ".join(f"WHEN '{c[0]}' THEN {i}" for i, c in enumerate(lx.CATEGORIES)) + " END"
_WGT = "CASE category " + " ".join(f"WHEN '{c[0]}' THEN {c[2]}" for c in lx.CATEGORIES) + " END"
_LBL = "CASE category " + " ".join(f"WHEN '{c[0]}' THEN '{c[1]}'" for c in lx.CATEGORIES) + " END"


def band(s):
    return f"CASE WHEN {s} >= 85 THEN 'excellent' WHEN {s} >= 70 THEN 'good' WHEN {s} >= 55 THEN 'fair' WHEN {s} >= 35 THEN 'poor' ELSE 'critical' END"


SCORES = f"""{ALL},
grid AS (SELECT DISTINCT site_key, unnest({strings(c[0] for c in lx.CATEGORIES)}) AS category FROM chk),
cs AS (SELECT site_key, category, {_ORD} AS category_order, coalesce(nn, 0) > 0 AS available, CASE WHEN most > 0 THEN CAST(floor(least(1, greatest(0, CAST(raw AS DOUBLE) / most)) * 100 + 0.5) AS INT) ELSE 0 END AS score,
  floor((coalesce(raw, 0) + 5) / 10.0) / 100.0 AS raw_points, floor((coalesce(most, 0) + 5) / 10.0) / 100.0 AS max_points, coalesce(passed, 0) AS passed, coalesce(warned, 0) AS warned, coalesce(failed, 0) AS failed, CAST({_WGT} AS DOUBLE) AS base_weight
  FROM grid LEFT JOIN (SELECT site_key, category, sum(CAST(round(points * 1000) AS BIGINT)) FILTER (WHERE applicable AND max_points > 0) AS raw, sum(CAST(round(max_points * 1000) AS BIGINT)) FILTER (WHERE applicable AND max_points > 0) AS most, count(*) FILTER (WHERE applicable AND max_points > 0) AS nn,
    count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned, count(*) FILTER (WHERE status = 'FAIL') AS failed FROM chk GROUP BY ALL) AS g USING (site_key, category)),
ws AS (SELECT *, CASE WHEN available THEN round(base_weight / sum(CASE WHEN available THEN base_weight ELSE 0 END) OVER (PARTITION BY site_key), 4) ELSE 0 END AS effective_weight FROM cs),
ov AS (SELECT site_key, CAST(floor(least(100, round(sum(score * effective_weight) FILTER (WHERE available), 6)) + 0.5) AS INT) AS overall_score, count(*) FILTER (WHERE available) AS categories FROM ws GROUP BY 1)"""


def rank(col, names):
    return f"list_position({strings(names)}, {col})"


_SEV = rank("severity", lx.SEVERITIES)
RECS = f"""{ALL}, rec0 AS (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY {_SEV}, {rank('impact', ['HIGH', 'MEDIUM', 'LOW'])}, {rank('effort', ['LOW', 'MEDIUM', 'HIGH'])},
  {rank('category', [c[0] for c in sorted(lx.CATEGORIES, key=lambda c: c[3])])}, check_id) AS priority FROM chk WHERE applicable AND status IN ('FAIL', 'WARN')),
rec AS (SELECT site_key, priority, check_id, category, severity, impact, effort, CASE WHEN severity = 'CRITICAL' OR (severity = 'HIGH' AND effort <> 'HIGH') OR (effort = 'LOW' AND priority <= 8) THEN 'DO_FIRST'
  WHEN effort = 'HIGH' OR severity = 'LOW' THEN 'LONGER_TERM' ELSE 'NEXT_30_DAYS' END AS horizon, round(max_points - points, 3) AS shortfall,
  CASE WHEN max_points - points >= 7 THEN 'large' WHEN max_points - points >= 4 THEN 'meaningful' WHEN max_points - points >= 2 THEN 'modest' ELSE 'small' END AS expected_impact FROM rec0)"""
STRONG = "strong AS (SELECT site_key, row_number() OVER (PARTITION BY site_key ORDER BY max_points DESC, check_id) AS rank, check_id, category, severity FROM chk WHERE status = 'PASS' AND applicable AND max_points >= 5 QUALIFY rank <= 3)"
WEAK = f"weak AS (SELECT site_key, row_number() OVER (PARTITION BY site_key ORDER BY {_SEV}, max_points - points DESC, check_id) AS rank, check_id, category, severity FROM chk WHERE applicable AND status IN ('FAIL', 'WARN') QUALIFY rank <= 3)"
_SUM = f"""{_LBL} || CASE WHEN available THEN ': passed ' || passed || ', partly met ' || warned || ', failed ' || failed ELSE ': not measured' END"""
_PV_TESTS = ["is_https", "is_indexable", "title_length BETWEEN 25 AND 70", "meta_description_length >= 50", "len(h1) = 1", _CORE, "n_blocks > 0 AND n_valid = n_blocks", "word_count >= 350",
             "len(question_headings) >= 2", "has_faq_signals", "len(phones) + len(emails) + len(address_signals) > 0", "canonical IS NOT NULL"]
PREV = f"pv AS (SELECT page_id, url, unnest([{', '.join(f'{{{chr(39)}i{chr(39)}: {i}, {chr(39)}title{chr(39)}: {q(p[0])}, {chr(39)}category{chr(39)}: {q(p[1])}, {chr(39)}w{chr(39)}: {p[2]}, {chr(39)}sev{chr(39)}: {q(p[3])}, {chr(39)}ok{chr(39)}: {t}}}' for i, (p, t) in enumerate(zip(PREVIEW, _PV_TESTS)))}]) AS c FROM sig)"
CHECK_COLS = "site_key, check_id, category, sort_order, status, severity, points, max_points, applicable, effort, impact, evidence"

SQL = {
    **{f"c{i}_checks_{name}": f"WITH {BASE}, {checks_cte('own_rows', rows(OWN[name], 'fx'))} SELECT {CHECK_COLS} FROM own_rows" for i, name in enumerate(OWN, 1)},
    "c7_checks_competitive": f"WITH {BASE}, {COMPARED}, {checks_cte('comp_rows', rows(COMPETITIVE, 'cf', _WHEN))} SELECT {CHECK_COLS} FROM comp_rows",
    "c8_checks_all": f"WITH {ALL} SELECT {CHECK_COLS} FROM chk",
    "c8_check_examples": f"""WITH {FETCHED}, ex AS (SELECT site_key, page_id, url, 'tech.redirect-chains' AS check_id, 3 AS most FROM sig WHERE redirect_hops > 1 UNION ALL SELECT site_key, page_id, url, 'tech.indexability', 5 FROM sig WHERE NOT is_indexable
       UNION ALL SELECT site_key, page_id, url, 'tech.canonical', 5 FROM sig WHERE canonical IS NULL UNION ALL SELECT site_key, page_id, url, 'entity.title-quality', 5 FROM sig WHERE title_length = 0 UNION ALL SELECT site_key, page_id, url, 'entity.meta-description', 5 FROM sig WHERE meta_description IS NULL
       UNION ALL SELECT site_key, page_id, url, 'content.thin-pages', 5 FROM sig WHERE word_count < 150 UNION ALL SELECT site_key, page_id, url, 'content.heading-structure', 5 FROM sig WHERE len(h1) <> 1 OR NOT heading_hierarchy_valid UNION ALL SELECT site_key, page_id, url, 'schema.presence', 5 FROM sig WHERE n_blocks = 0)
       SELECT site_key, check_id, CAST(row_number() OVER w AS INT) AS rank, page_id, url FROM ex WINDOW w AS (PARTITION BY site_key, check_id ORDER BY page_id) QUALIFY row_number() OVER w <= most""",
    "c0_make_check": f"WITH {ALL} SELECT status, severity, applicable, count(*) AS n, round(sum(points), 2) AS points, sum(max_points) AS max_points FROM chk GROUP BY ALL",
    "g1_category_scores": f"WITH {SCORES} SELECT * FROM cs",
    "g2_rebalance_weights": f"WITH {SCORES} SELECT site_key, category, available, base_weight, effective_weight FROM ws",
    "g3_overall_score": f"WITH {SCORES} SELECT * FROM ov",
    "g4_score_band": f"WITH {SCORES} SELECT *, {band('overall_score')} AS band FROM ov",
    "g4_category_summary": f"WITH {SCORES} SELECT site_key, category, score, {band('score')} AS tier, {_SUM} AS summary FROM ws",
    "g5_site_summary": f"""WITH {SCORES}, {STRONG}, {WEAK}, best AS (SELECT site_key, arg_max(category, score * 10 - category_order) AS best, arg_min(category, score * 10 - category_order) AS worst, max(score) AS bs, min(score) AS wsc FROM ws WHERE available GROUP BY 1),
       sev AS (SELECT site_key, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high FROM chk GROUP BY 1)
       SELECT site_key, overall_score, best, worst, critical, high, coalesce((SELECT string_agg(check_id, ', ' ORDER BY rank) FROM strong s WHERE s.site_key = ov.site_key), '') AS strengths, coalesce((SELECT string_agg(check_id, ', ' ORDER BY rank) FROM weak s WHERE s.site_key = ov.site_key), '') AS weaknesses,
       site_key || ' scores ' || overall_score || ' of 100. ' || CASE WHEN best <> worst THEN 'Best: ' || best || ' (' || bs || '); weakest: ' || worst || ' (' || wsc || '). ' ELSE '' END ||
       CASE WHEN critical > 0 THEN critical || ' critical and ' || high || ' high findings come first.' WHEN high > 0 THEN 'No critical finding; ' || high || ' high ones remain.' ELSE 'No severe finding.' END AS summary
       FROM ov JOIN best USING (site_key) JOIN sev USING (site_key)""",
    "g6_score_history": f"""SELECT audit_id, user_id, domain, overall_score, lag(overall_score) OVER w AS previous_score, overall_score - lag(overall_score) OVER w AS delta FROM ({b.AUDITS_SQL}) AS a WHERE status = 'COMPLETED' AND NOT is_deleted
       WINDOW w AS (PARTITION BY user_id, domain ORDER BY created_at, audit_id)""",
    "r1_recommendations": f"WITH {RECS} SELECT site_key, priority, check_id, category, severity, impact, effort FROM rec",
    "r2_horizon": f"WITH {RECS} SELECT site_key, count(*) FILTER (WHERE horizon = 'DO_FIRST') AS do_first, count(*) FILTER (WHERE horizon = 'NEXT_30_DAYS') AS next_30_days, count(*) FILTER (WHERE horizon = 'LONGER_TERM') AS longer_term FROM rec GROUP BY 1",
    "r3_expected_impact": f"WITH {RECS} SELECT site_key, check_id, horizon, shortfall, expected_impact FROM rec",
    "r4_strengths": f"WITH {ALL}, {STRONG} SELECT * FROM strong",
    "r5_weaknesses": f"WITH {ALL}, {WEAK} SELECT * FROM weak",
    "r6_cross_site_rollup": f"WITH {ALL} SELECT category, count(*) AS findings, count(*) FILTER (WHERE applicable) AS applicable, {', '.join(f'count(*) FILTER (WHERE severity = {q(s)}) AS severity_{s.lower()}' for s in lx.SEVERITIES)} FROM chk GROUP BY 1",
    "x1_competitor_pick": f"WITH {SITES}, {PICK} SELECT site_key, domain, pos, url, CAST(rank AS INT) AS rank FROM pick",
    "x2_quick_score": f"WITH {SIGNALS}, {SNAP} SELECT page_id, quick_score FROM snap",
    "x3_competitor_category_scores": f"WITH {SIGNALS}, {SNAP} SELECT page_id, technical, entity, content, answer, structured, trust FROM snap",
    "x4_competitor_name": f"WITH {SIGNALS}, {SNAP} SELECT page_id, name FROM snap",
    "x5_competitor_highlights_gaps": f"WITH {SIGNALS}, {SNAP} SELECT page_id, array_to_string(highlights, ' | ') AS highlights, array_to_string(gaps, ' | ') AS gaps FROM snap",
    "x6_competitor_compare": f"WITH {BASE}, {COMPARED} SELECT site_key, CAST(rank AS INT) AS rank, url, name, status, quick_score, word_count, question_count, type_count, array_to_string(missing_types, ' | ') AS missing_types FROM cmp",
    "v1_preview_score": f"WITH {SIGNALS}, {PREV} SELECT page_id, url, CAST(floor(100.0 * coalesce(sum(c.w) FILTER (WHERE c.ok), 0) / sum(c.w) + 0.5) AS INT) AS score, CAST(count(*) FILTER (WHERE NOT c.ok) AS INT) AS issues FROM pv GROUP BY ALL",
    "v2_preview_findings": f"""WITH {SIGNALS}, {PREV} SELECT page_id, CAST(row_number() OVER w AS INT) AS rank, c.title AS title, c.category AS category, CASE WHEN c.ok THEN 'PASSED' ELSE c.sev END AS severity, c.ok AS passed FROM pv
       WINDOW w AS (PARTITION BY page_id ORDER BY c.ok, CASE WHEN c.ok THEN 0 ELSE {rank('c.sev', lx.SEVERITIES)} END, c.w DESC, c.i) QUALIFY row_number() OVER w <= 5""",
    "t1_report_outline": f"""WITH {SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY {_SEV}, {rank('impact', ['HIGH', 'MEDIUM', 'LOW'])}, {rank('effort', ['LOW', 'MEDIUM', 'HIGH'])},
         {rank('category', [c[0] for c in sorted(lx.CATEGORIES, key=lambda c: c[3])])}, check_id) AS pr FROM chk WHERE applicable AND status IN ('FAIL', 'WARN'))
       SELECT s.site_key, s.business_name, overall_score, {band('overall_score')} AS band, (SELECT count(*) FROM sig g WHERE g.site_key = s.site_key) AS pages_crawled, coalesce((SELECT failures FROM fail x WHERE x.site_key = s.site_key), 0) AS pages_failed,
       (SELECT string_agg(category || '=' || score, ' ' ORDER BY category_order) FROM ws WHERE ws.site_key = s.site_key) AS categories, (SELECT string_agg(check_id || '=' || status, ' ' ORDER BY sort_order) FROM chk WHERE chk.site_key = s.site_key) AS findings,
       coalesce((SELECT string_agg(check_id, ' ' ORDER BY pr) FROM rk WHERE rk.site_key = s.site_key AND pr <= 5), '') AS first_fixes, coalesce((SELECT string_agg(url || '=' || status, ' ' ORDER BY rank) FROM cmp WHERE cmp.site_key = s.site_key), '') AS competitors
       FROM sites s JOIN ov ON ov.site_key = s.site_key""",
    "s3_write_audit": f"""WITH {SCORES}, {RECS.removeprefix(f"{ALL}, ")}
      SELECT s.site_key AS audit_id, 'pages' AS part, CAST(page_id AS VARCHAR) AS key, concat_ws(' ', role, word_count) AS value FROM sig AS s WHERE site_key IN (SELECT site_key FROM chk)
      UNION ALL SELECT site_key, 'findings', check_id, concat_ws(' ', status, severity) FROM chk
      UNION ALL SELECT site_key, 'category_scores', category, concat_ws(' ', score, {band('score')}) FROM ws
      UNION ALL SELECT site_key, 'scores', '', concat_ws(' ', overall_score, {band('overall_score')}) FROM ov
      UNION ALL SELECT site_key, 'fixes', check_id, concat_ws(' ', priority, horizon) FROM rec""",
    "s3_write_results": f"WITH {FETCHED} SELECT site_key AS audit_id, page_id, url, title, role, CAST(word_count AS INT) AS word_count FROM sig",
    "s4_export_csv": f"WITH {RECS} SELECT * FROM rec",
    "t1_page_section": f"""WITH {FETCHED} SELECT site_key, url, role, title, status_code, word_count, array_to_string(schema_types, ' | ') AS schema_types, len(question_headings) > 0 AS has_questions, NULL AS error FROM sig
       UNION ALL SELECT site_key, url, NULL, NULL, NULL, NULL, NULL, false, CASE WHEN {_TEXTUAL} THEN 'HTTP_ERROR' ELSE 'UNSUPPORTED_CONTENT_TYPE' END FROM allp WHERE status_code >= 400 OR NOT {_TEXTUAL}""",
    "q1_search_queries": f"""WITH s AS (SELECT *, nullif(trim(string_split_regex(coalesce(primary_services, ''), '[,;]')[1]), '') AS svc FROM ({b.SITES_SQL}) AS t),
       qs AS (SELECT site_key, [business_name || ' ' || coalesce(svc, 'services'), business_name || ' ' || coalesce(location, 'reviews'), business_name || ' reviews', CASE WHEN svc IS NULL THEN business_name || ' expertise' ELSE trim('best ' || svc || ' ' || coalesce(location, '')) END] AS l FROM s),
       u AS (SELECT site_key, query, min(i) AS i FROM (SELECT site_key, unnest(l) AS query, generate_subscripts(l, 1) AS i FROM qs) AS x GROUP BY ALL)
       SELECT site_key, CAST(row_number() OVER (PARTITION BY site_key ORDER BY i) - 1 AS INT) AS pos, query FROM u""",
    "q2_search_observations": f"""WITH r AS (SELECT *, {f.bare_host('link')} AS host FROM ({b.SEARCH_RESULTS_SQL}) AS x), s AS (SELECT *, {let("site_key", "hh", "array_to_string(string_split(hh, '.')[-2:], '.')")} AS domain FROM ({b.SITES_SQL}) AS t),
       h AS (SELECT site_key, query, host, min(rank) AS rank FROM r WHERE host <> '' GROUP BY ALL), t AS (SELECT site_key, query, list(host ORDER BY rank, host)[:8] AS hosts FROM h GROUP BY ALL)
       SELECT r.site_key, r.query, count(*) AS result_count, bool_or(contains(lower(link), domain) OR contains(lower(title), lower(business_name))) AS brand_appears, coalesce(array_to_string(any_value(hosts), ' | '), '') AS top_domains
       FROM r JOIN s USING (site_key) LEFT JOIN t ON t.site_key = r.site_key AND t.query = r.query GROUP BY r.site_key, r.query""",
}
