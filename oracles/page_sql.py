"""Checks for the page queries."""

from corpuscope.functions import lexicon as lx
from corpuscope.functions.urls import cidr_bounds
from corpuscope.sources import bindings as b
from oracles import fragments as f
from oracles.fragments import let, members, q
from oracles.signals import SIGNALS, page_query, phrases

J = lambda c: f"array_to_string({c}, ' | ') AS {c.split('.')[-1]}"
V4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def v4_number(x):
    return "(" + " + ".join(f"CAST(string_split({x}, '.')[{i + 1}] AS BIGINT) * {256 ** (3 - i)}" for i in range(4)) + ")"


def v4_code(x):
    whens = " ".join(
        f"WHEN {v4_number(x)} BETWEEN {cidr_bounds(c)[0]} AND {cidr_bounds(c)[1]} THEN '{code}'" for c, code in lx.BLOCKED_V4_CIDRS
    )
    return f"CASE WHEN NOT regexp_matches({x}, {q(V4)}) THEN NULL WHEN {x} IN {members(lx.METADATA_ADDRESSES_V4)} THEN 'METADATA_ENDPOINT' {whens} END"


def v6_code(x):
    tail = rf"regexp_extract({x}, '(\d+\.\d+\.\d+\.\d+)$', 1)"
    return (
        f"CASE WHEN {x} IN {members(lx.METADATA_ADDRESSES_V6)} THEN 'METADATA_ENDPOINT' WHEN {x} IN ('::', '::1') THEN 'LOOPBACK_ADDRESS'"
        f" WHEN {x} LIKE '::%' AND {tail} <> '' THEN {let(tail, 'e', v4_code('e'))}"
        f" WHEN regexp_matches({x}, '^(fe80|fe[9ab])') THEN 'LINK_LOCAL_ADDRESS' WHEN regexp_matches({x}, '^f[cdf]') THEN 'PRIVATE_ADDRESS' END"
    )


URL_CTE = rf"""raws AS ({b.RAW_URLS_SQL}),
u0 AS (SELECT url_id, raw, CASE WHEN regexp_matches(trim(raw), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN trim(raw) ELSE 'https://' || trim(raw) END AS v FROM raws),
u1 AS (SELECT *, {f.scheme('v')} AS sch, regexp_replace({f.authority('v')}, '^.*@', '') AS hp, regexp_extract({f.authority('v')}, '^(.*)@', 1) AS who FROM u0),
u2 AS (SELECT *, regexp_replace(regexp_replace(hp, ':\d*$', ''), '\.$', '') AS name, TRY_CAST(regexp_extract(hp, ':(\d*)$', 1) AS BIGINT) AS port FROM u1),
u3 AS (SELECT *, regexp_replace(name, '^\[|\]$', '', 'g') AS lit FROM u2),
codes AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'EMPTY' WHEN sch NOT IN ('http', 'https') THEN 'UNSUPPORTED_SCHEME'
  WHEN name = '' OR regexp_matches(name, '[\s<>\\^`{{|}}%]') OR (contains(name, ':') AND name NOT LIKE '[%') OR port > 65535 THEN 'MALFORMED'
  WHEN who NOT IN ('', ':') THEN 'CREDENTIALS_IN_URL'
  WHEN regexp_matches(lit, {q(V4)}) AND {v4_code('lit')} IS NOT NULL THEN {v4_code('lit')}
  WHEN name LIKE '[%' AND {v6_code('lit')} IS NOT NULL THEN {v6_code('lit')}
  WHEN NOT regexp_matches(lit, {q(V4)}) AND name NOT LIKE '[%' AND (name IN {members(lx.BLOCKED_HOSTNAMES)} OR NOT contains(name, '.')
    OR {' OR '.join(f"name LIKE '%{s}'" for s in lx.BLOCKED_SUFFIXES)}) THEN 'BLOCKED_HOSTNAME'
  WHEN port IN ({', '.join(map(str, lx.BLOCKED_PORTS))}) OR port = 0 THEN 'BLOCKED_PORT' ELSE 'OK' END AS code FROM u3)"""

_KEPT = f"""array_to_string(list_transform(list_filter(string_split({f.query('v')}[2:], '&'),
  lambda p: p <> '' AND string_split(p, '=')[1] NOT IN {members(lx.TRACKING_PARAMS)}), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"""
_HOST = f.host("url")
_DOMAIN = let(
    f"regexp_replace({_HOST}, '^www[.]', '')", "h",
    f"CASE WHEN len(string_split(h, '.')) <= 2 THEN h WHEN string_split(h, '.')[-2] IN {members(lx.SECOND_LEVEL_SUFFIXES)}"
    " THEN array_to_string(string_split(h, '.')[-3:], '.') ELSE array_to_string(string_split(h, '.')[-2:], '.') END",
)
_TEXTUAL = f"(content_type IS NULL OR lower(trim(string_split(content_type, ';')[1])) IN {members(lx.TEXTUAL_CONTENT_TYPES)})"

SQL = {
    "s1_scan_pages": f"SELECT page_id, url, site_key, content_type, length(html) AS html_chars FROM ({b.SITE_PAGES_SQL}) AS p WHERE {_TEXTUAL}",
    "s2_scan_events": "SELECT event_id, user_id, event_type, value, ts FROM events",
    "u1_url_normalize": f"WITH {URL_CTE} SELECT url_id, {f.origin('v')} || {f.clean_path(f.path('v'))} || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END AS normalized FROM codes WHERE code = 'OK'",
    "u2_url_validate": f"WITH {URL_CTE} SELECT url_id, raw, code FROM codes",
    "u3_ip_classify": f"""SELECT address_id, address, CASE WHEN regexp_matches(address, {q(V4)}) THEN 4 WHEN contains(address, ':') THEN 6 ELSE 0 END AS version,
       CASE WHEN regexp_matches(address, {q(V4)}) THEN {v4_code('address')} WHEN contains(address, ':') THEN {v6_code('lower(address)')} END AS code FROM ({b.ADDRESSES_SQL}) AS a""",
    "u4_registrable_domain": f"SELECT page_id, {_DOMAIN} AS domain FROM pages",
    "u5_url_key": f"SELECT page_id, {f.url_key('url')} AS url_key FROM pages",
    "u6_url_dedupe": f"""SELECT site_key, url_key, page_id, url, copies FROM (SELECT *, row_number() OVER (PARTITION BY site_key, url_key ORDER BY page_id) AS rn,
       count(*) OVER (PARTITION BY site_key, url_key) AS copies FROM (SELECT page_id, site_key, url, {f.url_key('url')} AS url_key FROM ({b.SITE_PAGES_SQL}) AS p) AS k) AS r WHERE rn = 1""",
    "p1_page_meta": page_query("page_id, title, title_length, meta_description, meta_description_length, canonical, canonical_is_self, lang_attr, viewport, charset"),
    "p2_page_indexability": page_query("page_id, robots_meta, is_indexable, noindex_reason"),
    "p3_page_headings": page_query(f"page_id, array_to_string(list_transform(headings, lambda n: n.level || ':' || n.text), ' | ') AS headings, {J('h1')}, {J('question_headings')}, heading_hierarchy_valid"),
    "p4_page_paragraphs": page_query("page_id, paragraph_count, main_text, first_paragraph"),
    "p5_page_word_count": page_query("page_id, word_count"),
    "p6_page_structure_counts": page_query("page_id, list_count, list_item_count, table_count, definition_count"),
    "p7_page_images": page_query("page_id, image_count, images_with_alt, images_with_empty_alt"),
    "p8_page_link_stats": page_query("page_id, internal_links, external_links, external_domain_count, outbound_citation_links"),
    "p9_page_social_meta": page_query("page_id, array_to_string(og, ' | ') AS open_graph, array_to_string(twitter, ' | ') AS twitter_card"),
    "p10_page_jsonld": f"WITH {SIGNALS} SELECT page_id, CAST(bpos - 1 AS INT) AS pos, valid, {J('types')}, {J('properties')}, array_to_string(vals, ' | ') AS values, body AS excerpt FROM blk",
    "p11_page_microdata": page_query(f"page_id, {J('microdata_types')}"),
    "p12_page_faq": page_query(f"page_id, has_faq_signals, faq_question_count, {J('schema_types')}"),
    "p13_page_dates": page_query("page_id, published_date, modified_date"),
    "p14_page_authors": page_query(f"page_id, {J('authors')}, has_byline_text"),
    "p15_page_contacts": page_query(f"page_id, {J('emails')}, {J('phones')}, {J('address_signals')}, has_contact_signals"),
    "p16_page_lexicon": page_query(f"page_id, {J('vague_phrases')}, {J('superlatives')}"),
    "p16_document_lexicon": f"""SELECT doc_id, array_to_string({phrases('lower(t)', lx.VAGUE_PHRASES)}, ' | ') AS vague_phrases, array_to_string({phrases('lower(t)', lx.SUPERLATIVES)}, ' | ') AS superlatives,
       len(regexp_extract_all(t, {q(lx.FACT_PATTERN)}, 0)) AS facts, len(list_filter(string_split_regex(t, '\\s+'), lambda w: regexp_matches(w, '[a-zA-Z0-9]'))) AS words
       FROM (SELECT doc_id, {f.squeeze('text')} AS t FROM documents) AS d""",
    "p17_page_fact_count": page_query("page_id, factual_data_points"),
    "p18_page_role": page_query("page_id, url, role"),
    "p19_page_signals": page_query(f"page_id, site_key, url, status_code, title, word_count, paragraph_count, internal_links, external_links, is_indexable, canonical_is_self, has_faq_signals, has_contact_signals, role, {J('schema_types')}, factual_data_points, image_count, list_count, published_date, md5(main_text) AS text_md5"),
}
