"""Page signals in DuckDB: ``SIGNALS`` is a chain of CTEs that ends in ``sig``."""

from corpuscope.functions import lexicon as lx
from corpuscope.sources import bindings as b
from oracles.fragments import (
    ANY_TAG, ATTRS, BLOCKS, HIDDEN, RAW, attr, attr_text, bare_host, let, members, path, q, resolve, role, scheme,
    squeeze, strings, tag, text_of, trim, unescape,
)
from oracles.limits import SITES


def meta(field, value):
    return f"nullif({trim(f'list_filter(metas, lambda m: m.{field} = {q(value)})[1].content')}, '')"


def prefixed(field, prefix):
    hits = f"list_filter(metas, lambda m: m.{field} LIKE '{prefix}%' AND m.content <> '')"
    return (
        f"list_sort(list_transform(list_distinct(list_transform({hits}, lambda m: m.{field})), lambda n: n || '=' ||"
        f" list_filter(metas, lambda m: m.{field} = n AND m.content <> '')[-1].content))"
    )


def phrases(text, items):
    return f"list_filter({strings(items)}, lambda p: contains({text}, p))"


STRIPPED = f"regexp_replace(a, {q(ANY_TAG)}, '', 'g')"
_QUESTION = r"(?i)^(" + "|".join(lx.QUESTION_WORDS) + r")\b"
_SEGMENT_END = rf"(?is)^(.*?)(?:</?(?:{BLOCKS})[\s/>]|\z)"
_MARK = (
    r"""(?:rel\s*=\s*["']?author["'\s>]|itemprop\s*=\s*["']?author["'\s>]"""
    r"""|class\s*=\s*(?:"(?:[^"]*\s)?(?:author|byline)[\s"]|'(?:[^']*\s)?(?:author|byline)[\s']|(?:author|byline)[\s>]))"""
)
_BYLINE = "(?is)" + "|".join(
    rf"<{n}\s[^>]*?{_MARK}[^>]*>?.*?</{n}\s*>"
    for n in ["a", "address", "b", "cite", "div", "em", "footer", "li", "p", "small", "span", "strong", "h4", "h5"]
)
_A = rf"""list_transform(string_split_regex(doc, '(?i)<a[\s/]')[2:], lambda s: {{
  'href': {trim(attr(f"' ' || regexp_extract(s, {q('^' + ATTRS)}, 0)", "href"))},
  'text': {text_of(f"regexp_extract(s, {q(rf'(?is)^{ATTRS}>(.*?)(?:</a{chr(92)}s*>|{chr(92)}z)')}, 1)")},
  'nofollow': contains(lower(coalesce({attr(f"' ' || regexp_extract(s, {q('^' + ATTRS)}, 0)", "rel")}, '')), 'nofollow')}})"""

# Structured-data values per block: first non-empty in reading order.
_TRACKED = members(lx.TRACKED_SCHEMA_PROPERTIES)

SIGNALS = f"""
rp AS ({b.SITE_PAGES_SQL}),
{SITES},
d0 AS (SELECT *, regexp_replace(html, {q(RAW)}, '', 'g') AS doc FROM rp),
d1 AS (SELECT *, regexp_replace(doc, {q(HIDDEN)}, '', 'g') AS content FROM d0),
ld AS (SELECT page_id, bpos, body, json_valid(body) AS valid FROM (
  SELECT page_id, generate_subscripts(bodies, 1) AS bpos, unnest(bodies) AS body FROM (
    SELECT page_id, list_filter(list_transform(list_filter(regexp_extract_all(html, {q(rf'(?is)<!--.*?-->|<script(?:[{chr(92)}s/]{ATTRS})?>.*?</script{chr(92)}s*>')}, 0),
      lambda t: {attr(f"regexp_extract(t, {q(f'(?is)^<script{ATTRS}>')}, 0)", "type")} = 'application/ld+json'),
      lambda t: {trim(f"regexp_replace(t, {q(rf'(?is)^<script{ATTRS}>|</script{chr(92)}s*>$')}, '', 'g')")}), lambda t: t <> '') AS bodies FROM rp) AS x) AS y),
nodes AS (SELECT ld.page_id, ld.bpos, t.id, t.parent, t.key, t.type, t.atom, t.value, t.path,
    len(string_split_regex(regexp_replace(t.path, '^[$]', ''), '[.]|[[]')) - 1 AS depth
  FROM ld, json_tree(CASE WHEN valid THEN body END) AS t),
typed AS (SELECT page_id, bpos, type_name, min(ord) AS ord FROM (
    SELECT page_id, bpos, json_extract_string(atom, '$') AS type_name, id AS ord FROM nodes WHERE key = '@type' AND type = 'VARCHAR'
    UNION ALL
    SELECT c.page_id, c.bpos, json_extract_string(c.atom, '$'), c.id FROM nodes c JOIN nodes p ON c.page_id = p.page_id AND c.bpos = p.bpos AND c.parent = p.id
    WHERE p.key = '@type' AND p.type = 'ARRAY' AND c.type = 'VARCHAR') AS u GROUP BY ALL),
vals AS (SELECT page_id, bpos, key, arg_min(v, parent) AS v FROM (
    SELECT page_id, bpos, key, parent, {trim("CASE type WHEN 'VARCHAR' THEN json_extract_string(atom, '$') WHEN 'OBJECT' THEN coalesce(json_extract_string(value, '$.name'), json_extract_string(value, '$.\"@id\"'), json_extract_string(value, '$.url')) END")} AS v
    FROM nodes WHERE key IN {_TRACKED}) AS w WHERE v <> '' GROUP BY ALL),
props AS (SELECT DISTINCT c.page_id, c.bpos, c.key FROM nodes c JOIN nodes p ON c.page_id = p.page_id AND c.bpos = p.bpos AND c.parent = p.id
  WHERE p.type = 'OBJECT' AND c.key NOT LIKE '@%' AND regexp_matches(c.path, '^[$]([[][0-9]+[]])?(."@graph"[[][0-9]+[]])?$')),
blk AS (SELECT ld.page_id, ld.bpos, ld.body, ld.valid,
    coalesce((SELECT list(type_name ORDER BY ord) FROM typed t WHERE t.page_id = ld.page_id AND t.bpos = ld.bpos), []) AS types,
    coalesce((SELECT list(key ORDER BY key) FROM props t WHERE t.page_id = ld.page_id AND t.bpos = ld.bpos), []) AS properties,
    coalesce((SELECT list(key || '=' || v ORDER BY key) FROM vals t WHERE t.page_id = ld.page_id AND t.bpos = ld.bpos), []) AS vals FROM ld),
ldp AS (SELECT page_id, count(*) AS n_blocks, count(*) FILTER (WHERE valid) AS n_valid FROM ld GROUP BY 1),
types AS (SELECT page_id, list(type_name ORDER BY bpos, ord) AS schema_types FROM (
    SELECT page_id, type_name, min(bpos) AS bpos, arg_min(ord, bpos) AS ord FROM typed GROUP BY ALL) AS x GROUP BY 1),
firsts AS (SELECT page_id, {", ".join(f"arg_min(v, bpos) FILTER (WHERE key = '{k}') AS ld_{k}" for k in ("name", "author", "datePublished", "dateModified", "address", "areaServed", "sameAs"))}
  FROM vals GROUP BY 1),
d2 AS (SELECT d1.*,
  list_transform(regexp_extract_all(doc, {q(tag('meta'))}, 0), lambda t: {{'name': {attr('t', 'name')}, 'property': {attr('t', 'property')},
    'content': {attr('t', 'content')}, 'charset': {attr('t', 'charset')}, 'equiv': {attr('t', 'http-equiv')}}}) AS metas,
  list_filter(list_transform(regexp_extract_all(doc, {q(rf'(?is)<h[1-6](?:[{chr(92)}s/]{ATTRS})?>.*?</h[1-6]{chr(92)}s*>')}, 0),
    lambda m: {{'level': CAST(m[3] AS INT), 'text': {text_of('m')}}}), lambda n: n.text <> '') AS headings,
  {text_of(f"regexp_replace(content, {q(rf'(?is)^.*?<body(?:[{chr(92)}s/]{ATTRS})?>')}, '')")} AS body_text,
  list_filter(list_transform(string_split_regex(content, {q(rf'(?i)<p(?:[{chr(92)}s/]{ATTRS})?>')})[2:],
    lambda s: {text_of(f"regexp_extract(s, {q(_SEGMENT_END)}, 1)")}), lambda t: length(t) > 40) AS paragraphs,
  list_transform(regexp_extract_all(doc, {q(tag('img'))}, 0), lambda t: {trim(attr('t', 'alt'))}) AS alts,
  list_filter(list_transform(list_filter({_A}, lambda n: n.href <> '' AND n.href NOT LIKE '#%' AND n.href NOT LIKE 'javascript:%'),
    lambda n: {{'href': n.href, 'absolute': {resolve('n.href', 'url')}, 'text': n.text, 'nofollow': n.nofollow}}), lambda n: n.absolute IS NOT NULL) AS links0
  FROM d1),
d3 AS (SELECT d2.* EXCLUDE (html), ldp.n_blocks, ldp.n_valid, coalesce(types.schema_types, []) AS schema_types, firsts.* EXCLUDE (page_id),
  list_transform(links0, lambda n: {{'href': n.href, 'absolute': n.absolute, 'text': n.text, 'internal': {bare_host('n.absolute')} = site_key, 'nofollow': n.nofollow, 'host': {bare_host('n.absolute')}}}) AS links,
  list_filter(regexp_extract_all(html, {q(lx.EMAIL_PATTERN)}, 0), lambda e: NOT regexp_matches(e, {q(lx.IMAGE_SUFFIX_PATTERN)})) AS emails0,
  nullif({trim(unescape(f"regexp_extract(doc, {q(rf'(?is)<title(?:[{chr(92)}s/]{ATTRS})?>(.*?)</title{chr(92)}s*>')}, 1)"))}, '') AS title,
  nullif({squeeze(f"array_to_string(list_transform(regexp_extract_all(content, {q(rf'(?is)<address(?:[{chr(92)}s/]{ATTRS})?>(.*?)</address{chr(92)}s*>')}, 1), lambda a: {unescape(STRIPPED)}), '')")}, '') AS address_text,
  list_transform(list_filter(headings, lambda n: n.level = 1), lambda n: n.text) AS h1,
  list_transform(list_filter(headings, lambda n: contains(n.text, '?') OR regexp_matches(n.text, {q(_QUESTION)})), lambda n: n.text) AS question_headings,
  {attr_text(f"list_filter(regexp_extract_all(doc, {q(tag('link'))}, 0), lambda t: {attr('t', 'rel')} = 'canonical')[1]", 'href')} AS canonical_raw
  FROM d2 LEFT JOIN ldp USING (page_id) LEFT JOIN types USING (page_id) LEFT JOIN firsts USING (page_id)),
d4 AS (SELECT *, coalesce({resolve('canonical_raw', 'url')}, canonical_raw) AS canonical,
  coalesce({meta('name', 'robots')}, {meta('name', 'googlebot')}) AS robots_meta,
  coalesce({meta('name', 'description')}, {meta('name', 'Description')}) AS meta_description,
  coalesce({meta('property', 'article:published_time')}, {meta('name', 'datePublished')},
    {attr_text(f"list_filter(regexp_extract_all(doc, {q(tag('time'))}, 0), lambda t: {attr('t', 'datetime')} IS NOT NULL)[1]", 'datetime')}, ld_datePublished) AS published_date,
  coalesce({meta('property', 'article:modified_time')}, {meta('name', 'dateModified')}, ld_dateModified) AS modified_date,
  nullif(regexp_extract(body_text, {q(lx.STATE_ZIP_PATTERN)}, 0), '') AS state_zip,
  list_filter(list_transform(regexp_extract_all(doc, {q(_BYLINE)}, 0), lambda t: {text_of('t')}), lambda t: t <> '' AND length(t) < 120) AS bylines
  FROM d3),
sig AS (SELECT page_id, site_key, url, status_code, fetch_ms, redirect_hops, content_type, {scheme('url')} = 'https' AS is_https,
  title, coalesce(length(title), 0) AS title_length, meta_description, coalesce(length(meta_description), 0) AS meta_description_length,
  canonical, coalesce({bare_host('canonical')} = {bare_host('url')} AND regexp_replace({path('canonical')}, '/$', '') = regexp_replace({path('url')}, '/$', ''), false) AS canonical_is_self,
  robots_meta, NOT (contains(lower(coalesce(robots_meta, '')), 'noindex') OR contains(lower(coalesce(robots_meta, '')), 'none')) AS is_indexable,
  CASE WHEN contains(lower(robots_meta), 'none') THEN 'NONE' WHEN contains(lower(robots_meta), 'noindex') THEN 'NOINDEX' END AS noindex_reason,
  {attr_text(f"regexp_extract(doc, {q(tag('html'))}, 0)", 'lang')} AS lang_attr, {meta('name', 'viewport')} AS viewport,
  nullif(trim(list_filter(metas, lambda m: m.charset IS NOT NULL)[1].charset), '') AS charset,
  h1, headings, question_headings,
  NOT coalesce(list_bool_or(list_transform(range(1, len(headings)), lambda i: headings[i + 1].level > headings[i].level + 1)), false) AS heading_hierarchy_valid,
  len(list_filter(string_split_regex(body_text, '\\s+'), lambda w: regexp_matches(w, '[a-zA-Z0-9]'))) AS word_count,
  len(paragraphs) AS paragraph_count, array_to_string(paragraphs, ' ') AS main_text, coalesce(paragraphs[1], '') AS first_paragraph,
  len(regexp_extract_all(content, '(?i)<(?:ul|ol)[\\s/>]')) AS list_count, len(regexp_extract_all(content, '(?i)<li[\\s/>]')) AS list_item_count,
  len(regexp_extract_all(content, '(?i)<table[\\s/>]')) AS table_count, len(regexp_extract_all(content, '(?i)<dl[\\s/>]')) AS definition_count,
  len(alts) AS image_count, len(list_filter(alts, lambda a: a <> '')) AS images_with_alt, len(list_filter(alts, lambda a: a = '')) AS images_with_empty_alt,
  links, len(list_filter(links, lambda n: n.internal)) AS internal_links, len(list_filter(links, lambda n: NOT n.internal)) AS external_links,
  len(list_distinct(list_transform(list_filter(links, lambda n: NOT n.internal AND n.host <> ''), lambda n: n.host))) AS external_domain_count,
  len(list_filter(links, lambda n: NOT n.internal AND NOT n.nofollow AND length(n.text) > 3 AND NOT regexp_matches(n.text, '^https?://'))) AS outbound_citation_links,
  {prefixed('property', 'og:')} AS og, {prefixed('name', 'twitter:')} AS twitter,
  coalesce(n_blocks, 0) AS n_blocks, coalesce(n_valid, 0) AS n_valid, schema_types, ld_name, ld_author, ld_areaServed, ld_sameAs,
  list_sort(list_distinct(list_transform(regexp_extract_all(doc, {q(r'''(?is)<[a-z][^>]*?\sitemtype\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)''')}, 1), lambda v: string_split(trim(v, '"'''), '/')[-1]))) AS microdata_types,
  list_contains(schema_types, 'FAQPage') OR list_contains(schema_types, 'Question') OR len(question_headings) >= 3 OR regexp_matches(body_text, {q(lx.FAQ_TEXT_PATTERN)}) AS has_faq_signals,
  len(question_headings) AS faq_question_count, published_date, modified_date,
  list_sort(list_distinct(list_concat(list_filter([ld_author, {meta('name', 'author')}], lambda a: a IS NOT NULL), list_transform(bylines, lambda t: regexp_replace(t, '(?i)^by\\s+', ''))))) AS authors,
  regexp_matches(body_text, {q(lx.BYLINE_PATTERN)}) AS has_byline_text,
  list_sort(list_distinct(emails0)) AS emails, list_sort(list_distinct(regexp_extract_all(body_text, {q(lx.PHONE_PATTERN)}, 0))) AS phones,
  list_filter([address_text, state_zip, ld_address], lambda a: a <> '') AS address_signals,
  len(emails0) > 0 OR regexp_matches(body_text, {q(lx.PHONE_PATTERN)}) OR address_text IS NOT NULL OR state_zip IS NOT NULL OR ld_address IS NOT NULL OR len({phrases('lower(body_text)', lx.CONTACT_KEYWORDS)}) > 0 AS has_contact_signals,
  {phrases('lower(body_text)', lx.VAGUE_PHRASES)} AS vague_phrases, {phrases('lower(body_text)', lx.SUPERLATIVES)} AS superlatives,
  len(regexp_extract_all(body_text, {q(lx.FACT_PATTERN)}, 0)) AS factual_data_points,
  {role(f"lower({path('url')})", 'title', 'h1')} AS role
  FROM d4)
"""


def page_query(columns: str) -> str:
    return f"WITH {SIGNALS} SELECT {columns} FROM sig"
