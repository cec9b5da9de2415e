"""Page signals: one wide row per page, derived from its markup.

``page_signals`` is a chain of projections - no shuffle.  A caller that selects a few columns pays
for those only, since Catalyst prunes the rest (the Arrow UDF of the structured-data columns
included).  ``html`` itself is not carried on.
"""

from functools import cache

from pyspark.sql import DataFrame, functions as F

from corpuscope.functions import html as h
from corpuscope.functions import lexicon as lx
from corpuscope.functions import urls as u
from corpuscope.functions.sqltext import concat, each, first, fn, keep, let, listed, q, strings, tail
from corpuscope.operators import jsonld

# The lexicon's patterns with a test first that most characters fail.  A run of an address's characters is tried
# from its start only, or from where the address before it ended: what follows the run is the same from anywhere in it.
_LOCAL = "[a-zA-Z0-9._%+-]"
EMAIL = lx.EMAIL_PATTERN.replace(f"{_LOCAL}+", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++", 1)
PHONE = "(?=[+(0-9])" + lx.PHONE_PATTERN
STATE_ZIP = r"(?=[A-Z][A-Z]\s)" + lx.STATE_ZIP_PATTERN
BYLINE = r"(?=by\s)" + lx.BYLINE_PATTERN
AUTHOR_WORD = "(?i)(?=[ab])(?:author|byline)"
FACT = lx.FACT_PATTERN.replace("(?i)", "(?i)(?=[0-9])", 1)

OPTIONAL_INPUTS = {"status_code": "int", "fetch_ms": "int", "redirect_hops": "int", "content_type": "string"}


# ---- pieces of a page -------------------------------------------------------------------


def meta_tags(doc: str) -> str:
    fields = {"name": "name", "property": "property", "content": "content", "charset": "charset", "equiv": "http-equiv"}
    return each(h.extract_all(doc, h.tag("meta")), lambda t: h.attrs(t, fields))


def meta_content(field: str, value: str) -> str:
    """Content of the first tag whose ``field`` equals ``value``; null when blank."""
    return h.blank_to_null(h.trim_ws(first(keep("metas", lambda m: f"{m}.{field} = {q(value)}")) + ".content"))


def heading_nodes(doc: str) -> str:
    found = each(
        h.extract_all(doc, rf"(?is)<h[1-6](?:[\s/]{h.ATTRS})?>.*?</h[1-6]\s*>"),
        lambda m: f"named_struct('level', CAST(substring({m}, 3, 1) AS INT), 'text', {h.text_of(m)})",
    )
    return keep(found, lambda n: f"{n}.text <> ''")


def question_texts(headings: str) -> str:
    pattern = r"(?i)^(" + "|".join(lx.QUESTION_WORDS) + r")\b"
    return keep(each(headings, lambda n: f"{n}.text"), lambda t: f"contains({t}, '?') OR {h.matches(t, pattern)}")


def hierarchy_valid(headings: str) -> str:
    """No heading steps down more than one level from the one before."""
    levels = each(headings, lambda n: f"{n}.level")
    jumps = let(levels, lambda v: f"zip_with({v}, slice({v}, 2, size({v})), (a, b) -> coalesce(b > a + 1, false))")
    return f"NOT exists({jumps}, {fn(lambda j: j)})"


def paragraph_texts(content: str) -> str:
    """Texts of <p> elements longer than 40 characters; the next block ends an open one."""
    end = rf"(?i)^([^<]*+(?:<(?!/?(?:{h.BLOCK_TAGS})[\s/>])[^<]*+)*+)"
    segments = tail(f"split({content}, {q(h.tag('p'))})")
    return keep(each(segments, lambda s: h.text_of(h.extract(s, end, 1))), lambda t: f"length({t}) > 40")


def body_markup(content: str) -> str:
    """What follows the body tag; without one, what follows the head."""
    return (
        f"CASE WHEN {h.matches(content, r'(?i)<body[\s/>]')} THEN {h.replace(content, rf'(?is)^.*?<body(?:[\s/]{h.ATTRS})?>')}"
        f" WHEN {h.matches(content, r'(?i)</head\s*>')} THEN {h.replace(content, r'(?is)^.*?</head\s*>')}"
        f" ELSE {h.replace(content, r'(?is)<title[^>]*>.*?</title\s*>')} END"
    )


def word_count(text: str) -> str:
    """White-space separated tokens that hold a letter or digit: its first one takes the rest of the token along."""
    return h.count_matches(text, r"[a-zA-Z0-9]\S*+")


def count_tags(*names: str) -> str:
    """Number of the page's ``marks`` of these names."""
    return f"size({keep('marks', lambda m: f'lower({m}) IN {listed(names)}')})"


def email_texts(html: str) -> str:
    """Addresses in a page; all that is read are the runs of an address's characters on both sides of each "@"."""
    def sides(p):
        before = f"reverse({h.extract(f'reverse({p})', f'^{_LOCAL}*+')})"
        return let(h.extract(p, f"^{_LOCAL}*+"), lambda run: f"CASE WHEN {run} = {p} THEN {p} ELSE concat({run}, ' ', {before}) END")

    found = h.extract_all(f"array_join({each(f"split({html}, '@')", sides)}, '@')", EMAIL)
    return f"CASE WHEN contains({html}, '@') THEN {found} ELSE CAST(array() AS ARRAY<STRING>) END"


def link_nodes(doc: str, url: str, site_host: str) -> str:
    """<a href> of a page in document order, resolved against the page."""

    def node(s):
        head = h.attrs(h.extract(s, rf"^{h.ATTRS}"), {"href": "href", "rel": "rel"})
        inner = h.extract(s, rf"(?i)^{h.ATTRS}>([^<]*+(?:<(?!/a\s*>)[^<]*+)*+)", 1)
        return let(head, lambda a: (
            f"named_struct('href', {h.trim_ws(f'{a}.href')}, 'text', {h.text_of(inner)},"
            f" 'nofollow', contains(lower(coalesce({a}.rel, '')), 'nofollow'))"
        ))

    raw = each(tail(f"split({doc}, {q(r'(?i)<a(?=[\s/])')})"), node)
    usable = keep(raw, lambda n: f"{n}.href <> '' AND NOT startswith({n}.href, '#') AND NOT startswith({n}.href, 'javascript:')")

    def target(n, b):
        other = let(u.resolve_on(f"{n}.href", b), lambda a: f"named_struct('absolute', {a}, 'host', {u.bare_host(a)})")
        return f"CASE WHEN {u.is_plain(f'{n}.href', b)} THEN named_struct('absolute', concat({b}.origin, {n}.href), 'host', {b}.host) ELSE {other} END"

    found = let(u.base_parts(url), lambda b: each(usable, lambda n: f"named_struct('n', {n}, 't', {target(n, b)})"))
    hosted = keep(found, lambda r: f"{r}.t.absolute IS NOT NULL")
    return each(
        hosted,
        lambda r: f"named_struct('href', {r}.n.href, 'absolute', {r}.t.absolute, 'text', {r}.n.text,"
        f" 'internal', {r}.t.host = {site_host}, 'nofollow', {r}.n.nofollow, 'host', {r}.t.host)",
    )


def tagged_map(field: str, prefix: str) -> str:
    """Map of the tags whose ``field`` starts with ``prefix``; the last one of a name wins."""

    def build(hits):
        names = f"array_distinct({each(hits, lambda m: f'{m}.{field}')})"

        def latest(n):
            same = keep(hits, lambda m: f"{m}.{field} = {n}")
            return f"element_at({same}, -1).content"

        return f"map_from_arrays({names}, {each(names, latest)})"

    return let(keep("metas", lambda m: f"startswith({m}.{field}, {q(prefix)}) AND {m}.content <> ''"), build)


def phrases_in(lower_text: str, phrases: list[str]) -> str:
    return let(lower_text, lambda t: keep(strings(phrases), lambda p: f"contains({t}, {p})"))


def block_value(name: str) -> str:
    """First block's non-empty value of a tracked property."""
    return first(keep("json_ld", lambda b: f"coalesce({b}.values[{q(name)}], '') <> ''")) + f".values[{q(name)}]"


def byline_texts(doc: str) -> str:
    """Texts of elements marked as the author (rel=author, class author/byline, itemprop=author)."""
    mark = (
        r"""(?:rel\s*=\s*["']?author["'\s>]|itemprop\s*=\s*["']?author["'\s>]"""
        r"""|class\s*=\s*(?:"(?:[^"]*\s)?(?:author|byline)[\s"]|'(?:[^']*\s)?(?:author|byline)[\s']|(?:author|byline)[\s>]))"""
    )
    names = ["a", "address", "b", "cite", "div", "em", "footer", "li", "p", "small", "span", "strong", "h4", "h5"]
    elements = h.extract_all(doc, "(?is)<(?:" + "|".join(rf"{n}\s[^>]*?{mark}[^>]*>?.*?</{n}\s*>" for n in names) + ")")
    named = keep(each(elements, h.text_of), lambda t: f"{t} <> '' AND length({t}) < 120")
    names_only = each(named, lambda t: h.replace(t, r"(?i)^by\s+"))
    return f"CASE WHEN {h.matches(doc, AUTHOR_WORD)} THEN {names_only} ELSE CAST(array() AS ARRAY<STRING>) END"


def _alt(t: str) -> str:
    bare = f"CASE WHEN {h.matches(t, r'''(?i)[\s"']alt[\s/>]''')} THEN '' END"
    return h.trim_ws(f"coalesce({h.attr(t, 'alt')}, {bare})")


# ---- the wide row, in three projections --------------------------------------------------

CARRIED = ["page_id", "site_key", "url", "status_code", "fetch_ms", "redirect_hops", "content_type"]


@cache
def _pieces() -> dict[str, str]:
    return {
        "metas": meta_tags("doc"),
        "headings": heading_nodes("doc"),
        "body_text": h.text_of(body_markup("content")),
        "paragraphs": paragraph_texts("content"),
        "imgs": h.extract_all("doc", h.tag("img")),
        "marks": h.extract_all("content", r"(?i)<(ul|ol|li|table|dl)[\s/>]", 1),
        "links": link_nodes("doc", "url", "site_key"),
        "ld_bodies": jsonld.script_bodies("html"),
    }


@cache
def _extracted() -> dict[str, str]:
    link_tags = h.extract_all("doc", h.tag("link"))
    named = lambda t: f"(contains({t}, 'canonical') OR contains({t}, '&'))"
    canonical = h.attr_text(first(keep(link_tags, lambda t: f"{named(t)} AND {h.attr(t, 'rel')} = 'canonical'")), "href")
    times = keep(h.extract_all("doc", h.tag("time")), lambda t: f"{h.attr(t, 'datetime')} IS NOT NULL")
    emails = keep(email_texts("html"), lambda e: f"NOT {h.matches(e, lx.IMAGE_SUFFIX_PATTERN)}")
    addresses = each(
        h.extract_all("content", rf"(?is)<address(?:[\s/]{h.ATTRS})?>(.*?)</address\s*>", 1),
        lambda a: h.unescape(h.strip_tags(a)),
    )
    item_types = each(
        h.extract_all("doc", r"""(?is)<[a-z][^>]*?\sitemtype\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1),
        lambda v: "element_at(split(" + h.unescape(h.replace(v, r"""^["']|["']$""")) + ", '/'), -1)",
    )
    title = h.extract("doc", rf"(?is)<title(?:[\s/]{h.ATTRS})?>(.*?)</title\s*>", 1)
    charset = first(keep("metas", lambda m: f"{m}.charset IS NOT NULL")) + ".charset"
    return {
        "is_https": f"{u.scheme('url')} = 'https'",
        "title": h.blank_to_null(h.trim_ws(h.unescape(title))),
        "meta_description": f"coalesce({meta_content('name', 'description')}, {meta_content('name', 'Description')})",
        "canonical": let(canonical, lambda c: f"coalesce({u.resolve(c, 'url')}, {c})"),
        "robots_meta": f"coalesce({meta_content('name', 'robots')}, {meta_content('name', 'googlebot')})",
        "lang_attr": h.attr_text(h.extract("doc", h.tag("html")), "lang"),
        "viewport": meta_content("name", "viewport"),
        "charset": f"coalesce({h.blank_to_null(h.trim_ws(charset))},"
                   f" {h.blank_to_null(h.extract(meta_content('equiv', 'Content-Type'), r'(?i)charset=([\w-]+)', 1))})",
        "headings": "headings",
        "word_count": word_count("body_text"),
        "paragraphs": "paragraphs",
        "list_count": count_tags("ul", "ol"),
        "list_item_count": count_tags("li"),
        "table_count": count_tags("table"),
        "definition_count": count_tags("dl"),
        "alts": each("imgs", _alt),
        "links": "links",
        "open_graph": tagged_map("property", "og:"),
        "twitter_card": tagged_map("name", "twitter:"),
        "json_ld": "blocks",
        "microdata_types": f"array_distinct({keep(item_types, lambda t: f'{t} <> {q(str())}')})",
        "faq_wording": f"contains(body_lower, 'frequently asked questions') AND {h.matches('body_text', lx.FAQ_TEXT_PATTERN)}",
        "tagged_published": f"coalesce({meta_content('property', 'article:published_time')},"
                            f" {meta_content('name', 'datePublished')}, {h.attr_text(first(times), 'datetime')})",
        "tagged_modified": f"coalesce({meta_content('property', 'article:modified_time')}, {meta_content('name', 'dateModified')})",
        "meta_author": meta_content("name", "author"),
        "bylines": byline_texts("doc"),
        "has_byline_text": h.matches("body_text", BYLINE),
        "emails": f"array_distinct({emails})",
        "phones": f"array_distinct({h.extract_all('body_text', PHONE)})",
        "address_text": h.blank_to_null(h.squeeze(f'array_join({addresses}, {q(str())})')),
        "state_zip": h.blank_to_null(h.extract("body_text", STATE_ZIP)),
        "vague_phrases": phrases_in("body_lower", lx.VAGUE_PHRASES),
        "superlatives": phrases_in("body_lower", lx.SUPERLATIVES),
        "contact_wording": f"size({phrases_in('body_lower', lx.CONTACT_KEYWORDS)}) > 0",
        "factual_data_points": h.count_matches("body_text", FACT),
    }


@cache
def _derived() -> dict[str, str]:
    robots = "lower(coalesce(robots_meta, ''))"
    outside = keep("links", lambda n: f"NOT {n}.internal")
    cited = keep(outside, lambda n: f"NOT {n}.nofollow AND length({n}.text) > 3 AND NOT {h.matches(f'{n}.text', '^https?://')}")
    hosts = each(keep(outside, lambda n: f"{n}.host <> ''"), lambda n: f"{n}.host")
    same_path = f"{h.replace(u.path('canonical'), '/$')} = {h.replace(u.path('url'), '/$')}"
    return {
        "title_length": "coalesce(length(title), 0)",
        "meta_description_length": "coalesce(length(meta_description), 0)",
        "canonical_is_self": f"coalesce({u.bare_host('canonical')} = {u.bare_host('url')} AND {same_path}, false)",
        "is_indexable": f"NOT contains({robots}, 'noindex') AND NOT contains({robots}, 'none')",
        "noindex_reason": f"CASE WHEN contains({robots}, 'none') THEN 'NONE'"
                          f" WHEN contains({robots}, 'noindex') THEN 'NOINDEX' END",
        "h1": each(keep("headings", lambda n: f"{n}.level = 1"), lambda n: f"{n}.text"),
        "question_headings": question_texts("headings"),
        "heading_hierarchy_valid": hierarchy_valid("headings"),
        "paragraph_count": "size(paragraphs)",
        "main_text": "array_join(paragraphs, ' ')",
        "first_paragraph": "coalesce(get(paragraphs, 0), '')",
        "image_count": "size(alts)",
        "images_with_alt": f"size({keep('alts', lambda a: f'{a} <> {q(str())}')})",
        "images_with_empty_alt": f"size({keep('alts', lambda a: f'{a} = {q(str())}')})",
        "internal_links": f"size({keep('links', lambda n: f'{n}.internal')})",
        "external_links": f"size({outside})",
        "external_domains": f"array_distinct({hosts})",
        "outbound_citation_links": f"size({cited})",
        "schema_types": f"array_distinct(flatten({each('json_ld', lambda b: f'{b}.types')}))",
        "published_date": f"coalesce(tagged_published, {block_value('datePublished')})",
        "modified_date": f"coalesce(tagged_modified, {block_value('dateModified')})",
        "authors": f"array_distinct(concat(array_compact(array({block_value('author')}, meta_author)), bylines))",
        "address_signals": f"array_compact(array(address_text, state_zip, {block_value('address')}))",
    }


ROLE = u.page_role(f"lower({u.path('url')})", "title", "h1")
SIGNAL_COLUMNS = [
    *CARRIED, "is_https",
    "title", "title_length", "meta_description", "meta_description_length", "canonical", "canonical_is_self",
    "robots_meta", "is_indexable", "noindex_reason", "lang_attr", "viewport", "charset",
    "h1", "headings", "question_headings", "heading_hierarchy_valid",
    "word_count", "paragraph_count", "main_text", "first_paragraph",
    "list_count", "list_item_count", "table_count", "definition_count",
    "image_count", "images_with_alt", "images_with_empty_alt",
    "links", "internal_links", "external_links", "external_domains", "outbound_citation_links",
    "open_graph", "twitter_card", "json_ld", "schema_types", "microdata_types",
    "published_date", "modified_date", "authors", "has_byline_text",
    "emails", "phones", "address_signals",
    "vague_phrases", "superlatives", "factual_data_points",
]


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in columns.items()]


def with_inputs(pages: DataFrame) -> DataFrame:
    """Fill in the optional fetch columns and the site key."""
    defaults = {"status_code": "200", "redirect_hops": "0"}
    columns = {c: c for c in ("page_id", "url", "html")}
    for name, kind in OPTIONAL_INPUTS.items():
        columns[name] = name if name in pages.columns else f"CAST({defaults.get(name, 'NULL')} AS {kind})"
    columns["site_key"] = "site_key" if "site_key" in pages.columns else u.bare_host("url")
    return pages.selectExpr(*_select(columns))


def page_signals(pages: DataFrame) -> DataFrame:
    base = with_inputs(pages).selectExpr(*CARRIED, "html", f"{h.replace('html', h.RAW_BLOCKS)} AS doc")
    cut = base.selectExpr("*", f"{h.replace('doc', h.HIDDEN_BLOCKS)} AS content")
    pieces = cut.selectExpr("*", *_select(_pieces())).withColumn(
        "blocks", F.coalesce(jsonld.read_blocks("ld_bodies"), F.array().cast(jsonld.BLOCK_SCHEMA))
    )
    pieces = pieces.selectExpr("*", "lower(body_text) AS body_lower")
    wide = pieces.selectExpr(*CARRIED, *_select(_extracted())).selectExpr("*", *_select(_derived()))
    faq = (
        "array_contains(schema_types, 'FAQPage') OR array_contains(schema_types, 'Question')"
        " OR size(question_headings) >= 3 OR faq_wording"
    )
    contact = "size(emails) > 0 OR size(phones) > 0 OR size(address_signals) > 0 OR contact_wording"
    return wide.selectExpr(
        *SIGNAL_COLUMNS,
        f"{faq} AS has_faq_signals",
        "size(question_headings) AS faq_question_count",
        f"{contact} AS has_contact_signals",
        f"{ROLE} AS role",
    )
