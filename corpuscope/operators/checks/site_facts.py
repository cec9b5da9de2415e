"""Everything the checks read about a site, one row per site.

Pages are reduced in two steps that both start with a map-side aggregate, so a site that owns a
third of the corpus costs its mappers, not one reducer:

* numbers, flags and bit masks over all pages (fixed-width buffers: hash aggregation);
* values whose repetition counts (titles, descriptions, openings, stated services) are first
  counted per site and value, keyed by a hash of the value.

No page text is ever gathered per site: every pattern is tested page by page.
"""

from functools import cache

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.functions import html as h
from corpuscope.functions import lexicon as lx
from corpuscope.functions.sqltext import concat, each, first, fn, keep, let, listed, q, strings
from corpuscope.operators.joins import lookup

SCHEMA_BITS = list(dict.fromkeys([
    *lx.ORG_TYPES, *lx.CONTENT_TYPES, "WebSite", "BreadcrumbList", "FAQPage", "Person", "Review", "AggregateRating",
]))
ROLES = ["ABOUT", "CONTACT", "FAQ", "CASE_STUDY", "AUTHOR", "BLOG_INDEX", "ARTICLE", "SERVICE", "PRODUCT", "CATEGORY"]
EDITORIAL = ["ARTICLE", "BLOG_INDEX", "CASE_STUDY"]
OFFERS = ["SERVICE", "PRODUCT", "CATEGORY"]


def bits(types: list[str]) -> int:
    return sum(1 << SCHEMA_BITS.index(t) for t in types)


def has_types(*types: str) -> str:
    return f"(coalesce(type_bits, 0L) & {bits(list(types))}L) <> 0"


def _mask(items: str, known: list[str]) -> str:
    """Bit i is set when the array holds the i-th known item."""
    step = f"(a, p) -> a | shiftleft(1L, CAST(array_position({strings(known)}, p) AS INT) - 1)"
    return f"aggregate({keep(items, lambda p: f'{p} IN {listed(known)}')}, 0L, {step})"


def _contains_mask(text: str, terms: list[str]) -> str:
    return let(text, lambda t: " + ".join(f"IF(contains({t}, {q(term)}), {1 << i}L, 0L)" for i, term in enumerate(terms)))


def _any_token(tokens: str, text: str) -> str:
    return let(text, lambda t: f"exists({tokens}, {fn(lambda k: f'contains({t}, {k})')})")


#: What lower-cased text holds wherever a pattern matches: one of these, looked for as they stand, which costs a
#: small part of trying the pattern at each word.
HINTS = {
    lx.TESTIMONIAL_PATTERN: ["testimonial", "review", "client said", "what our customers say", "rated "],
    lx.ORIGINAL_DATA_PATTERN: ["our data", "our research", "our survey", "our study", "our analysis",
                               "we surveyed", "we analyzed", "we measured", "we tested"],
    lx.PROJECT_COUNT_PATTERN: ["project", "installation", "client", "customer", "home", "job"],
    lx.COMPARISON_TEXT_PATTERN: ["vs", "versus", "compared to", "comparison", "difference between", "which is better", "pros and cons",
                                 "alternatives to"],
    lx.PROCESS_PATTERN: ["step ", "how to", "our process", "the process", "what to expect"],
    lx.CREDENTIAL_PATTERN: ["certified", "licensed", "accredited", "years of experience", "degree", "qualified", "member of", "master",
                            "journeyman", "registered"],
    lx.SOURCE_PATTERN: ["according to", "source:", "sources:", "data from", "published by", "as reported by", "per the", "based on data"],
    lx.PROOF_PATTERN: ["testimonial", "what our clients say", "what our customers say", "case stud", "success stor", "reviewed us", "★",
                       "rated "],
    lx.LICENCE_PATTERN: ["lic", "ein", "registration"],
    lx.FOUNDED_YEAR_PATTERN: ["since", "established", "founded "],
}
#: The same for definitions, in text as it stands; its white space is single blanks.
DEFINITION_HINTS = [f" {verb} {article}" for verb in ("is", "are", "means", "refers to") for article in ("a", "the")]


def _holds(text: str, hints: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in hints) + ")"


def _worded(starts: str, pattern: str, tried: str | None = None) -> str:
    """``matches_word`` of the page's text, where that holds a hint of the pattern."""
    return f"{_holds('lower_text', HINTS[pattern])} AND {tried or h.matches_word('main_text', starts, pattern)}"


def _by_letter(words: list[str]) -> str:
    """Pattern of these words that reads their common beginnings once."""
    heads = {w[:1]: [v[1:] for v in words if v[:1] == w[:1]] for w in words}
    return "(?:" + "|".join(c + (_by_letter(rest) if len(rest) > 1 else rest[0]) if c else "" for c, rest in heads.items()) + ")"


US_STATE = rf"(?i)\b{_by_letter(lx.US_STATE_PATTERN.removeprefix('(?i)' + chr(92) + 'b(').removesuffix(')' + chr(92) + 'b').split('|'))}\b"


def _at_home(fact: str) -> str:
    """A fact that is read of the home page only, null elsewhere."""
    return f"CASE WHEN is_seed THEN {fact} END"


@cache
def _page_facts() -> dict[str, str]:
    text = "main_text"
    home = "coalesce(meta_description, main_text)"
    org_block = first(keep("json_ld", lambda b: f"arrays_overlap({b}.types, {strings(lx.ORG_TYPES)})"))

    def completeness(b):
        def part(names):
            present = keep(strings(names), lambda p: f"map_contains_key({b}.values, {p})")
            return f"size({present}) / {len(names)}D * 0.5D"
        return f"{part(lx.ORG_REQUIRED)} + {part(lx.ORG_VALUABLE)}"

    def opening(chars):
        return f"substring({text}, 1, {chars})"

    names = each(keep("json_ld", lambda b: f"{b}.values['name'] IS NOT NULL"), lambda b: f"{b}.values['name']")
    return {
        "is_https": "is_https", "is_indexable": "is_indexable", "status_code": "status_code",
        "fetch_ms": "fetch_ms", "redirect_hops": "redirect_hops", "role": "role", "word_count": "word_count",
        "has_canonical": "canonical IS NOT NULL", "has_viewport": "viewport IS NOT NULL", "has_lang": "lang_attr IS NOT NULL",
        "image_count": "image_count", "with_alt": "images_with_alt + images_with_empty_alt",
        "brand_title": _any_token("tokens", "lower(coalesce(title, ''))"),
        "brand_h1": _at_home(_any_token("tokens", r"lower(array_join(h1, '\n'))")),
        "brand_text": _at_home(f"size(tokens) > 0 AND forall(tokens, {fn(lambda k: f'contains(lower_text, {k})')})"),
        "brand_any": _at_home(_any_token("long_tokens", "lower_text")),
        "no_tokens": "size(tokens) = 0",
        "does_verb": _at_home(h.matches(home, lx.ACTIVITY_VERB_PATTERN)),
        "does_chars": _at_home(f"length({h.trim_ws(home)})"),
        "audience": _contains_mask("lower_text", lx.AUDIENCE_TERMS),
        "subheadings": f"size({keep('headings', lambda n: f'{n}.level IN (2, 3)')})",
        "has_address": "size(address_signals) > 0", "us_state": h.matches_word(text, "a-dfghik-pr-w", US_STATE),
        "area_served": f"exists(json_ld, {fn(lambda b: f'{b}.values[{q('areaServed')}] IS NOT NULL')})",
        "has_title": "title IS NOT NULL", "sized_title": "title_length BETWEEN 25 AND 65",
        "described": "meta_description_length >= 50",
        "has_og": "coalesce(open_graph['og:title'], '') <> '' AND coalesce(open_graph['og:description'], '') <> ''",
        "facts": "factual_data_points",
        "vague": _mask("vague_phrases", lx.VAGUE_PHRASES), "superlative": _mask("superlatives", lx.SUPERLATIVES),
        "dated": "published_date IS NOT NULL OR modified_date IS NOT NULL",
        "page_date": "try_to_timestamp(coalesce(modified_date, published_date))",
        "internal_links": "internal_links", "hierarchy": "heading_hierarchy_valid", "one_h1": "size(h1) = 1",
        "testimonial": _worded("crtw", lx.TESTIMONIAL_PATTERN), "own_data": _worded("ow", lx.ORIGINAL_DATA_PATTERN),
        "project_counts": _worded("0-9", lx.PROJECT_COUNT_PATTERN),
        "questions": "size(question_headings)", "faq": "has_faq_signals",
        "quotable": "CASE WHEN paragraph_count > 0 THEN floor(word_count / paragraph_count + 0.5) ELSE 0 END BETWEEN 25 AND 130",
        "lists": "list_count", "tables": "table_count", "definition_lists": "definition_count",
        "definitions": f"CASE WHEN {_holds(text, DEFINITION_HINTS)} THEN {h.count_matches(text, '(?=[A-Z])' + lx.DEFINITION_PATTERN)} ELSE 0 END",
        "compares": _worded("acdpvw", lx.COMPARISON_TEXT_PATTERN),
        "comparison_page": h.matches("concat(coalesce(title, ''), ' ', url)", lx.COMPARISON_PAGE_PATTERN),
        "front_loaded": let(opening(lx.FRONT_LOADED_CHARS), lambda t: f"length({t}) >= 80 AND {h.matches(t, lx.DECLARATIVE_PATTERN)}"),
        "summarised": let(opening(lx.SUMMARY_CHARS), lambda t: f"length({t}) >= 100 AND {h.matches(t, lx.SUMMARY_VERB_PATTERN)}"),
        "process": _worded("hostw", lx.PROCESS_PATTERN),
        "blocks": "size(json_ld)", "bad_blocks": f"size({keep('json_ld', lambda b: f'NOT {b}.valid')})",
        "type_bits": _mask("schema_types", SCHEMA_BITS),
        "has_org": f"{org_block} IS NOT NULL", "org_complete": let(org_block, completeness),
        "same_as": f"exists(json_ld, {fn(lambda b: f'array_contains({b}.properties, {q('sameAs')}) OR {b}.values[{q('sameAs')}] IS NOT NULL')})",
        "ld_author": f"exists(json_ld, {fn(lambda b: f'{b}.values[{q('author')}] IS NOT NULL')})",
        "ld_name": f"size({names}) > 0", "ld_name_fits": _any_token("long_tokens", f"lower({first(names)})"),
        "has_email": "size(emails) > 0", "has_phone": "size(phones) > 0",
        "named_author": f"exists(authors, {fn(lambda a: f'length({a}) > 2')})",
        "byline": "size(authors) > 0 OR has_byline_text", "citations": "outbound_citation_links",
        "credentials": _worded("abcdjlmqry", lx.CREDENTIAL_PATTERN), "sources": _worded("abdps", lx.SOURCE_PATTERN),
        "proof": _worded("crstw", lx.PROOF_PATTERN, (
            f"CASE WHEN contains({text}, '★') THEN {h.matches(text, lx.PROOF_PATTERN)}"
            f" ELSE {h.matches_word(text, 'crstw', lx.PROOF_PATTERN.replace('|★', ''))} END")),
        "privacy": f"{h.matches('concat(url, chr(32), coalesce(title, chr(32)))', '(?i)privacy')} OR exists(links, {fn(lambda n: h.matches(f'{n}.href', '(?i)privacy'))})",
        "terms_link": f"exists(links, {fn(lambda n: h.matches(f'{n}.href', '(?i)terms|conditions'))})",
        "licence": _worded("elr", lx.LICENCE_PATTERN), "founded": _worded("efs", lx.FOUNDED_YEAR_PATTERN),
    }


@cache
def _site_sums() -> dict[str, str]:
    def count(c):
        return f"count_if({c})"

    def any_(c):
        return f"coalesce(bool_or({c}), false)"

    def home(c):
        return f"max(CASE WHEN is_seed THEN {c} END)"

    first_about = "CASE WHEN role = 'ABOUT' THEN page_id END"
    out = {
        "pages": "count(*)", "https": count("is_https"), "home_status": home("status_code"),
        "longest_chain": "max(redirect_hops)", "indexable": count("is_indexable"),
        "home_indexable": f"coalesce({home('is_indexable')}, false)",
        "canonicals": count("has_canonical"), "viewports": count("has_viewport"), "langs": count("has_lang"),
        "images": "sum(image_count)", "with_alt": "sum(with_alt)", "timed": "count(fetch_ms)", "ms": "sum(fetch_ms)",
        "no_tokens": any_("no_tokens"),
        "home_brand_title": f"coalesce({home('brand_title')}, false)", "home_brand_h1": f"coalesce({home('brand_h1')}, false)",
        "home_brand_text": f"coalesce({home('brand_text')}, false)", "home_brand_any": f"coalesce({home('brand_any')}, false)",
        "home_verb": f"coalesce({home('does_verb')}, false)", "home_chars": f"coalesce({home('does_chars')}, 0)",
        "audience": "bit_count(bit_or(audience))", "offers": count(f"role IN {listed(OFFERS)}"), "subheadings": "sum(subheadings)",
        "addresses": any_("has_address"), "us_state": any_("us_state"), "area_served": any_("area_served"),
        "about_words": f"min_by(word_count, {first_about})",
        "titles": count("has_title"), "brand_titles": count("has_title AND brand_title"), "sized_titles": count("sized_title"),
        "described": count("described"), "with_og": count("has_og"), "words": "sum(word_count)", "thin": count("word_count < 150"),
        "editorial": count(f"role IN {listed(EDITORIAL)}"), "facts": "sum(facts)",
        "vague": "bit_count(bit_or(vague))", "superlatives": "bit_count(bit_or(superlative))",
        "dated": count("dated"), "newest": "max(page_date)", "internal": "sum(internal_links)",
        "hierarchies": count("hierarchy"), "single_h1": count("one_h1"), "case_studies": count("role = 'CASE_STUDY'"),
        "testimonial": any_("testimonial"), "own_data": any_("own_data"), "project_counts": any_("project_counts"),
        "home_words": f"coalesce({home('word_count')}, 0)", "questions": "sum(questions)",
        "faq_pages": count("role = 'FAQ' OR faq"), "faq_content": any_("faq"), "quotable": count("quotable"),
        "lists": "sum(lists)", "tables": "sum(tables)",
        "definitions": "sum(definitions) + sum(definition_lists)",
        "compares": any_("compares"), "comparison_pages": count("comparison_page"), "front_loaded": count("front_loaded"),
        "home_summary": f"coalesce({home('summarised')}, false)", "process": any_("process"),
        "with_schema": count("blocks > 0"), "blocks": "sum(blocks)", "bad_blocks": "sum(bad_blocks)", "type_bits": "bit_or(type_bits)",
        "has_org": any_("has_org"), "org_complete": "min_by(org_complete, CASE WHEN has_org THEN page_id END)",
        "same_as": any_("same_as"), "ld_author": any_("ld_author"), "ld_named": any_("ld_name"),
        "ld_name_fits": "min_by(ld_name_fits, CASE WHEN ld_name THEN page_id END)",
        "email": any_("has_email"), "phone": any_("has_phone"), "contact_pages": count("role = 'CONTACT'"),
        "author_pages": count("role = 'AUTHOR'"), "named_author": any_("named_author"), "bylines": count("byline"),
        "citations": "sum(citations)", "credentials": any_("credentials"), "sources": any_("sources"), "proof": any_("proof"),
        "privacy": any_("privacy"), "terms_link": any_("terms_link"), "licence": any_("licence"), "founded": any_("founded"),
    }
    return out


def brand_tokens(extra: str = "") -> str:
    return f"filter(split(lower(business_name), r'\\s+'), t -> length(t) > 2{extra})"


def with_site(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """Signals with what the owner told about the site."""
    stop = f" AND t NOT IN {listed(lx.BRAND_STOP_WORDS)}"
    terms = (
        "filter(transform(split(lower(coalesce(primary_services, '')), '[,;]'), t -> trim(t)), t -> length(t) > 3)"
    )
    dim = sites.selectExpr(
        "site_key", "seed_page_id", f"{brand_tokens(stop)} AS tokens", f"{brand_tokens()} AS long_tokens", f"{terms} AS terms"
    )
    return lookup(signals, dim, ["site_key"], "page_id").withColumns(
        {"is_seed": F.col("page_id") == F.col("seed_page_id"), "lower_text": F.lower("main_text")}
    )


def _keyed_counts(pages: DataFrame) -> DataFrame:
    """Repetition of titles, descriptions and openings, and stated services found, per site."""
    opening = h.trim_ws("first_paragraph")
    excerpt = "main_text"
    terms = each("terms", lambda t: f"named_struct('kind', 'term', 'item', {t}, 'hit', contains(lower_text, {t}))")

    def one(kind, value, test):
        return f"CASE WHEN {test} THEN named_struct('kind', '{kind}', 'item', md5({value}), 'hit', true) END"

    items = (
        f"array_compact(concat(array({one('title', 'title', 'title IS NOT NULL')},"
        f" {one('description', 'meta_description', 'meta_description IS NOT NULL')},"
        f" {one('excerpt', excerpt, f'length({excerpt}) > 100')}, {one('opening', opening, f'length({opening}) > 60')}), {terms}))"
    )
    exploded = pages.selectExpr("site_key", f"inline({items})")
    counted = exploded.groupBy("site_key", "kind", "item").agg(F.count("*").alias("n"), F.max("hit").alias("hit"))
    return counted.groupBy("site_key").agg(
        F.expr("count_if(kind IN ('title', 'description') AND n > 1)").alias("repeats"),
        F.expr("count_if(kind = 'excerpt')").alias("excerpt_kinds"),
        F.expr("coalesce(sum(CASE WHEN kind = 'excerpt' THEN n END), 0)").alias("excerpts"),
        F.expr("count_if(kind = 'opening')").alias("opening_kinds"),
        F.expr("coalesce(sum(CASE WHEN kind = 'opening' THEN n END), 0)").alias("openings"),
        F.expr("count_if(kind = 'term')").alias("terms"),
        F.expr("count_if(kind = 'term' AND hit)").alias("terms_found"),
    )


def _sums(pages: DataFrame) -> DataFrame:
    facts = pages.selectExpr("site_key", "page_id", "is_seed", *[f"{t} AS {n}" for n, t in _page_facts().items()])
    return facts.groupBy("site_key").agg(*[F.expr(t).alias(n) for n, t in _site_sums().items()])


def _filled(out: DataFrame) -> DataFrame:
    numbers = [n for n, t in out.dtypes if t in ("bigint", "int", "double") and n not in ("about_words", "home_status")]
    flags = [n for n, t in out.dtypes if t == "boolean"]
    return out.fillna(0, numbers).fillna(False, flags)


def page_sums(signals: DataFrame, sites: DataFrame) -> DataFrame:
    """The part of ``site_facts`` that is summed over pages.  ``signals`` is read once, and only the columns that a caller's facts need."""
    return _filled(sites.select("site_key", "page_limit").join(_sums(with_site(signals, sites)), "site_key", "left"))


def site_facts(
    signals: DataFrame,
    sites: DataFrame,
    failures: DataFrame,
    broken: DataFrame,
    robots: DataFrame,
    files: DataFrame,
) -> DataFrame:
    """``failures`` and ``broken`` hold one row per page or link, the last two one row per site."""
    pages = with_site(signals, sites)
    out = (
        sites.select("site_key", "page_limit")
        .join(_sums(pages), "site_key", "left")
        .join(_keyed_counts(pages), "site_key", "left")
        .join(failures.groupBy("site_key").agg(F.count("*").alias("failures")), "site_key", "left")
        .join(broken.groupBy("site_key").agg(F.count("*").alias("broken")), "site_key", "left")
        .join(robots.selectExpr("site_key", "size(blocked_agents) AS blocked_agents", "blocks_everything", "rule_count", "sitemaps"), "site_key", "left")
        .join(files, "site_key", "left")
    )
    return _filled(out)


EXAMPLES = {  # check -> pages that speak against it, and how many to show
    "tech.redirect-chains": ("redirect_hops > 1", 3),
    "tech.indexability": ("NOT is_indexable", 5),
    "tech.canonical": ("canonical IS NULL", 5),
    "entity.title-quality": ("title IS NULL", 5),
    "entity.meta-description": ("meta_description IS NULL", 5),
    "content.thin-pages": ("word_count < 150", 5),
    "content.heading-structure": ("size(h1) <> 1 OR NOT heading_hierarchy_valid", 5),
    "schema.presence": ("size(json_ld) = 0", 5),
}


def check_examples(signals: DataFrame) -> DataFrame:
    """First pages of each site that speak against a check.

    Every task keeps the few best of each site and check before the shuffle."""
    hits = "array_compact(array(" + ", ".join(
        f"CASE WHEN {test} THEN named_struct('check_id', {q(c)}, 'most', {n}) END" for c, (test, n) in EXAMPLES.items()
    ) + "))"
    rows = signals.selectExpr("site_key", "page_id", "url", f"inline({hits})")
    w = Window.partitionBy("site_key", "check_id").orderBy("page_id")
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(n for _, n in EXAMPLES.values()))
    return ranked.where("rank <= most").select("site_key", "check_id", "rank", "page_id", "url")
