"""The checks of the six categories that read a site by itself."""

from corpuscope.functions import lexicon as lx
from corpuscope.operators.checks.framework import Check, by_ratio, ladder, share, stairs, toward
from corpuscope.operators.checks.site_facts import bits, has_types


def of(*flags: str) -> str:
    """How many of the flags hold."""
    return "(" + " + ".join(f"IF({f}, 1, 0)" for f in flags) + ")"


def enough(score: str, good: int, some: int = 1) -> str:
    return f"CASE WHEN {score} >= {good} THEN 'PASS' WHEN {score} >= {some} THEN 'WARN' ELSE 'FAIL' END"


def passes(flag: str, otherwise: str = "FAIL") -> str:
    return f"CASE WHEN {flag} THEN 'PASS' ELSE '{otherwise}' END"


def unit(flag: str, otherwise: float = 0.0) -> str:
    return f"CASE WHEN {flag} THEN 1D ELSE {otherwise}D END"


def ratio_check(check_id, part, whole, pass_at, warn_at, evidence):
    r = share(part, whole)
    return Check(check_id, r, by_ratio(r, pass_at, warn_at), evidence)


def technical() -> list[Check]:
    https = share("https", "pages")
    index = share("indexable", "pages")
    alt = share("with_alt", "images")
    success = share("pages", "pages + failures")
    ms = "(ms / timed)"
    blocked, broken = "blocked_agents", "broken"
    return [
        Check("tech.https", https, f"CASE WHEN pages = 0 THEN 'FAIL' ELSE {by_ratio(https, 1, 0.5)} END", {"https": "https", "pages": "pages"}),
        Check("tech.homepage-status", unit("home_status BETWEEN 200 AND 299"), passes("home_status BETWEEN 200 AND 299"), {"status": "coalesce(home_status, 0)"}),
        Check("tech.redirect-chains", ladder("longest_chain", [(0, 1), (1, 0.8), (2, 0.5)], 0),
              ladder("longest_chain", [(1, "PASS"), (2, "WARN")], "FAIL"), {"hops": "longest_chain"}),
        Check("tech.indexability", f"CASE WHEN home_indexable THEN {index} ELSE 0D END",
              f"CASE WHEN NOT home_indexable THEN 'FAIL' ELSE {by_ratio(index, 0.95, 0.7)} END", {"indexable": "indexable"}),
        Check("tech.robots-txt", "CASE WHEN NOT robots_found THEN 0.35D WHEN blocks_everything THEN 0D ELSE 1D END",
              "CASE WHEN blocks_everything THEN 'FAIL' WHEN robots_found THEN 'PASS' ELSE 'WARN' END",
              {"rules": "rule_count", "sitemaps": "sitemaps"}, impact="CASE WHEN blocks_everything THEN 'HIGH' ELSE 'MEDIUM' END"),
        Check("tech.ai-crawler-access", ladder(blocked, [(0, 1), (2, 0.5)], 0), ladder(blocked, [(0, "PASS"), (2, "WARN")], "FAIL"), {"blocked": blocked}),
        Check("tech.sitemap", "CASE WHEN NOT sitemap_found THEN 0D WHEN sitemap_urls > 0 THEN 1D ELSE 0.6D END",
              "CASE WHEN NOT sitemap_found THEN 'FAIL' WHEN sitemap_urls > 0 THEN 'PASS' ELSE 'WARN' END", {"urls": "sitemap_urls"}),
        Check("tech.llms-txt", unit("llms_found"), passes("llms_found", "INFO"), {"bytes": "llms_bytes"}),
        ratio_check("tech.canonical", "canonicals", "pages", 0.9, 0.5, {"canonicals": "canonicals"}),
        ratio_check("tech.viewport", "viewports", "pages", 0.9, 0.5, {"viewports": "viewports"}),
        ratio_check("tech.lang", "langs", "pages", 0.9, 0.5, {"langs": "langs"}),
        Check("tech.broken-links", ladder(broken, [(0, 1), (2, 0.6), (5, 0.3)], 0), ladder(broken, [(0, "PASS"), (2, "WARN")], "FAIL"), {"broken": broken}),
        Check("tech.image-alt", f"CASE WHEN images = 0 THEN 1D ELSE {alt} END",
              f"CASE WHEN images = 0 THEN 'NOT_APPLICABLE' ELSE {by_ratio(alt, 0.9, 0.6)} END", {"images": "images", "with_alt": "with_alt"}),
        Check("tech.crawl-success", success, by_ratio(success, 0.9, 0.6), {"pages": "pages", "failures": "failures"}),
        Check("tech.response-time", f"CASE WHEN timed = 0 OR ms = 0 THEN 0D ELSE {ladder(ms, [(800, 1), (1800, 0.7), (3500, 0.4)], 0.1)} END",
              f"CASE WHEN timed = 0 THEN 'NOT_APPLICABLE' ELSE {ladder(ms, [(1800, 'PASS'), (3500, 'WARN')], 'FAIL')} END",
              {"timed": "timed"}),
        Check("tech.discoverable-pages", toward("pages", "least(page_limit, 6)"), enough("pages", 5, 2), {"pages": "pages"}),
    ]


def entity() -> list[Check]:
    name = of("home_brand_title", "home_brand_h1", "home_brand_text")
    does = "CASE WHEN home_verb AND home_chars >= 80 THEN 1D WHEN home_verb OR home_chars >= 80 THEN 0.5D ELSE 0D END"
    offer = f"greatest({toward('offers', '3')}, 0.7D * {toward('subheadings', '12')})"
    geo = of("addresses", "us_state", "area_served")
    return [
        Check("entity.brand-name-prominence", f"CASE WHEN no_tokens THEN 0D ELSE {name} / 3D END", enough(name, 2), {"signals": name}),
        Check("entity.what-we-do", does, f"CASE WHEN {does} >= 1 THEN 'PASS' WHEN {does} > 0 THEN 'WARN' ELSE 'FAIL' END", {"chars": "home_chars"}),
        Check("entity.audience-definition", stairs("audience", [(2, 1), (1, 0.6)], 0), enough("audience", 2), {"terms": "audience"}),
        Check("entity.service-specificity", offer, by_ratio(offer, 0.75, 0.35), {"offers": "offers", "subheadings": "subheadings"}),
        Check("entity.geographic-clarity", f"{geo} / 3D", enough(geo, 2), {"signals": geo}),
        Check("entity.about-page", f"CASE WHEN about_words IS NULL THEN 0D ELSE {stairs('about_words', [(400, 1), (200, 0.65)], 0.3)} END",
              "CASE WHEN about_words IS NULL THEN 'FAIL' WHEN about_words >= 400 THEN 'PASS' ELSE 'WARN' END", {"words": "coalesce(about_words, 0)"}),
        ratio_check("entity.name-consistency", "brand_titles", "titles", 0.7, 0.35, {"branded": "brand_titles", "titles": "titles"}),
        ratio_check("entity.title-quality", "sized_titles", "pages", 0.7, 0.4, {"sized": "sized_titles"}),
        ratio_check("entity.meta-description", "described", "pages", 0.8, 0.4, {"described": "described"}),
        Check("entity.duplicate-metadata", ladder("repeats", [(0, 1), (1, 0.6), (3, 0.3)], 0), ladder("repeats", [(0, "PASS"), (1, "WARN")], "FAIL"), {"repeats": "repeats"}),
        ratio_check("entity.open-graph", "with_og", "pages", 0.7, 0.3, {"with_og": "with_og"}),
    ]


def content(as_of: str) -> list[Check]:
    avg = share("words", "pages")
    facts = toward("facts", "greatest(6, 2 * pages)")
    months = f"((unix_micros(TIMESTAMP '{as_of}') - unix_micros(newest)) / (1000000D * 60 * 60 * 24 * 30))"
    linked = share("internal", "pages")
    headings = f"0.5D * {share('hierarchies', 'pages')} + 0.5D * {share('single_h1', 'pages')}"
    own = of("case_studies > 0", "testimonial", "own_data", "project_counts")
    unlike = (
        "least(CASE WHEN excerpts > 0 THEN excerpt_kinds / CAST(excerpts AS DOUBLE) ELSE 1D END,"
        " CASE WHEN openings > 0 THEN opening_kinds / CAST(openings AS DOUBLE) ELSE 1D END)"
    )
    full = share("pages - thin", "pages")
    return [
        Check("content.average-depth", stairs(avg, [(800, 1), (500, 0.8), (300, 0.55), (150, 0.3)], 0.1),
              stairs(avg, [(500, "PASS"), (250, "WARN")], "FAIL"), {"words": "words", "pages": "pages"}),
        Check("content.thin-pages", full, f"CASE WHEN thin = 0 THEN 'PASS' WHEN {full} >= 0.75D THEN 'WARN' ELSE 'FAIL' END", {"thin": "thin"}),
        Check("content.editorial-presence", toward("editorial", "3"), enough("editorial", 3), {"editorial": "editorial"}),
        Check("content.factual-specificity", facts, by_ratio(facts, 0.7, 0.3), {"facts": "facts"}),
        Check("content.vague-language", ladder("vague", [(0, 1), (2, 0.65), (4, 0.35)], 0), ladder("vague", [(0, "PASS"), (2, "WARN")], "FAIL"), {"phrases": "vague"}),
        Check("content.unsupported-superlatives", ladder("superlatives", [(0, 1), (2, 0.6)], 0.2),
              ladder("superlatives", [(0, "PASS"), (2, "WARN")], "FAIL"), {"phrases": "superlatives"}),
        Check("content.freshness", f"CASE WHEN newest IS NULL THEN 0D ELSE {ladder(months, [(6, 1), (12, 0.7), (24, 0.4)], 0.15)} END",
              f"CASE WHEN newest IS NULL THEN 'FAIL' ELSE {ladder(months, [(12, 'PASS'), (24, 'WARN')], 'FAIL')} END",
              {"dated": "dated", "newest": "coalesce(date_format(newest, 'yyyy-MM-dd'), '')"}),
        Check("content.internal-linking", stairs(linked, [(15, 1), (8, 0.75), (4, 0.45)], 0.15), stairs(linked, [(8, "PASS"), (4, "WARN")], "FAIL"), {"links": "internal"}),
        Check("content.heading-structure", headings, by_ratio(f"({headings})", 0.8, 0.5), {"valid": "hierarchies", "single": "single_h1"}),
        Check("content.first-party-evidence", f"{own} / 4D", enough(own, 3), {"signals": own}),
        Check("content.duplication", unlike,
              f"CASE WHEN greatest(excerpts, openings) < 2 THEN 'NOT_APPLICABLE' ELSE {by_ratio(unlike, 0.95, 0.75)} END",
              {"excerpts": "excerpt_kinds", "openings": "opening_kinds"}),
        Check("content.homepage-substance", stairs("home_words", [(600, 1), (350, 0.75), (150, 0.4)], 0.1),
              stairs("home_words", [(350, "PASS"), (150, "WARN")], "FAIL"), {"words": "home_words"}),
    ]


def answer() -> list[Check]:
    questions = toward("questions", "greatest(5, 2 * pages)")
    schema = has_types("FAQPage")
    faq = f"(CASE WHEN faq_pages > 0 THEN 0.6D ELSE 0D END + CASE WHEN {schema} THEN 0.4D ELSE 0D END)"
    structure = f"least(1D, 0.7D * {toward('lists', 'greatest(4, pages)')} + 0.3D * {toward('tables', '2')})"
    defined = toward("definitions", "greatest(3, pages)")
    terms = "(CASE WHEN terms = 0 THEN 0.6D ELSE CAST(terms_found AS DOUBLE) / terms END)"
    steps = f"(process OR {has_types('HowTo')})"
    return [
        Check("answer.question-headings", questions, by_ratio(questions, 0.7, 0.3), {"questions": "questions"}),
        Check("answer.faq-coverage", faq, f"CASE WHEN {faq} >= 0.9D THEN 'PASS' WHEN {faq} > 0 THEN 'WARN' ELSE 'FAIL' END", {"pages": "faq_pages"}),
        ratio_check("answer.passage-sizing", "quotable", "pages", 0.7, 0.35, {"pages": "quotable"}),
        Check("answer.lists-and-tables", structure, by_ratio(structure, 0.7, 0.3), {"lists": "lists", "tables": "tables"}),
        Check("answer.definitions", defined, by_ratio(defined, 0.7, 0.3), {"definitions": "definitions"}),
        Check("answer.comparison-content", "CASE WHEN comparison_pages > 0 THEN 1D WHEN compares THEN 0.5D ELSE 0D END",
              "CASE WHEN comparison_pages > 0 THEN 'PASS' WHEN compares THEN 'WARN' ELSE 'FAIL' END", {"pages": "comparison_pages"}),
        ratio_check("answer.front-loaded", "front_loaded", "pages", 0.7, 0.35, {"pages": "front_loaded"}),
        Check("answer.terminology-consistency", terms, f"CASE WHEN terms = 0 THEN 'INFO' ELSE {by_ratio(terms, 0.8, 0.4)} END", {"found": "terms_found", "terms": "terms"}),
        Check("answer.homepage-summary", unit("home_summary"), passes("home_summary"), {"summary": "home_summary"}),
        Check("answer.process-content", unit(steps, 0.2), passes(steps, "WARN"), {"process": "process"}),
    ]


def structured_data() -> list[Check]:
    valid = "(CASE WHEN blocks = 0 THEN 0D ELSE 1D - bad_blocks / CAST(blocks AS DOUBLE) END)"
    complete = "coalesce(org_complete, 0D)"
    site, crumbs, faq = has_types("WebSite"), has_types("BreadcrumbList"), has_types("FAQPage")
    kinds = f"bit_count(coalesce(type_bits, 0L) & {bits(lx.CONTENT_TYPES)}L)"
    author = f"({has_types('Person')} OR ld_author)"
    review = has_types("Review", "AggregateRating")
    fits = "coalesce(ld_name_fits, false)"
    return [
        ratio_check("schema.presence", "with_schema", "pages", 0.8, 0.3, {"pages": "with_schema"}),
        Check("schema.validity", valid, "CASE WHEN blocks = 0 THEN 'NOT_APPLICABLE' WHEN bad_blocks = 0 THEN 'PASS' ELSE 'FAIL' END",
              {"blocks": "blocks", "invalid": "bad_blocks"}),
        Check("schema.organization-present", unit("has_org"), passes("has_org"), {"found": "has_org"}),
        Check("schema.organization-completeness", complete, f"CASE WHEN NOT has_org THEN 'NOT_APPLICABLE' ELSE {by_ratio(complete, 0.75, 0.4)} END", {"found": "has_org"}),
        Check("schema.same-as", unit("same_as"), passes("same_as"), {"found": "same_as"}),
        Check("schema.website", unit(site), passes(site, "WARN"), {"found": site}),
        Check("schema.breadcrumbs", unit(crumbs), passes(crumbs, "WARN"), {"found": crumbs}),
        Check("schema.content-types", toward(kinds, "2"), enough(kinds, 2), {"types": kinds}),
        Check("schema.faq", unit(faq), f"CASE WHEN {faq} THEN 'PASS' WHEN faq_content THEN 'FAIL' ELSE 'WARN' END", {"content": "faq_content"}),
        Check("schema.author", unit(author), passes(author, "WARN"), {"found": author}),
        Check("schema.reviews", unit(review), passes(review, "INFO"), {"found": review}),
        Check("schema.name-agreement", unit(fits), f"CASE WHEN NOT ld_named THEN 'NOT_APPLICABLE' ELSE {passes(fits)} END", {"fits": fits}),
    ]


def trust() -> list[Check]:
    contact = of("email", "phone", "addresses")
    author = "CASE WHEN editorial = 0 THEN CASE WHEN named_author THEN 1D ELSE 0.3D END ELSE least(1D, CAST(bylines AS DOUBLE) / editorial) END"
    expert = of("author_pages > 0", "credentials", "named_author")
    cited = toward("citations", "greatest(3, pages)")
    proof = of("proof", "case_studies > 0", has_types("Review", "AggregateRating"))
    legit = of("privacy", "terms_link", "licence", "founded")
    clear = of("home_brand_any", has_types(*lx.CORE_ORG_TYPES), "email")
    return [
        Check("trust.contact-details", f"{contact} / 3D", enough(contact, 2), {"signals": contact}),
        Check("trust.contact-page", unit("contact_pages > 0"), passes("contact_pages > 0"), {"pages": "contact_pages"}),
        Check("trust.author-attribution", author, f"CASE WHEN NOT named_author THEN 'FAIL' ELSE {by_ratio(f'({author})', 0.7, 0.3)} END",
              {"bylines": "bylines", "editorial": "editorial"}),
        Check("trust.author-expertise", f"{expert} / 3D", enough(expert, 2), {"signals": expert}),
        Check("trust.outbound-citations", cited, by_ratio(cited, 0.7, 0.25), {"links": "citations"}),
        Check("trust.source-transparency", unit("sources"), passes("sources", "WARN"), {"found": "sources"}),
        Check("trust.customer-proof", f"{proof} / 3D", enough(proof, 2), {"signals": proof}),
        Check("trust.legitimacy-markers", f"{legit} / 4D", enough(legit, 3), {"signals": legit}),
        Check("trust.attribution-clarity", f"{clear} / 3D", enough(clear, 2), {"signals": clear}),
        ratio_check("trust.update-dates", "dated", "pages", 0.6, 0.25, {"dated": "dated"}),
    ]
