"""The check catalogue: what each check measures and what it is worth.

Order is the report order.  Fields: check id, category, points, effort, impact, title.
"""

_T, _E, _C, _A, _S, _V, _X = (
    "TECHNICAL_ACCESSIBILITY", "ENTITY_CLARITY", "CONTENT_AUTHORITY", "ANSWER_READINESS", "STRUCTURED_DATA",
    "TRUST_AND_EVIDENCE", "COMPETITIVE_VISIBILITY",
)
L, M, H = "LOW", "MEDIUM", "HIGH"

CATALOG = [
    ("tech.https", _T, 8, L, H, "Pages use HTTPS"),
    ("tech.homepage-status", _T, 8, M, H, "Home page answers with success"),
    ("tech.redirect-chains", _T, 4, L, L, "Redirects are short"),
    ("tech.indexability", _T, 9, L, H, "Pages may be indexed"),
    ("tech.robots-txt", _T, 6, L, M, "robots.txt lets crawlers in"),
    ("tech.ai-crawler-access", _T, 7, L, H, "AI crawlers are not shut out"),
    ("tech.sitemap", _T, 6, L, M, "A sitemap lists the pages"),
    ("tech.llms-txt", _T, 3, L, L, "llms.txt is published"),
    ("tech.canonical", _T, 5, L, M, "Pages name their canonical address"),
    ("tech.viewport", _T, 3, L, L, "Pages declare a viewport"),
    ("tech.lang", _T, 3, L, L, "Pages declare their language"),
    ("tech.broken-links", _T, 4, L, L, "Internal links work"),
    ("tech.image-alt", _T, 3, M, L, "Images carry alternative text"),
    ("tech.crawl-success", _T, 5, M, M, "Pages could be fetched"),
    ("tech.response-time", _T, 3, H, L, "Pages answer fast"),
    ("tech.discoverable-pages", _T, 4, M, M, "Several pages can be found"),
    ("entity.brand-name-prominence", _E, 7, L, H, "Home page shows the brand name"),
    ("entity.what-we-do", _E, 9, L, H, "Home page says what the business does"),
    ("entity.audience-definition", _E, 6, L, H, "The audience is named"),
    ("entity.service-specificity", _E, 8, H, H, "Offers have pages of their own"),
    ("entity.geographic-clarity", _E, 7, L, H, "Location and service area are clear"),
    ("entity.about-page", _E, 8, M, H, "There is a full about page"),
    ("entity.name-consistency", _E, 6, L, M, "Titles repeat the brand name"),
    ("entity.title-quality", _E, 5, L, M, "Titles have a useful length"),
    ("entity.meta-description", _E, 4, M, M, "Pages carry descriptions"),
    ("entity.duplicate-metadata", _E, 4, M, M, "Titles and descriptions are unique"),
    ("entity.open-graph", _E, 4, L, L, "Pages carry Open Graph data"),
    ("content.average-depth", _C, 9, H, H, "Pages go into depth"),
    ("content.thin-pages", _C, 6, M, M, "No page is nearly empty"),
    ("content.editorial-presence", _C, 8, H, H, "There is editorial content"),
    ("content.factual-specificity", _C, 7, M, H, "Copy gives figures"),
    ("content.vague-language", _C, 5, M, M, "Copy avoids filler"),
    ("content.unsupported-superlatives", _C, 4, L, M, "Copy avoids bare superlatives"),
    ("content.freshness", _C, 6, M, M, "Content is recent"),
    ("content.internal-linking", _C, 5, M, M, "Pages link to each other"),
    ("content.heading-structure", _C, 5, M, M, "Headings are in order"),
    ("content.first-party-evidence", _C, 7, H, H, "There is first-hand evidence"),
    ("content.duplication", _C, 4, H, M, "Page copy differs from page to page"),
    ("content.homepage-substance", _C, 5, M, H, "Home page has substance"),
    ("answer.question-headings", _A, 9, M, H, "Headings ask questions"),
    ("answer.faq-coverage", _A, 8, M, H, "Frequent questions are covered"),
    ("answer.passage-sizing", _A, 7, M, H, "Paragraphs have a quotable size"),
    ("answer.lists-and-tables", _A, 6, M, M, "Lists and tables structure the content"),
    ("answer.definitions", _A, 5, L, M, "Terms are defined"),
    ("answer.comparison-content", _A, 5, H, M, "Options are compared"),
    ("answer.front-loaded", _A, 6, M, H, "Pages open with the answer"),
    ("answer.terminology-consistency", _A, 4, L, M, "Stated services appear on the site"),
    ("answer.homepage-summary", _A, 5, L, H, "Home page opens with a summary"),
    ("answer.process-content", _A, 3, M, M, "The process is explained"),
    ("schema.presence", _S, 9, M, H, "Pages carry structured data"),
    ("schema.validity", _S, 8, L, H, "Structured data parses"),
    ("schema.organization-present", _S, 9, M, H, "The organisation is declared"),
    ("schema.organization-completeness", _S, 8, L, H, "The organisation block is complete"),
    ("schema.same-as", _S, 5, L, M, "Other profiles are linked"),
    ("schema.website", _S, 3, L, L, "The site is declared"),
    ("schema.breadcrumbs", _S, 3, L, L, "Breadcrumbs are declared"),
    ("schema.content-types", _S, 6, M, M, "Content types are declared"),
    ("schema.faq", _S, 5, L, M, "Questions are declared"),
    ("schema.author", _S, 4, M, M, "Authors are declared"),
    ("schema.reviews", _S, 3, M, L, "Reviews are declared"),
    ("schema.name-agreement", _S, 4, L, M, "Declared name matches the brand"),
    ("trust.contact-details", _V, 9, L, H, "Contact details are published"),
    ("trust.contact-page", _V, 5, L, M, "There is a contact page"),
    ("trust.author-attribution", _V, 8, M, H, "Content has named authors"),
    ("trust.author-expertise", _V, 7, M, H, "Expertise is stated"),
    ("trust.outbound-citations", _V, 6, M, M, "Outside sources are linked"),
    ("trust.source-transparency", _V, 4, L, M, "Sources are named in the text"),
    ("trust.customer-proof", _V, 6, H, M, "Customers speak for the business"),
    ("trust.legitimacy-markers", _V, 6, L, M, "Marks of a real business are present"),
    ("trust.attribution-clarity", _V, 5, L, H, "Content is clearly attributable"),
    ("trust.update-dates", _V, 4, L, M, "Pages are dated"),
    ("competitive.unavailable", _X, 0, L, L, "Competitors could not be read"),
    ("competitive.overall-signals", _X, 12, M, M, "Home page signals against competitors"),
    ("competitive.structured-data", _X, 6, M, M, "Structured data against competitors"),
    ("competitive.content-depth", _X, 6, M, M, "Depth against competitors"),
    ("competitive.answer-readiness", _X, 6, M, M, "Answers against competitors"),
]
BY_ID = {row[0]: (i, *row[1:]) for i, row in enumerate(CATALOG)}
