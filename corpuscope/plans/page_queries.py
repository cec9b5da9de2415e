"""Registered queries over single pages: sources, URLs, signals."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.functions import urls as u
from corpuscope.operators import urlops
from corpuscope.operators.signals import page_signals
from corpuscope.operators import text_lexicon
from corpuscope.sources import bindings as b, io


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages an audit reads: bound, text only."""
    return io.spread(io.textual_only(b.bind(spark, sf, b.SITE_PAGES_SQL)))


def signals(spark, sf):
    return page_signals(io.spread(b.bind(spark, sf, b.SITE_PAGES_SQL)))


def joined(name, sort=False):
    c = F.col(name)
    return F.array_join(F.array_sort(c) if sort else c, " | ").alias(name)


def _map_text(name):
    pairs = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), " | ").alias(name)


def _headings_text():
    return F.array_join(
        F.transform("headings", lambda n: F.concat(n["level"].cast("string"), F.lit(":"), n["text"])), " | "
    ).alias("headings")


def select_signals(columns):
    """Query that keeps some signal columns; ``columns`` builds them once a session exists."""
    return lambda spark, sf: signals(spark, sf).select("page_id", *columns())


def jsonld_blocks(spark, sf):
    return signals(spark, sf).select("page_id", F.posexplode("json_ld").alias("pos", "block")).select(
        "page_id", F.col("pos"), F.col("block.valid").alias("valid"),
        F.array_join("block.types", " | ").alias("types"),
        F.array_join(F.array_sort("block.properties"), " | ").alias("properties"),
        F.array_join(F.array_sort(F.transform(
            F.map_entries("block.values"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " | ").alias("values"),
        F.col("block.excerpt").alias("excerpt"),
    )


def lexicon_of(frame, key):
    return lambda spark, sf: text_lexicon.phrase_report(frame(spark, sf), key)


QUERIES = {
    "s1_scan_pages": lambda spark, sf: io.textual_only(b.bind(spark, sf, b.SITE_PAGES_SQL)).select(
        "page_id", "url", "site_key", "content_type", F.length("html").alias("html_chars")),
    "s2_scan_events": lambda spark, sf: io.scan_events(spark, f"{sf}/events.parquet").select(
        "event_id", "user_id", "event_type", "value", "ts"),
    "u1_url_normalize": lambda spark, sf: b.bind(spark, sf, b.RAW_URLS_SQL).where(
        f"{u.rejection_code('raw')} IS NULL").selectExpr("url_id", f"{u.normalize('raw')} AS normalized"),
    "u2_url_validate": lambda spark, sf: b.bind(spark, sf, b.RAW_URLS_SQL).selectExpr(
        "url_id", "raw", f"coalesce({u.rejection_code('raw')}, 'OK') AS code"),
    "u3_ip_classify": lambda spark, sf: urlops.classify_addresses(b.bind(spark, sf, b.ADDRESSES_SQL), "address"),
    "u4_registrable_domain": lambda spark, sf: io.scan_pages(spark, f"{sf}/pages.parquet").selectExpr(
        "page_id", f"{u.registrable_domain(u.host('url'))} AS domain"),
    "u5_url_key": lambda spark, sf: io.scan_pages(spark, f"{sf}/pages.parquet").selectExpr(
        "page_id", f"{u.key('url')} AS url_key"),
    "u6_url_dedupe": lambda spark, sf: urlops.first_by_key(
        b.bind(spark, sf, b.SITE_PAGES_SQL).select("page_id", "site_key", "url")),
    "p1_page_meta": select_signals(lambda: ["title", "title_length", "meta_description", "meta_description_length",
                                   "canonical", "canonical_is_self", "lang_attr", "viewport", "charset"]),
    "p2_page_indexability": select_signals(lambda: ["robots_meta", "is_indexable", "noindex_reason"]),
    "p3_page_headings": select_signals(lambda: [_headings_text(), joined("h1"), joined("question_headings"),
                                       "heading_hierarchy_valid"]),
    "p4_page_paragraphs": select_signals(lambda: ["paragraph_count", "main_text", "first_paragraph"]),
    "p5_page_word_count": select_signals(lambda: ["word_count"]),
    "p6_page_structure_counts": select_signals(lambda: ["list_count", "list_item_count", "table_count", "definition_count"]),
    "p7_page_images": select_signals(lambda: ["image_count", "images_with_alt", "images_with_empty_alt"]),
    "p8_page_link_stats": select_signals(lambda: ["internal_links", "external_links",
                                         F.size("external_domains").alias("external_domain_count"),
                                         "outbound_citation_links"]),
    "p9_page_social_meta": select_signals(lambda: [_map_text("open_graph"), _map_text("twitter_card")]),
    "p10_page_jsonld": jsonld_blocks,
    "p11_page_microdata": select_signals(lambda: [joined("microdata_types", sort=True)]),
    "p12_page_faq": select_signals(lambda: ["has_faq_signals", "faq_question_count", joined("schema_types")]),
    "p13_page_dates": select_signals(lambda: ["published_date", "modified_date"]),
    "p14_page_authors": select_signals(lambda: [joined("authors", sort=True), "has_byline_text"]),
    "p15_page_contacts": select_signals(lambda: [joined("emails", sort=True), joined("phones", sort=True),
                                        joined("address_signals"), "has_contact_signals"]),
    "p16_page_lexicon": select_signals(lambda: [joined("vague_phrases"), joined("superlatives")]),
    "p16_document_lexicon": lexicon_of(lambda spark, sf: io.spread(b.table(spark, sf, "documents")), "doc_id"),
    "p17_page_fact_count": select_signals(lambda: ["factual_data_points"]),
    "p18_page_role": select_signals(lambda: ["url", "role"]),
    "p19_page_signals": lambda spark, sf: signals(spark, sf).select(
        "page_id", "site_key", "url", "status_code", "title", "word_count", "paragraph_count", "internal_links",
        "external_links", "is_indexable", "canonical_is_self", "has_faq_signals", "has_contact_signals", "role",
        joined("schema_types"), "factual_data_points", "image_count", "list_count", "published_date",
        F.md5("main_text").alias("text_md5")),
}
