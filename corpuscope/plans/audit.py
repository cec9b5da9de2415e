"""The audit of a whole corpus, from pages to the fix list."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.operators import compare, ledger, links, recommend, robots, scoring
from corpuscope.operators.checks import categories
from corpuscope.operators.checks.framework import make_checks
from corpuscope.operators.checks.site_facts import page_sums, site_facts
from corpuscope.operators.signals import page_signals
from corpuscope.sources import bindings as b, io

FAMILIES = {
    "technical": categories.technical, "entity": categories.entity,
    "content": lambda: categories.content(b.AS_OF_PAGES), "answer": categories.answer,
    "structured_data": categories.structured_data, "trust": categories.trust,
}


#: Signals that no check reads: an audit of which only the checks are asked for does not parse them.
UNCHECKED = (
    "content_type", "robots_meta", "noindex_reason", "charset", "canonical_is_self", "list_item_count", "external_links", "external_domains",
    "twitter_card", "microdata_types", "faq_question_count", "has_contact_signals",
)


@dataclass
class Audit:
    """Inputs of an audit.  ``as_of`` stands for the clock."""

    signals: DataFrame
    sites: DataFrame
    failures: DataFrame
    files: DataFrame
    fetched: DataFrame | None = None  # fetch log of link targets; without one, the log that is derived from them
    competitors: DataFrame | None = None
    as_of: str = b.AS_OF_PAGES

    def facts(self) -> DataFrame:
        lines = robots.robots_lines(self.files)
        targets = io.materialize(links.unseen_targets(self.signals))  # read for the log and for the links themselves
        fetched = b.link_fetches(targets) if self.fetched is None else self.fetched
        return site_facts(
            self.signals, self.sites, self.failures, links.broken_links(targets, links.link_ends(fetched)),
            robots.ai_access(lines), robots.site_file_facts(self.files),
        )

    def family(self, name: str) -> DataFrame:
        checks = categories.content(self.as_of) if name == "content" else FAMILIES[name]()
        return make_checks(self.facts(), checks)

    def own_checks(self) -> DataFrame:
        listed = [c for name in FAMILIES for c in
                  (categories.content(self.as_of) if name == "content" else FAMILIES[name]())]
        return make_checks(self.facts(), listed)

    def seeds(self) -> DataFrame:
        """Home-page snapshot of every site."""
        home = self.sites.select(F.col("seed_page_id").alias("page_id"))
        return compare.snapshots(self.signals.join(home, "page_id", "left_semi"))

    def compared(self) -> DataFrame:
        return compare.compare(compare.snapshots(self.signals), self.seeds(), self.competitors)

    def competitive(self) -> DataFrame:
        facts = compare.competitor_facts(self.compared(), self.seeds())
        return make_checks(facts, compare.competitive_checks())

    def checks(self) -> DataFrame:
        own = self.own_checks()
        return own if self.competitors is None else own.unionByName(self.competitive())


def run(audit: Audit) -> dict[str, DataFrame]:
    """Result tables.  The check rows are few and feed every other table, so they are kept."""
    checks = io.materialize(audit.checks())
    weighted = scoring.rebalance(scoring.category_scores(checks))
    return {
        "site_checks": checks,
        "site_category_scores": scoring.category_summaries(weighted),
        "site_scores": scoring.with_band(scoring.overall(weighted)),
        "recommendations": recommend.recommendations(checks),
    }


def bound_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Sites with the page and competitor limits that their owner's plan and credits allow; without an owner, the free plan's.

    An audit reads this table many times, so it is stored.  Only owners are looked up among users and subscriptions, and of users
    only what decides: as distinct rows they need no join with the first order that stands beside them."""
    sites = io.materialize(b.bind(spark, sf, b.SITES_SQL))
    owners = sites.select(F.col("owner_id").alias("user_id")).distinct()
    users = b.bind(spark, sf, b.USERS_SQL).select("user_id", "one_time_credits").distinct().join(owners, "user_id", "left_semi")
    entitled = ledger.entitlements(users, b.bind(spark, sf, b.SUBSCRIPTIONS_SQL).join(owners, "user_id", "left_semi"))
    limits = ledger.audit_limits(entitled).selectExpr("user_id AS owner_id", "page_limit", "competitor_limit")
    _, _, _, pages, rivals = lx.PLANS[0]
    return io.materialize(sites.join(limits, "owner_id", "left").fillna({"page_limit": pages, "competitor_limit": rivals}))


def asked_competitors(spark: SparkSession, sf: str, sites: DataFrame) -> DataFrame:
    """What sites asked to be compared with, up to the limit of each."""
    asked = b.bind(spark, sf, b.COMPETITORS_SQL).join(sites.select("site_key", "competitor_limit"), "site_key")
    return compare.pick_competitors(asked, "competitor_limit")


def bound_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of the pages that an audit reads."""
    return page_signals(io.spread(io.textual_only(b.bind(spark, sf, b.SITE_PAGES_SQL)).where("status_code < 400")))


def bound_audit(spark: SparkSession, sf: str, without: tuple[str, ...] = ()) -> Audit:
    """An audit over the given tables, ``without`` signals that the caller does not read."""
    raw = b.bind(spark, sf, b.SITE_PAGES_SQL)
    sites = bound_sites(spark, sf)
    signals = io.materialize(bound_signals(spark, sf).drop(*without))  # read by every family: parse the markup once
    return Audit(
        signals=signals,
        sites=sites,
        failures=_failures(raw),
        files=b.bind(spark, sf, b.SITE_FILES_SQL),
        competitors=asked_competitors(spark, sf, sites),
    )


def structured_data(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of structured data alone: they read few signals, so only those are parsed, in one pass that stores nothing."""
    return make_checks(page_sums(bound_signals(spark, sf), bound_sites(spark, sf)), categories.structured_data())


def _failures(raw: DataFrame) -> DataFrame:
    text = io.is_textual()
    return raw.where((F.col("status_code") >= 400) | ~text).select(
        "site_key", "url", F.when(text, "HTTP_ERROR").otherwise("UNSUPPORTED_CONTENT_TYPE").alias("code")
    )
