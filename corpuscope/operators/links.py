"""Link graph and crawl selection over an already fetched corpus."""

from pyspark.sql import DataFrame, functions as F

from corpuscope.functions import html as h
from corpuscope.functions import lexicon as lx
from corpuscope.functions import urls as u
from corpuscope.functions.sqltext import each, keep, listed
from corpuscope.operators.joins import lookup
from corpuscope.sources.io import drop_stored, materialize

#: Code of a request that failed before there was a response.
FETCH_ERROR = """CASE WHEN error IN ('ETIMEDOUT', 'ESOCKETTIMEDOUT') THEN 'TIMEOUT' WHEN error IN ('ENOTFOUND', 'EAI_AGAIN') THEN 'DNS_FAILURE'
    WHEN error = 'RESPONSE_TOO_LARGE' THEN 'RESPONSE_TOO_LARGE' ELSE 'CONNECTION_FAILED' END"""


def page_links(signals: DataFrame) -> DataFrame:
    """One row per link of a page, in document order."""
    return signals.select("page_id", "site_key", "url", F.posexplode("links").alias("pos", "link")).select(
        "page_id", "site_key", "url", "pos", "link.href", "link.absolute", "link.text", "link.internal", "link.nofollow"
    )


def candidates_text(site_origin: str) -> str:
    """Crawlable targets of a page's links, first occurrence first (an array, so no shuffle)."""

    def crawlable(n):
        p = f"lower({u.path(f'{n}.absolute')})"
        return (
            f"{n}.internal AND {u.origin(f'{n}.absolute')} = {site_origin} AND {u.query(f'{n}.absolute')} = ''"
            f" AND NOT {h.matches(p, lx.SKIP_FILE_PATTERN)} AND NOT {h.matches(p, lx.SKIP_PATH_PATTERN)}"
            f" AND NOT contains({p}, '/page/') AND NOT startswith({p}, '/cdn-cgi/')"
        )

    def plain(n):
        trimmed = h.blank_to_null(h.replace(u.path(f"{n}.absolute"), "/+$"))
        return f"concat({u.origin(f'{n}.absolute')}, coalesce({trimmed}, '/'))"

    return f"array_distinct({each(keep('links', crawlable), plain)})"


def crawl_candidates(signals: DataFrame) -> DataFrame:
    listed_ = signals.selectExpr("page_id", "site_key", f"{candidates_text(u.origin('url'))} AS candidates")
    return listed_.select("page_id", "site_key", F.posexplode("candidates").alias("pos", "candidate"))


def with_priority(candidates: DataFrame) -> DataFrame:
    return candidates.selectExpr("*", f"{u.crawl_priority('candidate')} AS priority")


def unseen_targets(signals: DataFrame) -> DataFrame:
    """Internal link targets that are no page of the corpus, each once with the first link to it."""
    targets = (
        page_links(signals)
        .where(F.col("internal"))
        .selectExpr("site_key", "page_id", "pos", "url", "absolute", f"{u.key('absolute')} AS url_key")
        .where(f"NOT {h.matches('absolute', lx.LINK_PROBE_SKIP_PATTERN)}")
        .groupBy("site_key", "url_key")
        .agg(F.min(F.struct("page_id", "pos", "url", "absolute")).alias("seen"))
    )
    crawled = signals.selectExpr("site_key", f"{u.key('url')} AS url_key").distinct()
    return targets.join(crawled, ["site_key", "url_key"], "left_anti")


def link_ends(fetched: DataFrame, max_redirects: int = lx.MAX_REDIRECTS) -> DataFrame:
    """Where a request for each URL of a fetch log ends: (url_key, end_key, hops, status, code).

    ``fetched`` has one row per URL: url_key, status, location_key (target of a redirect, else null), error.  Chains are
    followed by pointer doubling, so a round doubles the hops that are known; a page that very many URLs
    redirect to is met through ``lookup``.  More than ``max_redirects`` hops, loops among them, are
    ``TOO_MANY_REDIRECTS`` without an end, and count one hop more than is allowed; a chain that leaves the log has neither status nor code."""
    fetched = materialize(fetched)  # read three times
    onward = "coalesce(status BETWEEN 300 AND 399 AND location_key IS NOT NULL, false)"
    moved = materialize(fetched.where(onward).select("url_key", F.col("location_key").alias("end_key"), F.lit(1).alias("hops")))
    for _ in range(max_redirects.bit_length()):
        step = moved.selectExpr("url_key AS end_key", "end_key AS _next", "hops AS _more")
        longer = materialize(lookup(moved, step, ["end_key"], "url_key").selectExpr(
            "url_key", "coalesce(_next, end_key) AS end_key", "hops + coalesce(_more, 0) AS hops"))
        drop_stored(moved)
        moved = longer
    here = fetched.where(f"NOT {onward}").select("url_key", F.col("url_key").alias("end_key"), F.lit(0).alias("hops"))
    last = fetched.selectExpr("url_key AS end_key", "status", "error", "true AS known")
    code = f"""CASE WHEN hops > {max_redirects} THEN 'TOO_MANY_REDIRECTS' WHEN known IS NULL THEN NULL
        WHEN error IS NOT NULL THEN {FETCH_ERROR} WHEN status >= 400 THEN 'HTTP_ERROR' ELSE 'OK' END"""
    return lookup(moved.unionByName(here), last, ["end_key"], "url_key").selectExpr(
        "url_key", f"CASE WHEN hops <= {max_redirects} THEN end_key END AS end_key", f"least(hops, {max_redirects + 1}) AS hops",
        f"CASE WHEN hops <= {max_redirects} THEN status END AS status", f"{code} AS code")


def broken_links(targets: DataFrame, ends: DataFrame) -> DataFrame:
    """Those of ``targets`` whose request ended (``link_ends``) in an error status or without a connection (status null).

    All targets are tested; one that was never fetched, timed out or has no end is unknown, not broken."""
    failed = ends.where("code IN ('HTTP_ERROR', 'CONNECTION_FAILED')").select("url_key", "status")
    return targets.join(failed, "url_key").select(
        "site_key", F.col("seen.url").alias("from_url"), F.col("seen.absolute").alias("to_url"), "status"
    )


def fetch_outcomes(hops: DataFrame, max_redirects: int = lx.MAX_REDIRECTS) -> DataFrame:
    """Fold the hop log of each request (a handful of rows) into its outcome."""
    redirect = (F.col("status").between(300, 399)) & F.col("location").isNotNull()
    folded = hops.groupBy("request_id").agg(
        F.first("site_key").alias("site_key"),
        F.count_if(redirect).alias("redirects"),
        (F.count("url") > F.count_distinct("url")).alias("looped"),
        F.max("hop").alias("last_hop"),
        F.max_by("url", "hop").alias("final_url"),
        F.max_by("status", "hop").alias("status"),
        F.max_by(redirect, "hop").alias("ends_in_redirect"),
        F.max_by("content_type", "hop").alias("content_type"),
        F.max_by("error", "hop").alias("error"),
    )
    base = "coalesce(lower(trim(split(content_type, ';')[0])), '')"
    code = f"""CASE WHEN looped THEN 'REDIRECT_LOOP'
        WHEN ends_in_redirect AND last_hop >= {max_redirects} THEN 'TOO_MANY_REDIRECTS'
        WHEN error IS NOT NULL THEN {FETCH_ERROR}
        WHEN {base} <> '' AND {base} NOT IN {listed(lx.TEXTUAL_CONTENT_TYPES)} THEN 'UNSUPPORTED_CONTENT_TYPE'
        WHEN status >= 400 THEN 'HTTP_ERROR' ELSE 'OK' END"""
    return folded.selectExpr(
        "request_id", "site_key", "CAST(redirects AS INT) AS redirect_hops", "final_url", "status", f"{code} AS code"
    )
