"""URL operators over tables."""

from pyspark.sql import DataFrame, functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.functions import urls as u


def cidr_table(df: DataFrame) -> DataFrame:
    """The reserved ranges as a table; fixed at a few rows, so it may be broadcast."""
    rows = [(i, *u.cidr_bounds(c), code) for i, (c, code) in enumerate(lx.BLOCKED_V4_CIDRS)]
    return df.sparkSession.createDataFrame(rows, "ord int, lo bigint, hi bigint, code string")


def classify_addresses(addresses: DataFrame, column: str) -> DataFrame:
    """Version and rejection code (null = public) of address literals.

    The reserved ranges do not overlap apart from the last one, so each address meets one row of
    the broadcast range table, the first in order.
    """
    ip = F.col(column)
    numbered = addresses.selectExpr("*", f"{u.ip_version(column)} AS version", f"{u.ipv4_number(column)} AS number")
    ranges = cidr_table(addresses).where(F.col("code").isNotNull())
    first = F.broadcast(ranges.where(F.col("ord") < len(lx.BLOCKED_V4_CIDRS) - 1))
    ranged = numbered.join(first, F.col("number").between(F.col("lo"), F.col("hi")), "left")
    return ranged.select(
        *addresses.columns,
        "version",
        F.when(ip.isin(*lx.METADATA_ADDRESSES_V4), F.lit("METADATA_ENDPOINT"))
        .when(F.col("version") == 4, F.col("code"))
        .when(F.col("version") == 6, F.expr(u.classify_v6(column))).alias("code"),
    )


def first_by_key(pages: DataFrame) -> DataFrame:
    """One page per site and URL key, the first in page order.

    An aggregate with a map-side step rather than a window, so a URL that was fetched very often
    does not gather in one task.
    """
    keyed = pages.selectExpr("*", f"{u.key('url')} AS url_key")
    return keyed.groupBy("site_key", "url_key").agg(
        F.min("page_id").alias("page_id"), F.min_by("url", "page_id").alias("url"), F.count("*").alias("copies")
    )
