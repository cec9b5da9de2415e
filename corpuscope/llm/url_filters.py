"""URL filters: pattern rules indexed by their rarest literal token."""

import re

from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import ascii_lower

TOKEN = "[A-Za-z0-9]+"
#: Rules up to this number are sent to every executor; more are joined by a shuffle.
BROADCAST_RULES = 20_000


def quoted(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", literal)


def host_rule(rule: str) -> tuple[str, list[str]]:
    """Regular expression and sure tokens of ``host/path``: that host or a subdomain, and a path prefix."""
    host, slash, path = rule.partition("/")
    literal = host.lower() + slash + path
    return rf"^(?:[^/]*\.)?{quoted(literal)}", whole_tokens(literal, start=True)


def wildcard_rule(rule: str) -> tuple[str, list[str]]:
    """The same of a pattern over host and path in which ``*`` stands for any text."""
    parts = rule.split("*")
    tokens = [t for i, part in enumerate(parts) for t in whole_tokens(part, start=i == 0, end=i == len(parts) - 1)]
    return "(?s)^" + ".*".join(map(quoted, parts)) + "$", tokens


def whole_tokens(literal: str, start: bool = False, end: bool = False) -> list[str]:
    """Tokens of a literal that are whole tokens of every text that holds it."""
    return [
        m[0] for m in re.finditer(TOKEN, literal)
        if (start or m.start() > 0) and (end or m.end() < len(literal))
    ]


def split_url(url):
    """Host and path columns of a URL."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    safe = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(safe, parts, 1)), F.regexp_extract(safe, parts, 2)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], patterns: list[tuple[str, str]] = (),
                default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict on every row of ``pages`` by ``rules`` and, where none fits, by ``patterns``.

    ``rules`` and ``patterns`` hold (text, action) pairs: host rules (``host/path``, which fit the
    host, its subdomains and any path that starts so) and wildcard patterns.  Of the rules that fit,
    the longest decides, at equal length the greater text; then the longest pattern; then ``default``.

    A rule is filed under that token of its literal text which is rarest among the tokens of all
    given URLs.  URLs fetch candidates by their tokens, and only candidates run their expression.
    Rules without a sure token are filed under the empty token, which every URL has.  The work is
    done once for each distinct host and path.

    Null URLs and URLs without ``://`` have an empty host and path, and only ``default`` or a
    pattern without tokens can judge them.  Repeated rows are judged alike, an empty table gives no
    rows, and other columns of ``pages`` are not read.  Result: id, host, path, rule, verdict, pattern.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    targets = judged.select(target.alias("target")).distinct()
    tokens = targets.select("target", F.explode(F.array_distinct(F.concat(
        F.array(F.lit("")), F.regexp_extract_all("target", F.lit(f"({TOKEN})"), F.lit(1))))).alias("token"))

    compiled = [(1, r, a, *host_rule(r)) for r, a in rules] + [(0, p, a, *wildcard_rule(p)) for p, a in patterns]
    schema = "rank int, rule string, action string, regex string, tokens array<string>"
    listed = spark.createDataFrame([(*c[:4], sorted(set(c[4])) or [""]) for c in compiled], schema)
    small = F.broadcast if len(compiled) <= BROADCAST_RULES else lambda df: df
    sure = listed.select("rank", "rule", "action", "regex", F.explode("tokens").alias("token"))
    counts = tokens.join(small(sure.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    index = (
        sure.join(counts, "token", "left").groupBy("rank", "rule", "action", "regex")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select("rank", "rule", "action", "regex", F.col("rarest.token").alias("token"))
    )
    best = (
        tokens.join(small(index), "token").where("target rlike regex").groupBy("target")
        .agg(F.max(F.struct("rank", F.length("rule").alias("len"), "rule", "action")).alias("best"))
    )
    return judged.withColumn("target", target).join(best, "target", "left").select(
        id_col, "host", "path",
        F.when(F.col("best.rank") == 1, F.col("best.rule")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.when(F.col("best.rank") == 0, F.col("best.rule")).alias("pattern"),
    )
