"""robots.txt, sitemap.xml and llms.txt of many sites.

A robots file is bounded (half a megabyte), so work per site on its lines is bounded too.
"""

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope.functions import html as h
from corpuscope.functions import lexicon as lx
from corpuscope.functions.sqltext import strings
from corpuscope.operators.joins import lookup

AGENT = "site-audit"


def robots_lines(files: DataFrame) -> DataFrame:
    """Directives in long form; consecutive user-agent lines share a group, group 0 has no agent."""
    body = files.where((F.col("path") == "/robots.txt") & (F.col("status_code") < 400))
    lines = body.select("site_key", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    cleaned = lines.selectExpr("site_key", "pos", f"{h.trim_ws('substring_index(line, chr(35), 1)')} AS line").where(
        F.contains("line", F.lit(":"))
    )
    fields = cleaned.selectExpr(
        "site_key", "pos",
        f"lower({h.trim_ws('substring_index(line, chr(58), 1)')}) AS field",
        f"{h.trim_ws('substr(line, instr(line, chr(58)) + 1)')} AS value",
    )
    by_line = Window.partitionBy("site_key").orderBy("pos")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(by_line), F.lit("")) != "user-agent")
    return fields.withColumn("starts", starts.cast("int")).select(
        "site_key", "pos", "field",
        F.when(F.col("field") == "user-agent", F.lower("value")).otherwise(F.col("value")).alias("value"),
        F.sum("starts").over(by_line).cast("int").alias("group_id"),
    )


def _groups(lines: DataFrame) -> DataFrame:
    agent, rule = F.col("field") == "user-agent", F.col("field").isin("allow", "disallow")
    entry = F.struct("pos", F.col("field").alias("type"), F.col("value").alias("path"))
    return lines.where(F.col("group_id") > 0).groupBy("site_key", "group_id").agg(
        F.collect_list(F.when(agent, F.col("value"))).alias("agents"),
        F.array_sort(F.collect_list(F.when(rule, entry))).alias("rules"),
        F.max_by(
            F.expr("try_cast(value AS DOUBLE)"),
            F.when((F.col("field") == "crawl-delay") & (F.expr("try_cast(value AS DOUBLE)") >= 0), F.col("pos")),
        ).alias("crawl_delay"),
    )


def select_group(lines: DataFrame, agent: str = AGENT) -> DataFrame:
    """Rules for an agent, one row per site: the groups that name it or a prefix of it, else '*'."""
    matched = _groups(lines).withColumn(
        "rank",
        F.when(F.exists("agents", lambda a: F.startswith(F.lit(agent), a)), 1)
        .when(F.array_contains("agents", "*"), 2),
    ).where(F.col("rank").isNotNull())
    best = matched.groupBy("site_key").agg(F.min("rank").alias("best"))
    chosen = matched.join(best, "site_key").where(F.col("rank") == F.col("best"))
    return chosen.groupBy("site_key").agg(
        F.min("rank").alias("match_rank"),
        F.array_sort(F.flatten(F.collect_list("rules"))).alias("rules"),
        F.max_by("crawl_delay", F.when(F.col("crawl_delay").isNotNull(), F.col("group_id"))).alias("crawl_delay"),
    )


def _rule_matches(rule: str, path: str) -> str:
    anchored = f"endswith({rule}.path, '$')"
    body = f"regexp_replace({rule}.path, '[$]$', '')"
    escaped = h.replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    pattern = f"concat('^', replace({escaped}, '*', '.*'), CASE WHEN {anchored} THEN '$' ELSE '' END)"
    return (
        f"CASE WHEN {rule}.path = '' THEN false WHEN {rule}.path = '/' THEN true"
        f" WHEN contains({body}, '*') THEN rlike({path}, {pattern})"
        f" WHEN {anchored} THEN {path} = {body} ELSE startswith({path}, {body}) END"
    )


def path_allowed(path: str) -> str:
    """Longest matching rule decides, allow wins ties; no rules allow everything."""

    def longest(kind):
        hits = f"filter(rules, r -> r.type = '{kind}' AND {_rule_matches('r', path)})"
        return f"coalesce(array_max(transform({hits}, r -> length(r.path))), -1)"

    return f"coalesce({longest('disallow')} = -1 OR {longest('allow')} >= {longest('disallow')}, true)"


def check_paths(pages: DataFrame, lines: DataFrame, agent: str = AGENT) -> DataFrame:
    """``pages(site_key, page_id, path)`` with whether its site's rules let the agent in."""
    rules = select_group(lines, agent).select("site_key", "rules")
    return lookup(pages, rules, ["site_key"], "page_id").selectExpr(*pages.columns, f"{path_allowed('path')} AS allowed")


def ai_access(lines: DataFrame, agent: str = AGENT) -> DataFrame:
    """Known AI agents a site names and shuts out, and whether it shuts out ``agent``."""
    groups = _groups(lines).withColumn("shut", F.exists("rules", lambda r: (r["type"] == "disallow") & (r["path"] == "/")))
    named = groups.select("site_key", "group_id", "shut", F.explode("agents").alias("named"))
    pairs = named.select("*", F.explode(F.expr(strings(lx.AI_AGENTS))).alias("ai")).where(
        F.startswith("ai", "named")
    )
    blocked = (
        pairs.groupBy("site_key", "ai")
        .agg(F.max(F.col("named") == F.col("ai")).alias("explicit"), F.max("shut").alias("shut"))
        .where("explicit AND shut")
        .groupBy("site_key")
        .agg(F.array_sort(F.collect_list("ai")).alias("blocked_agents"))
    )
    own = select_group(lines, agent).select(
        "site_key",
        F.exists("rules", lambda r: (r["type"] == "disallow") & (r["path"] == "/")).alias("blocks_everything"),
        F.size("rules").alias("rule_count"),
    )
    sites = lines.groupBy("site_key").agg(
        F.count_if((F.col("field") == "sitemap") & (F.col("value") != "")).alias("sitemaps"),
        F.coalesce(F.max(
            (F.col("field") == "user-agent") & (F.col("value") != "*") & F.startswith(F.lit(agent), F.col("value"))
        ), F.lit(False)).alias("agent_specific"),
    )
    return sites.join(own, "site_key", "left").join(blocked, "site_key", "left").select(
        "site_key",
        F.coalesce("blocked_agents", F.array().cast("array<string>")).alias("blocked_agents"),
        F.coalesce("blocks_everything", F.lit(False)).alias("blocks_everything"),
        F.coalesce("rule_count", F.lit(0)).alias("rule_count"),
        "sitemaps", "agent_specific",
    )


def site_file_facts(files: DataFrame) -> DataFrame:
    """What the sitemap and llms.txt of each site hold; one row per site."""
    ok = F.col("status_code") < 400
    sitemap, llms = (F.col("path") == "/sitemap.xml") & ok, (F.col("path") == "/llms.txt") & ok
    markup = F.expr(h.matches("body", "(?i)<html"))
    text = llms & ~markup
    return files.groupBy("site_key").agg(
        F.max((F.col("path") == "/robots.txt") & ok).alias("robots_found"),
        F.max(sitemap).alias("sitemap_found"),
        F.max(F.when(sitemap, F.expr(h.count_matches("body", "(?i)<loc>"))).otherwise(0)).alias("sitemap_urls"),
        F.max(sitemap & F.expr(h.matches("body", "(?i)<sitemapindex"))).alias("sitemap_is_index"),
        F.max(text).alias("llms_found"),
        F.max(F.when(text, F.octet_length("body")).otherwise(0)).alias("llms_bytes"),
        F.max(text & F.expr(h.matches("body", r"(?m)^#{1,3}\s+"))).alias("llms_sections"),
    )
