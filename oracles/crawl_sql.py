"""Checks for the link, fetch and robots queries."""

from corpuscope.functions import lexicon as lx
from corpuscope.sources import bindings as b
from oracles import fragments as f
from oracles.fragments import members, q, strings
from oracles.signals import SIGNALS

LINKS = "links1 AS (SELECT page_id, site_key, url, unnest(links) AS n, generate_subscripts(links, 1) - 1 AS pos FROM sig)"
_P = f"lower({f.path('n.absolute')})"
CANDIDATES = rf"""{LINKS},
cand0 AS (SELECT page_id, site_key, pos, {f.origin('n.absolute')} || coalesce(nullif(regexp_replace({f.path('n.absolute')}, '/+$', ''), ''), '/') AS candidate
  FROM links1 WHERE n.internal AND {f.origin('n.absolute')} = {f.origin('url')} AND {f.query('n.absolute')} = '' AND NOT regexp_matches({_P}, {q(lx.SKIP_FILE_PATTERN)})
  AND NOT regexp_matches({_P}, {q(lx.SKIP_PATH_PATTERN)}) AND {_P} NOT LIKE '%/page/%' AND {_P} NOT LIKE '/cdn-cgi/%'),
cands AS (SELECT page_id, site_key, candidate, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS pos FROM cand0 GROUP BY page_id, site_key, candidate)"""

BROKEN = rf"""{LINKS},
tgt AS (SELECT site_key, {f.url_key('n.absolute')} AS url_key, min({{'page_id': page_id, 'pos': pos, 'url': url, 'absolute': n.absolute}}) AS seen FROM links1
  WHERE n.internal AND NOT regexp_matches(n.absolute, {q(lx.LINK_PROBE_SKIP_PATTERN)}) GROUP BY ALL),
unseen AS (SELECT * FROM tgt WHERE NOT EXISTS (SELECT 1 FROM sig s WHERE s.site_key = tgt.site_key AND {f.url_key('s.url')} = tgt.url_key)),
fet AS ({b.LINK_FETCHES_SQL.format(targets='unseen')}),
ends AS (WITH RECURSIVE walk AS (SELECT url_key, url_key AS place, 0 AS hops FROM fet
    UNION ALL SELECT w.url_key, x.location_key, w.hops + 1 FROM walk AS w JOIN fet AS x ON x.url_key = w.place WHERE x.status BETWEEN 300 AND 399 AND x.location_key IS NOT NULL AND w.hops < 6)
  SELECT w.url_key, CASE WHEN w.hops < 6 THEN w.place END AS end_key, w.hops, CASE WHEN w.hops < 6 THEN x.status END AS status, CASE WHEN w.hops = 6 THEN 'TOO_MANY_REDIRECTS' WHEN x.error LIKE '%TIMEDOUT' THEN 'TIMEOUT'
      WHEN x.error IS NOT NULL THEN 'CONNECTION_FAILED' WHEN x.status >= 400 THEN 'HTTP_ERROR' WHEN x.url_key IS NOT NULL THEN 'OK' END AS code
    FROM (SELECT url_key, max(hops) AS hops, max_by(place, hops) AS place FROM walk GROUP BY 1) AS w LEFT JOIN fet AS x ON x.url_key = w.place),
brk AS (SELECT site_key, seen.url AS from_url, seen.absolute AS to_url, e.status FROM unseen JOIN ends AS e USING (url_key) WHERE code IN ('HTTP_ERROR', 'CONNECTION_FAILED'))"""

AGENT = "site-audit"
ROBOTS = rf"""files AS ({b.SITE_FILES_SQL}),
r0 AS (SELECT site_key, unnest(string_split_regex(body, '\r?\n')) AS line, generate_subscripts(string_split_regex(body, '\r?\n'), 1) - 1 AS pos FROM files WHERE path = '/robots.txt' AND status_code < 400),
r1 AS (SELECT site_key, pos, trim(string_split(line, '#')[1]) AS line FROM r0),
r2 AS (SELECT site_key, pos, lower(trim(string_split(line, ':')[1])) AS field, trim(line[instr(line, ':') + 1:]) AS value FROM r1 WHERE contains(line, ':')),
r3 AS (SELECT *, field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY site_key ORDER BY pos), '') <> 'user-agent' AS starts FROM r2),
robots AS (SELECT site_key, pos, field, CASE WHEN field = 'user-agent' THEN lower(value) ELSE value END AS value,
  CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY site_key ORDER BY pos) AS INT) AS group_id FROM r3),
ranked AS (SELECT DISTINCT site_key, group_id, CASE WHEN starts_with('{AGENT}', value) THEN 1 WHEN value = '*' THEN 2 END AS rank FROM robots WHERE field = 'user-agent'),
chosen AS (SELECT site_key, group_id, min(rank) AS rank FROM ranked WHERE rank IS NOT NULL GROUP BY site_key, group_id
  QUALIFY min(rank) = min(min(rank)) OVER (PARTITION BY site_key)),
own AS (SELECT c.site_key, min(c.rank) AS match_rank, coalesce(list({{'pos': pos, 'type': field, 'path': value}} ORDER BY pos) FILTER (WHERE field IN ('allow', 'disallow')), []) AS rules,
  arg_max(TRY_CAST(value AS DOUBLE), pos) FILTER (WHERE field = 'crawl-delay' AND TRY_CAST(value AS DOUBLE) >= 0) AS crawl_delay
  FROM chosen c JOIN robots r ON r.site_key = c.site_key AND r.group_id = c.group_id GROUP BY 1),
shut AS (SELECT site_key, group_id FROM robots WHERE group_id > 0 AND field = 'disallow' AND value = '/' GROUP BY ALL),
ais AS (SELECT unnest({strings(lx.AI_AGENTS)}) AS ai),
aib AS (SELECT r.site_key, ai, bool_or(r.value = ai) AS explicit, bool_or(s.group_id IS NOT NULL) AS is_shut FROM robots r JOIN ais ON r.field = 'user-agent' AND starts_with(ai, r.value)
  LEFT JOIN shut s ON s.site_key = r.site_key AND s.group_id = r.group_id GROUP BY ALL),
ai AS (SELECT r.site_key, coalesce((SELECT list(ai ORDER BY ai) FROM aib WHERE aib.site_key = r.site_key AND explicit AND is_shut), []) AS blocked_agents,
  coalesce((SELECT len(list_filter(rules, lambda x: x.type = 'disallow' AND x.path = '/')) > 0 FROM own WHERE own.site_key = r.site_key), false) AS blocks_everything,
  coalesce((SELECT len(rules) FROM own WHERE own.site_key = r.site_key), 0) AS rule_count,
  count(*) FILTER (WHERE field = 'sitemap' AND value <> '') AS sitemaps,
  coalesce(bool_or(field = 'user-agent' AND value <> '*' AND starts_with('{AGENT}', value)), false) AS agent_specific FROM robots r GROUP BY r.site_key),
sfacts AS (SELECT site_key, bool_or(path = '/robots.txt' AND status_code < 400) AS robots_found, bool_or(path = '/sitemap.xml' AND status_code < 400) AS sitemap_found,
  max(CASE WHEN path = '/sitemap.xml' AND status_code < 400 THEN len(regexp_extract_all(lower(body), '<loc>')) ELSE 0 END) AS sitemap_urls,
  bool_or(path = '/sitemap.xml' AND status_code < 400 AND body ILIKE '%<sitemapindex%') AS sitemap_is_index,
  bool_or(path = '/llms.txt' AND status_code < 400 AND body NOT ILIKE '%<html%') AS llms_found,
  max(CASE WHEN path = '/llms.txt' AND status_code < 400 AND body NOT ILIKE '%<html%' THEN strlen(body) ELSE 0 END) AS llms_bytes,
  bool_or(path = '/llms.txt' AND status_code < 400 AND body NOT ILIKE '%<html%' AND regexp_matches(body, '(?m)^#{{1,3}}\s+')) AS llms_sections FROM files GROUP BY 1)"""

_ESC = r"replace(regexp_replace(regexp_replace(x.path, '[$]$', ''), '([.+?^${}()|\[\]\\])', '\\\1', 'g'), '*', '.*')"
_HIT = (
    "CASE WHEN x.path = '' THEN false WHEN x.path = '/' THEN true WHEN contains(x.path, '*') OR x.path LIKE '%$' THEN"
    f" regexp_matches(path, '^(?:' || {_ESC} || ')' || CASE WHEN x.path LIKE '%$' THEN '$' ELSE '' END) ELSE starts_with(path, x.path) END"
)


def _longest(kind):
    return f"coalesce(list_max(list_transform(list_filter(rules, lambda x: x.type = '{kind}' AND {_HIT}), lambda x: length(x.path))), -1)"


SQL = {
    "k1_page_links": f"WITH {SIGNALS}, {LINKS} SELECT page_id, site_key, url, pos, n.href AS href, n.absolute AS absolute, n.text AS text, n.internal AS internal, n.nofollow AS nofollow FROM links1",
    "k2_crawl_candidates": f"WITH {SIGNALS}, {CANDIDATES} SELECT page_id, site_key, pos, candidate FROM cands",
    "k3_crawl_priority": f"WITH {SIGNALS}, {CANDIDATES} SELECT page_id, candidate, {f.priority('candidate')} AS priority FROM cands",
    "k5_broken_links": f"WITH {SIGNALS}, {BROKEN} SELECT * FROM brk",
    "k5_link_ends": f"WITH {SIGNALS}, {BROKEN} SELECT url_key, end_key, hops, status, code FROM ends",
    "k6_fetch_outcomes": f"""WITH lg AS ({b.FETCH_LOG_SQL}), lst AS (SELECT * FROM lg QUALIFY hop = max(hop) OVER (PARTITION BY request_id)),
       agg AS (SELECT request_id, count(*) FILTER (WHERE status BETWEEN 300 AND 399 AND location IS NOT NULL) AS redirects, count(*) > count(DISTINCT url) AS looped FROM lg GROUP BY 1)
       SELECT l.request_id, l.site_key, CAST(redirects AS INT) AS redirect_hops, l.url AS final_url, l.status, CASE WHEN looped THEN 'REDIRECT_LOOP'
       WHEN status BETWEEN 300 AND 399 AND location IS NOT NULL AND hop >= 5 THEN 'TOO_MANY_REDIRECTS' WHEN error = 'ETIMEDOUT' THEN 'TIMEOUT' WHEN error = 'ENOTFOUND' THEN 'DNS_FAILURE'
       WHEN error IS NOT NULL THEN 'CONNECTION_FAILED' WHEN lower(trim(string_split(content_type, ';')[1])) NOT IN {members(lx.TEXTUAL_CONTENT_TYPES)} THEN 'UNSUPPORTED_CONTENT_TYPE'
       WHEN status >= 400 THEN 'HTTP_ERROR' ELSE 'OK' END AS code FROM lst l JOIN agg USING (request_id)""",
    "k7_robots_parse": f"WITH {ROBOTS} SELECT * FROM robots",
    "k8_robots_select_group": f"WITH {ROBOTS} SELECT site_key, match_rank, array_to_string(list_transform(rules, lambda r: r.type || ' ' || r.path), ' | ') AS rules, crawl_delay FROM own",
    "k9_robots_path_allowed": f"""WITH {ROBOTS}, pg AS (SELECT page_id, site_key, {f.path('url')} AS path FROM ({b.SITE_PAGES_SQL}) AS p)
       SELECT page_id, pg.site_key, path, rules IS NULL OR {_longest('disallow')} = -1 OR {_longest('allow')} >= {_longest('disallow')} AS allowed FROM pg LEFT JOIN own ON own.site_key = pg.site_key""",
    "k10_robots_ai_blocked": f"WITH {ROBOTS} SELECT site_key, array_to_string(blocked_agents, ' | ') AS blocked_agents, blocks_everything, rule_count, sitemaps, agent_specific FROM ai",
    "k11_site_file_facts": f"WITH {ROBOTS} SELECT * FROM sfacts",
}
