"""How the given tables stand in for the tables an audit works on.

Each text is plain SQL that both engines read, so a query and its check start from the same rows.
All of it grows with the given tables: ``site_pages`` keeps every page whole and adds the furniture
(metadata, structured data, links, contacts) that the given pages lack.
"""

from pyspark.sql import DataFrame, SparkSession

AS_OF_PAGES = "2024-06-30 00:00:00"
AS_OF_ORDERS = "2001-08-02 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"

BARE_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www[.]', '')"
# Label left of the registrable domain, e.g. "tionsh" of "blog.tionsh.example.com".
BRAND = "coalesce(nullif(regexp_extract({host}, '([^.]+)[.][^.]+[.][^.]+$', 1), ''), {host})"

_ORIGIN = "regexp_extract(url, '^https?://[^/?#]*', 0)"
_N = "CAST(page_id % 40 AS STRING)"
_LINK = "CAST((page_id * 3 + 1) % 40 AS STRING)"
_ID = "CAST(page_id AS STRING)"

_PATH = f"""CASE page_id % 14 WHEN 0 THEN '/' WHEN 1 THEN '/about-us' WHEN 2 THEN '/services/roof-' || {_N}
 WHEN 3 THEN '/contact/' WHEN 4 THEN '/faq' WHEN 5 THEN '/blog' WHEN 6 THEN '/blog/post-' || {_N}
 WHEN 7 THEN '/case-studies/job-' || {_N} WHEN 8 THEN '/pricing' WHEN 9 THEN '/team/ann-' || {_N}
 WHEN 10 THEN '/products/p' || {_N} WHEN 11 THEN '/compare/shingle-vs-tile' WHEN 12 THEN '/category/roofs'
 ELSE regexp_replace(url, '^https?://[^/?#]*', '') END"""

_HEAD = f"""CASE WHEN page_id % 4 <> 0 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END
 || CASE WHEN page_id % 9 = 1 THEN '<META content=Short name=description>'
    WHEN page_id % 3 <> 0 THEN '<meta content="Plan {{n}}: we provide roof repair &amp; inspection > 20 years for homeowners and families in Denver." name="description">' ELSE '' END
 || CASE page_id % 5 WHEN 0 THEN '<link rel="canonical" href="/about-us/">' WHEN 1 THEN '<link href="https://Other.Example.com:443/a/../b" rel="canonical">'
    WHEN 2 THEN '<link rel="stylesheet" href="x.css"><link rel="canonical" href="{{url}}">' ELSE '' END
 || CASE WHEN page_id % 17 = 5 THEN '<meta name="robots" content="NoIndex, follow">' WHEN page_id % 19 = 3 THEN '<meta name="googlebot" content="none">' ELSE '' END
 || CASE WHEN page_id % 5 < 3 THEN '<meta property="og:title" content="Old"><meta property="og:title" content="Page {{n}}"><meta property="og:description" content="About &quot;{{n}}&quot;"><meta property="og:type" content="website">' ELSE '' END
 || CASE WHEN page_id % 7 = 2 THEN '<meta name="twitter:card" content="summary">' ELSE '' END
 || CASE page_id % 6
    WHEN 0 THEN '<script type="application/ld+json">{{"@context":"https://schema.org","@type":"LocalBusiness","name":" {{brand}} Roofing ","url":"https://x.example","logo":{{"@type":"ImageObject","url":"logo.png"}},"telephone":"+1-720-555-0168","email":"a@b.example","address":{{"@type":"PostalAddress","name":"12 Main St"}},"sameAs":["https://p.example/{{n}}"],"areaServed":"Denver"}}</script>'
    WHEN 1 THEN '<script type="application/ld+json">{{"@type":"FAQPage","mainEntity":[{{"@type":"Question","name":"How long?","acceptedAnswer":{{"@type":"Answer","text":"Two days"}}}}]}}</script>'
    WHEN 2 THEN '<script type="application/ld+json">{{"@type": "Broken", {{n}}</script>'
    WHEN 3 THEN '<script type=''application/ld+json''>{{"@graph":[{{"@type":"WebSite","name":"Site {{n}}"}},{{"@type":"BreadcrumbList"}},{{"@type":["Article","BlogPosting"],"headline":"H","author":{{"@type":"Person","name":"Ines Okafor"}},"datePublished":"2023-0' || CAST(1 + page_id % 9 AS STRING) || '-11","dateModified":"2024-03-0' || CAST(1 + page_id % 9 AS STRING) || '"}}]}}</script>'
    WHEN 4 THEN '<!-- <script type="application/ld+json">{{"@type":"Corporation"}}</script> -->'
    ELSE '<script type="application/ld+json">{{"@type":"Organization","name":"Northern {{n}}","description":"d","sameAs":"https://p.example"}}</script><script type="application/ld+json">[{{"@type":"Product","name":"P","aggregateRating":{{"@type":"AggregateRating","name":"4.8"}},"review":""}}]</script>' END
 || CASE page_id % 8 WHEN 1 THEN '<meta property="article:published_time" content="2022-05-0' || CAST(1 + page_id % 9 AS STRING) || 'T08:00:00Z"><meta property="article:modified_time" content="2023-11-20">'
    WHEN 2 THEN '<meta name="datePublished" content="2021-02-03">' WHEN 4 THEN '<meta name="dateModified" content="not a date">' ELSE '' END
 || CASE WHEN page_id % 10 = 3 THEN '<meta name="author" content="Tove Lindqvist">' ELSE '' END"""

_BODY = f"""'<h2>' || CASE page_id % 4 WHEN 0 THEN 'What does a roof cost' WHEN 1 THEN 'Why {{n}} matters' WHEN 2 THEN 'Our range' ELSE 'Ready?' END || '</h2>'
 || CASE WHEN page_id % 6 = 1 THEN '<h4>Small print</h4>' ELSE '<h3>Is it <b>safe</b>?</h3><h3>How to start</h3>' END
 || CASE page_id % 5
    WHEN 0 THEN '<p>Roof Repair is a service that our company offers to homeowners and property managers across Colorado; we handled 350 projects in 12 years.</p>'
    WHEN 1 THEN '<p>According to the 2021 code, Ice Barrier refers to the membrane. We are licensed, License #4471, established 1998, with 95% on time.</p>'
    WHEN 2 THEN '<p>Our process is simple: step 1 call us, step 2 inspection. Rated 4.8 out of 5 by customers; what our customers say matters to us.</p>'
    WHEN 3 THEN '<p>A world-class, cutting edge crew and the best value: Metal versus tile, pros and cons, our research compared 40 homes.</p>'
    ELSE '<p>Frequently asked questions for landlords &#8212; see the list below &amp;lt; or visit the office at 1.5 miles from New York.</p>' END
 || '<p>Plan {{n}} includes gutters, flashing and attic vents for every house on the block.<div>not in it</div>'
 || CASE WHEN page_id % 3 = 0 THEN '<ol><li>one<li>two</ol><table><tr><td>a</td></tr></table>' ELSE '<dl><dt>Eave</dt><dd>edge</dd></dl>' END
 || CASE page_id % 4 WHEN 0 THEN '<img src="a.png" alt="roof"><img alt="" src=b><img src=c>' WHEN 1 THEN '<img src="{{n}}.png" alt=''x > y''>' ELSE '' END
 || '<a href="/blog/post-{{link}}">Next post</a> <a href="../services/roof-{{link}}/">Roof</a> <A HREF=''/case-studies/job-{{n}}?x=1#f''>Job</A> <a href="/privacy-policy">Privacy</a>'
 || CASE WHEN page_id % 2 = 0 THEN '<a href="https://www.Standards.example.org/code?id=1&amp;v=2" rel="noopener">Building code</a> <a rel="nofollow" href="//ads.example.net/">Sponsor</a> <a href="https://x.example">https://x.example</a>' ELSE '<a href="mailto:hello{{n}}@mail.example.com">Write to us</a><a href="/terms">t</a><a href="#top">Top</a><a href="javascript:void(0)">no</a><a href="">none</a>' END
 || CASE WHEN page_id % 7 = 3 THEN '<span class="post byline">By Jane Doe</span>' WHEN page_id % 7 = 4 THEN '<a rel="author" href="/team/ann-{{n}}">Ann Lee</a> by Ann Lee' ELSE '' END
 || CASE page_id % 6 WHEN 1 THEN '<address>12 Main St<br>Denver, CO 80211</address>' WHEN 2 THEN '<em>Call (720) 555-01' || CAST(10 + page_id % 90 AS STRING) || ' or info@mail.example.com, logo@2x.png</em>' ELSE '' END
 || CASE WHEN page_id % 8 = 3 THEN '<time datetime="2023-12-0' || CAST(1 + page_id % 9 AS STRING) || '">Dec</time>' ELSE '' END
 || CASE WHEN page_id % 9 = 4 THEN '<div itemscope itemtype="https://schema.org/Offer"></div><div itemtype=http://schema.org/Event itemscope></div>' ELSE '' END"""


def _fill(text: str) -> str:
    marks = {"{n}": _N, "{link}": _LINK, "{url}": "page_url", "{brand}": "brand"}
    out = text
    for mark, sql in marks.items():
        out = out.replace(mark, f"' || {sql} || '")
    return out


SITE_PAGES_SQL = f"""
SELECT page_id, page_url AS url, site_key,
  CAST(CASE WHEN page_id % 23 = 7 THEN 404 ELSE 200 END AS INT) AS status_code,
  CAST(200 + (page_id * 37) % 3000 AS INT) AS fetch_ms,
  CAST(CASE WHEN page_id % 29 = 5 THEN 3 WHEN page_id % 11 = 0 THEN 1 ELSE 0 END AS INT) AS redirect_hops,
  CASE WHEN page_id % 31 = 4 THEN 'application/pdf' WHEN page_id % 31 = 5 THEN 'TEXT/HTML ; charset=utf-8'
       ELSE 'text/html; charset=utf-8' END AS content_type,
  replace(replace(replace(html, '</title>', CASE WHEN page_id % 2 = 0 THEN ' | ' || brand ELSE '' END || '</title>'),
    '</head>', {_fill(_HEAD)} || '</head>'),
    '</article>', {_fill(_BODY)} || '</article>') AS html
FROM (SELECT page_id, html, {_ORIGIN} || {_PATH} AS page_url, {BARE_HOST} AS site_key,
        {BRAND.format(host=BARE_HOST)} AS brand FROM pages) AS p
"""

# One row per site: its seed page and what the owner told about it.
SITES_SQL = f"""
SELECT site_key, seed_page_id, {BRAND.format(host='site_key')} || ' and co' AS business_name,
  CASE WHEN seed_page_id % 3 = 0 THEN NULL ELSE 'roof repair, inspection; slate cladding ,abc' END AS primary_services,
  CASE WHEN seed_page_id % 4 = 0 THEN NULL ELSE 'Denver' END AS location,
  CAST(1 + seed_page_id % 150 AS BIGINT) AS owner_id
FROM (SELECT {BARE_HOST} AS site_key, min(page_id) AS seed_page_id FROM pages GROUP BY 1) AS s
"""

# Competitors that each site asked for: pages that follow its seed page, as people type them.
COMPETITORS_SQL = f"""
SELECT s.site_key, CAST(k.pos AS INT) AS pos,
  CASE WHEN k.pos = 3 THEN 'https://missing' || CAST(s.seed_page_id AS STRING) || '.example.org/' WHEN k.pos = 2 THEN 'http://localhost/' ELSE p.url END AS raw
FROM ({SITES_SQL}) AS s CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS k
JOIN (SELECT page_id, url FROM ({SITE_PAGES_SQL}) AS q) AS p ON p.page_id = s.seed_page_id + 1 + k.pos * 2 AND s.seed_page_id % 5 <> 4
"""

# robots.txt, sitemap.xml and llms.txt of every site.
_BREAK = "chr(10)"
SITE_FILES_SQL = f"""
SELECT site_key, path, CAST(CASE WHEN (seed_page_id + length(path)) % 9 = 1 THEN 404 ELSE 200 END AS INT) AS status_code,
  CASE path
  WHEN '/robots.txt' THEN 'User-agent: *' || {_BREAK} || 'Disallow: /cart # basket' || {_BREAK} || 'Allow: /cart/help' || {_BREAK}
    || 'Disallow:' || {_BREAK} || 'Crawl-delay: ' || CAST(seed_page_id % 5 AS STRING) || {_BREAK}
    || CASE seed_page_id % 4 WHEN 0 THEN 'user-agent: GPTBot' || {_BREAK} || 'User-Agent : CCBot' || {_BREAK} || 'Disallow: /' || {_BREAK}
       WHEN 1 THEN 'Disallow: /blog/*-1$' || {_BREAK} || 'Disallow: /*/job-' || {_BREAK} || 'Allow: /*/job-3' || {_BREAK}
       WHEN 2 THEN 'User-agent: site-audit' || {_BREAK} || 'Disallow: /pricing' || {_BREAK} || 'Allow: /pricing' || {_BREAK} || 'no colon here' || {_BREAK}
       ELSE 'User-agent: claudebot' || {_BREAK} || 'Allow: /' || {_BREAK} || 'User-agent: *' || {_BREAK} || 'Disallow: /team' || {_BREAK} END
    || CASE WHEN seed_page_id % 10 = 3 THEN 'Disallow: /' || {_BREAK} ELSE '' END
    || 'Sitemap: https://' || site_key || '/sitemap.xml'
  WHEN '/sitemap.xml' THEN CASE WHEN seed_page_id % 3 = 0 THEN '<sitemapindex>' ELSE '<urlset>' END
    || repeat('<url><loc>https://' || site_key || '/</loc></url>', CAST(seed_page_id % 4 AS INT)) || '<LOC>'
  ELSE CASE WHEN seed_page_id % 3 = 1 THEN '<!doctype html><HTML lang=en>' ELSE '> about' || {_BREAK} END || '## Pages' || {_BREAK} || '- home' END AS body
FROM ({SITES_SQL}) AS s CROSS JOIN (SELECT '/robots.txt' AS path UNION ALL SELECT '/sitemap.xml' UNION ALL SELECT '/llms.txt') AS f
"""

# Result pages of the searches made for each site.
SEARCH_RESULTS_SQL = f"""
SELECT site_key, 'q' || CAST(page_id % 3 AS STRING) AS query, page_id AS rank, 'Hit ' || brand AS title,
  CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://www.directory' || CAST(page_id % 12 AS STRING) || '.example.org/x' WHEN 2 THEN 'not a link' ELSE 'http://news.example.net/' || CAST(page_id AS STRING) END AS link
FROM (SELECT page_id, url, {BARE_HOST} AS site_key, CASE WHEN page_id % 5 = 0 THEN {BRAND.format(host=BARE_HOST)} ELSE 'other' END || ' and co' AS brand FROM pages) AS p
"""

# Hop log of the fetches: one request per page.
FETCH_LOG_SQL = f"""
SELECT 'req-' || {_ID} AS request_id, site_key, CAST(hop AS INT) AS hop,
  CASE WHEN page_id % 13 = 6 AND hop > 1 THEN 'https://' || site_key || '/hop0' ELSE 'https://' || site_key || '/hop' || CAST(hop AS STRING) END AS url,
  CAST(CASE WHEN hop < hops THEN 301 WHEN page_id % 10 = 8 THEN NULL WHEN page_id % 10 = 9 THEN 503 ELSE 200 END AS INT) AS status,
  CASE WHEN hop < hops THEN '/next' END AS location,
  CASE WHEN hop < hops THEN NULL WHEN page_id % 10 = 7 THEN 'image/png' WHEN page_id % 10 = 6 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN hop = hops AND page_id % 10 = 8 THEN CASE page_id % 4 WHEN 0 THEN 'ETIMEDOUT' WHEN 2 THEN 'ENOTFOUND' ELSE 'ECONNREFUSED' END END AS error
FROM (SELECT page_id, {BARE_HOST} AS site_key, CASE WHEN page_id % 13 = 6 THEN 2 ELSE page_id % 8 END AS hops FROM pages) AS p
CROSS JOIN (SELECT 0 AS hop UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) AS h
WHERE hop <= hops
"""

# Fetch log of link targets (url_key, site_key): some answer, fail, were never fetched, or moved to a chain of pages
# that the targets of a site share and that ends in a page, an error, no connection or a loop.
LINK_FETCHES_SQL = """
SELECT url_key, CAST(CASE WHEN n % 5 = 0 THEN 404 WHEN n % 5 = 1 THEN 301 WHEN n % 5 = 4 AND n % 3 < 2 THEN NULL ELSE 200 END AS INT) AS status,
  CASE WHEN n % 5 = 1 THEN 'https://' || site_key || '/moved/' || CAST(n % 9 AS STRING) END AS location_key,
  CASE WHEN n % 5 = 4 AND n % 3 = 0 THEN 'ECONNREFUSED' WHEN n % 5 = 4 AND n % 3 = 1 THEN 'ETIMEDOUT' END AS error
FROM (SELECT url_key, min(site_key) AS site_key, length(url_key) AS n FROM {targets} GROUP BY url_key) AS t WHERE n % 5 <> 2
UNION ALL
SELECT 'https://' || site_key || '/moved/' || CAST(k AS STRING), CAST(CASE WHEN k > 0 OR n % 4 = 0 THEN 301 WHEN n % 4 = 1 THEN 503 WHEN n % 4 = 2 THEN 200 END AS INT),
  CASE WHEN k > 0 THEN 'https://' || site_key || '/moved/' || CAST(k - 1 AS STRING) WHEN n % 4 = 0 THEN 'https://' || site_key || '/moved/2' END,
  CASE WHEN k = 0 AND n % 4 = 3 THEN 'ECONNREFUSED' END
FROM (SELECT DISTINCT site_key, length(site_key) AS n FROM {targets}) AS s CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) AS h(k)
"""

# Raw addresses as people type them, several per page.
RAW_URLS_SQL = f"""
SELECT page_id * 16 + kind AS url_id,
  CASE kind WHEN 0 THEN url WHEN 1 THEN '  ' || regexp_replace(url, '^https?://', '') || ' '
  WHEN 2 THEN regexp_replace(url, '^https?://', 'https://user:pw@') WHEN 3 THEN 'ftp://' || {BARE_HOST}
  WHEN 4 THEN 'http://10.' || CAST(page_id % 256 AS STRING) || '.0.1/x' WHEN 5 THEN 'http://' || {BARE_HOST} || ':6379/a?utm_source=x&q=1&flag'
  WHEN 6 THEN 'https://host' || {_ID} || '.internal/' WHEN 7 THEN 'plainhost' || {_ID} WHEN 8 THEN ''
  WHEN 9 THEN 'https://[::1]/' WHEN 10 THEN 'http://[fe80::' || CAST(page_id % 10 AS STRING) || ']:8080/' WHEN 11 THEN 'HTTPS://' || {BARE_HOST} || '.:443/A/../b/%7E?gclid=1#z'
  WHEN 12 THEN 'http://169.254.169.254/latest' WHEN 13 THEN 'https://[2606:4700::' || CAST(page_id % 10 AS STRING) || ']/ok' WHEN 14 THEN 'https://bad host/' ELSE 'http://8.8.' || CAST(page_id % 256 AS STRING) || '.8:81/' END AS raw
FROM pages CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5
  UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11 UNION ALL SELECT 12
  UNION ALL SELECT 13 UNION ALL SELECT 14 UNION ALL SELECT 15) AS k
"""

# Addresses spread over the whole IPv4 space, and IPv6 families.
ADDRESSES_SQL = """
SELECT event_id AS address_id,
  CASE event_id % 12 WHEN 0 THEN '10.' || b || '.1.2' WHEN 1 THEN '172.' || b || '.0.9' WHEN 2 THEN '192.168.' || b || '.1' WHEN 3 THEN '100.' || b || '.7.7'
  WHEN 4 THEN '169.254.169.' || b WHEN 5 THEN '127.0.0.' || b WHEN 6 THEN '::ffff:10.0.0.' || b WHEN 7 THEN 'fd00:ec2::' || b WHEN 8 THEN 'fe8' || CAST(event_id % 10 AS STRING) || '::1'
  WHEN 9 THEN '2001:db8::' || CAST(event_id % 10 AS STRING) WHEN 10 THEN '0' || b || '.1.1.1'
  ELSE b || '.' || CAST((event_id * 7) % 256 AS STRING) || '.' || CAST((event_id * 13) % 256 AS STRING) || '.200' END AS address
FROM (SELECT event_id, CAST((event_id * 31) % 256 AS STRING) AS b FROM events) AS e
"""

# ---- business tables --------------------------------------------------------------------

_USER_ID = "CAST({k} AS STRING)"
USERS_SQL = """
SELECT c_custkey AS user_id, c_name AS name, lower(replace(c_name, '#', '.')) || '@mail.example.com' AS email,
  CASE WHEN c_acctbal < 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
  CAST(c_nationkey % 3 AS INT) AS one_time_credits,
  c_mktsegment = 'FURNITURE' AND c_nationkey < 5 AS is_demo,
  c_nationkey = 24 AS is_deleted, 'cus_' || CAST(c_custkey AS STRING) AS customer_ref, first_order AS created_at
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) AS f ON o_custkey = c_custkey
"""
PAYMENTS_SQL = """
SELECT o_orderkey AS payment_id, o_custkey AS user_id,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ONE_TIME_AUDIT' ELSE 'SUBSCRIPTION' END AS kind,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
  CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amount_cents,
  CASE WHEN o_orderpriority = '5-LOW' THEN CAST(floor(o_totalprice * 10 + 0.5) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS refunded_cents,
  o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS paid_at, o_custkey % 25 = 0 AS is_demo
FROM orders
"""
# Audits that the customers ordered, with a score when they are done.
AUDITS_SQL = """
SELECT o_orderkey AS audit_id, o_custkey AS user_id, 'site-' || CAST(o_custkey % 50 AS STRING) || '.example' AS domain,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'RUNNING' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'FAILED' ELSE 'QUEUED' END END AS status,
  CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) % 101 AS INT) END AS overall_score,
  o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice < 5000 AS is_deleted, o_orderdate AS created_at, o_custkey % 25 = 0 AS is_demo
FROM orders
"""
SUBSCRIPTIONS_SQL = """
SELECT o_orderkey AS subscription_id, o_custkey AS user_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'AGENCY' WHEN '2-HIGH' THEN 'GROWTH' WHEN '5-LOW' THEN 'FREE' ELSE 'STARTER' END AS plan,
  CASE WHEN o_totalprice < 60000 THEN 'CANCELED' WHEN o_totalprice < 120000 THEN 'PAST_DUE' WHEN o_orderstatus = 'P' THEN 'TRIALING' ELSE 'ACTIVE' END AS status,
  CAST(o_orderkey % 20 AS INT) AS audits_used, o_orderdate AS created_at, o_custkey % 25 = 0 AS is_demo
FROM orders
"""
# Product events under their product names.
PRODUCT_EVENTS_SQL = """
SELECT event_id, user_id, ts AS created_at,
  CASE event_type WHEN 'view' THEN CASE WHEN value < 20 THEN 'home_viewed' WHEN value < 40 THEN 'demo_started' ELSE 'pricing_viewed' END
    WHEN 'click' THEN CASE WHEN value < 20 THEN 'demo_completed' WHEN value < 40 THEN 'live_preview_requested' ELSE 'checkout_started' END
    WHEN 'signup' THEN 'signup_completed' WHEN 'purchase' THEN CASE WHEN value < 30 THEN 'checkout_completed' ELSE 'audit_created' END
    ELSE CASE WHEN value < 10 THEN 'audit_completed' WHEN value < 20 THEN 'report_downloaded' ELSE 'client_error' END END AS name,
  user_id % 25 = 0 AS is_demo, value, props
FROM events
"""
# Property texts and keys of product events, as clients send them.
RAW_EVENTS_SQL = f"""
SELECT event_id, user_id, name, created_at, repeat('s' || CAST(event_id AS STRING), 20) AS session_key, '/p/' || repeat(CAST(event_id AS STRING), 50) AS path,
  CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{{"plan":"GROWTH","score":' || CAST(event_id AS STRING) || ',"isDemo":true,"note":"x"}}'
   WHEN 2 THEN '{{"source":{{"a":1}},"result":null,"variant":"' || repeat('v', 150) || '"}}' WHEN 3 THEN 'not json' WHEN 4 THEN '{{"domain":["a"],"pageCount":12,"category":"c' || CAST(event_id AS STRING) || '"}}' END AS props
FROM ({PRODUCT_EVENTS_SQL}) AS e
"""
PREVIEW_RUNS_SQL = """
SELECT event_id AS run_id, ts AS created_at, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN CASE WHEN value < 15 THEN 'TIMEOUT' WHEN value < 40 THEN 'BLOCKED' ELSE 'HTTP_ERROR' END END AS error_code,
  CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INT) % 101 END AS score, CAST(floor(value * 10) AS INT) AS duration_ms,
  'd' || CAST(user_id AS STRING) || '.example' AS domain
FROM events
"""
CONTACTS_SQL = "SELECT conv_id, turn, turn = 0 AS unread, conv_id % 25 = 0 AS is_demo FROM conversations WHERE role = 'user'"
# One audit per site and owner.
SITE_AUDITS_SQL = f"""
SELECT site_key, seed_page_id % 7 AS user_id, CASE WHEN seed_page_id % 13 = 5 THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
  seed_page_id % 11 = 3 AS is_archived, false AS is_deleted, (seed_page_id * 17) % 1000 AS completed_at
FROM ({SITES_SQL}) AS s
"""

# Credits: a purchase adds one, an error takes one.
LEDGER_SQL = """
SELECT event_id AS entry_id, user_id, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS delta, ts AS created_at
FROM events WHERE event_type IN ('purchase', 'error')
"""
# Requests against the credit account, in arrival order.
CREDIT_LOG_SQL = """
SELECT event_id AS request_id, user_id, ts AS created_at,
  CASE event_type WHEN 'purchase' THEN 'grant' WHEN 'click' THEN 'reserve' WHEN 'view' THEN 'reserve'
    WHEN 'error' THEN 'revoke' ELSE 'renew' END AS action,
  CAST(CASE WHEN event_type = 'error' THEN 1 + floor(value) % 3 ELSE 1 END AS INT) AS amount
FROM events
"""
# Requests of all six kinds: audits that fail are refunded later, some of them twice.
CREDIT_HISTORY_SQL = """
SELECT event_id * 4 AS request_id, user_id, ts AS created_at,
  CASE event_type WHEN 'purchase' THEN 'grant' WHEN 'click' THEN 'reserve' WHEN 'view' THEN 'reserve'
    WHEN 'error' THEN 'revoke' ELSE CASE WHEN event_id % 3 = 0 THEN 'plan' ELSE 'renew' END END AS action,
  CAST(CASE WHEN event_type = 'error' THEN 1 + floor(value) % 3 ELSE 1 END AS INT) AS amount,
  CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN CASE CAST(floor(value) AS INT) % 5 WHEN 0 THEN 'FREE' WHEN 1 THEN 'GROWTH' WHEN 2 THEN 'AGENCY' ELSE 'STARTER' END END AS plan,
  event_id * 4 AS audit_id
FROM events
UNION ALL SELECT event_id * 4 + 1, user_id, ts + INTERVAL 30 HOURS, 'refund', 0, NULL, event_id * 4 FROM events WHERE event_type IN ('click', 'view') AND event_id % 3 <> 0
UNION ALL SELECT event_id * 4 + 2, user_id, ts + INTERVAL 90 HOURS, 'refund', 0, NULL, event_id * 4 FROM events WHERE event_type IN ('click', 'view') AND event_id % 4 = 0
"""
# Attempts at limited actions, a day's in one hour; most share an identifier.
ATTEMPTS_SQL = """
SELECT event_id, CASE WHEN event_id % 20 < 6 THEN 'report:download' WHEN event_id % 20 < 9 THEN 'audit:create' WHEN event_id % 20 < 12 THEN 'auth:signin'
    WHEN event_id % 20 < 14 THEN 'auth:signup' WHEN event_id % 20 < 16 THEN 'auth:reset-confirm' WHEN event_id % 20 = 16 THEN 'auth:reset-request'
    WHEN event_id % 20 = 17 THEN 'contact:submit' WHEN event_id % 20 = 18 THEN 'preview:run' ELSE 'search:run' END AS bucket,
  CASE WHEN user_id % 5 = 0 THEN 'u' || CAST(user_id AS STRING) WHEN user_id % 5 = 1 THEN 'Shared@mail.example.com' ELSE 'shared@mail.example.com' END AS identifier,
  date_trunc('day', ts) + (ts - date_trunc('hour', ts)) AS ts
FROM events
"""
# Payment-provider events; every delivery arrives, some twice.
WEBHOOKS_SQL = """
SELECT 'evt_' || CAST(event_id - (CASE WHEN event_type = 'click' THEN event_id % 3 ELSE 0 END) AS STRING) AS event_id, event_id AS delivery_id,
  CASE event_type WHEN 'purchase' THEN 'checkout.session.completed' WHEN 'signup' THEN 'customer.subscription.updated'
    WHEN 'view' THEN 'invoice.paid' WHEN 'error' THEN CASE WHEN value < 15 THEN 'customer.subscription.deleted' ELSE 'invoice.payment_failed' END
    ELSE CASE WHEN value < 50 THEN 'customer.created' ELSE 'checkout.session.completed' END END AS type,
  'sub_' || CAST(user_id AS STRING) AS subscription_ref, 'cs_' || CAST(floor(event_id / 2) AS BIGINT) AS session_ref, 'in_' || CAST(floor(event_id / 3) AS BIGINT) AS invoice_ref,
  CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS STRING) WHEN event_id % 3 = 1 THEN 'nobody' END AS metadata_user,
  CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS STRING) END AS client_reference,
  CASE WHEN event_id % 5 < 4 THEN 'cus_' || CAST(user_id AS STRING) END AS customer_ref,
  CASE CAST(floor(value) AS INT) % 3 WHEN 0 THEN 'STARTER' WHEN 1 THEN 'GROWTH' ELSE 'AGENCY' END AS plan,
  CASE CAST(floor(value) AS INT) % 9 WHEN 0 THEN 'trialing' WHEN 1 THEN 'past_due' WHEN 2 THEN 'unpaid' WHEN 3 THEN 'paused' WHEN 4 THEN 'odd' WHEN 5 THEN 'incomplete_expired' ELSE 'active' END AS status,
  CAST(floor(value / 20) AS INT) AS period, CASE WHEN value < 45 THEN 'paid' ELSE 'unpaid' END AS payment_status,
  CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount_cents, ts AS created_at
FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A binding as a DataFrame over the tables of one directory."""
    out = text
    for name in ("pages", "events", "orders", "customer", "documents", "lineitem", "conversations"):
        for word in ("FROM", "JOIN"):
            out = out.replace(f"{word} {name} ", f"{word} parquet.`{sf_dir}/{name}.parquet` ")
            out = out.replace(f"{word} {name})", f"{word} parquet.`{sf_dir}/{name}.parquet`)")
            out = out.replace(f"{word} {name}\n", f"{word} parquet.`{sf_dir}/{name}.parquet`\n")
    return spark.sql(out)


def link_fetches(targets: DataFrame) -> DataFrame:
    """Fetch log of link targets."""
    return targets.sparkSession.sql(LINK_FETCHES_SQL, targets=targets.select("url_key", "site_key"))
