"""Queries that apply each operator to its whole table, and their SQL."""

import public_tokenizers

from pyspark.sql import functions as F

from corpuscope.llm import (
    cap_filters, centroids, conversation_trie, decontaminate, jaccard_join, lm_scoring, mixing, quality, quality_rules, suffix_dedup, token_counts,
    url_filters, warc)
from corpuscope.llm.common import new_folder, table

URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
URL_PATTERNS = [("*/login/*", "block"), ("*/cart/*", "block"), ("*/wp-admin/*", "block")]


def op1_url_filters(spark, sf_dir):
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_PATTERNS)


def op2_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents")).select("doc_id", "quality", "keep")


def op3_lm_scoring(spark, sf_dir):
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_warc(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark, sf_dir):
    """The cache is new for each run, so that the run's own work is what is seen."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "token-counts"))


def op7_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.join_similar(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark, sf_dir):
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_centroid_clustering(spark, sf_dir):
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark, sf_dir):
    return quality_rules.judge_documents(table(spark, sf_dir, "documents")).drop("broken")


def op13_conversation_trie(spark, sf_dir):
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_trie": op13_conversation_trie,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(host_rule, path_rule, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j AS (
  SELECT page_id, host, path,
         (SELECT max_by(host_rule || path_rule, length(host_rule || path_rule)) FROM r
           WHERE (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule)) AS rule,
         CASE WHEN contains(path, '/wp-admin/') THEN '*/wp-admin/*' WHEN contains(path, '/login/') THEN '*/login/*'
              WHEN contains(path, '/cart/') THEN '*/cart/*' END AS pattern
  FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL AND pattern IS NOT NULL THEN 'block' ELSE coalesce((SELECT action FROM r WHERE host_rule || path_rule = rule), 'allow') END AS verdict,
       CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM j"""

OP9_SQL = r"""
WITH s AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
             CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM t),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before FROM w
      WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(((SELECT sum(source_size) FROM t) * 1.5::DOUBLE - cap_before) / ((SELECT sum(weight) FROM w) - weight_before)) AS level FROM o),
g AS (SELECT source, source_size, least(cap, level * weight) AS target FROM w, l),
c AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM g),
d AS (SELECT s.*, c.source_size, c.target, c.budget, c.whole,
             coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM s JOIN c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken, source
FROM d"""

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(words[p + 1:p + n], ' ') AS passage
      FROM (SELECT *, least(10, len(words)) AS n FROM b WHERE len(words) > 0), unnest(range(0, len(words) - n + 1)) AS u(p)),
l AS (SELECT DISTINCT n FROM i),
s AS (SELECT doc_id, n, p, array_to_string(words[p + 1:p + n], ' ') AS passage FROM d, l, unnest(range(0, greatest(0, len(words) - n + 1))) AS u(p)),
h AS (SELECT doc_id, p, s.n, item_id FROM s JOIN i USING (passage) WHERE s.n = i.n),
w AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
n AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS newest FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         list_reduce(list_transform(range(0, 5), lambda k: CAST(substr(bits, CAST(1 + 5 * i + k AS INT), 1) AS INT)), lambda a, b: 2 * a + b) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(sha1(body), CAST(i AS INT), 1)) - 1), 4, '0')), '') AS bits FROM n)"""

_APART = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
_ROUNDS = "".join(rf"""
a{r} AS MATERIALIZED (SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, x, c, CAST({_APART} AS BIGINT) AS d FROM v, c{r}) GROUP BY vec_id, x),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(list_transform(range(1, 65), lambda i: CAST(floor(m[i] / n) AS BIGINT) - CASE WHEN CAST(floor(m[i] / n) AS BIGINT) * n > m[i] THEN 1 ELSE 0 END), y) AS y
  FROM c{r} LEFT JOIN (SELECT c, any_value(n) AS n, list(t ORDER BY i) AS m FROM (
    SELECT c, i, count(*) AS n, sum(x[i])::BIGINT AS t FROM a{r}, range(1, 65) AS u(i) GROUP BY c, i) GROUP BY c) USING (c)),""" for r in range(5))
OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * e::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS y FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40)),{_ROUNDS}
f AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, CAST({_APART} AS BIGINT) AS d FROM v, c5) GROUP BY vec_id)
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(y, ',')) AS centroid_sha256
FROM f JOIN c5 USING (c)"""

_BUCKET = "greatest(0, length(bin(v)) - 6)"
_FENCE = """{0} AS (SELECT {1} rule, max(docs) AS docs,
  min(CASE WHEN 4 * upto >= docs THEN lo END) AS q1, min(CASE WHEN 4 * upto >= 3 * docs THEN hi END) AS q3 FROM (
    SELECT *, sum(n) OVER (PARTITION BY {1} rule ORDER BY lo) AS upto, sum(n) OVER (PARTITION BY {1} rule) AS docs
    FROM (SELECT {1} rule, lo, hi, sum(n) AS n FROM sketches GROUP BY {1} rule, lo, hi)) GROUP BY {1} rule)"""
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT r, p, words[p:p + 2] AS g FROM d, unnest(range(1, len(words) - 1)) AS u(p)),
s AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM w) WHERE n > 1),
k AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM s, unnest([p, p + 1, p + 2]) AS u(q) GROUP BY r),
m AS (SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1000 * word_chars // greatest(n_words, 1) AS v1, 10000 * n_symbols // greatest(n_words, 1) AS v2,
             10000 * n_repeat_words // greatest(n_words, 1) AS v3, 10000 * n_dup_lines // greatest(n_lines, 1) AS v4 FROM m),
t AS (SELECT lang, source, u.rule, [v1, v2, v3, v4][u.rule] AS v FROM b, (VALUES (1), (2), (3), (4)) AS u(rule) WHERE NOT base_failed),
sketches AS (SELECT lang, source, rule, (v >> {_BUCKET}) << {_BUCKET} AS lo, ((v >> {_BUCKET}) << {_BUCKET}) + (1 << {_BUCKET}) - 1 AS hi, count(*) AS n FROM t GROUP BY ALL),
{_FENCE.format("fine", "lang, source,")},
{_FENCE.format("wide", "lang,")},
{_FENCE.format("every", "")},
p AS (SELECT f.lang, f.source, f.rule, CASE WHEN f.docs >= 200 THEN [f.q1, f.q3] WHEN w.docs >= 200 THEN [w.q1, w.q3] ELSE [e.q1, e.q3] END AS q
      FROM fine f JOIN wide w ON f.lang IS NOT DISTINCT FROM w.lang AND f.rule = w.rule JOIN every e ON e.rule = f.rule),
l AS (SELECT lang, source, list(q[2] + 4 * greatest(q[2] - q[1], [250, 500, 1000, 1000][rule]) ORDER BY rule) AS most, min(q[1] - 4 * greatest(q[2] - q[1], 250)) FILTER (WHERE rule = 1) AS least FROM p GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND v1 >= least AND v1 <= most[1] AND v2 <= most[2] AND v3 <= most[3] AND v4 <= most[4] AS kept
FROM b LEFT JOIN l ON b.lang IS NOT DISTINCT FROM l.lang AND b.source IS NOT DISTINCT FROM l.source"""

_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)), lambda c, x:
  list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)), 4294967295::UBIGINT)"""
OP13_SQL = rf"""
WITH o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, CAST({_CRC32} % 4 AS BIGINT) AS h FROM o),
q AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h], []), h.turns[h + 1:]) AS turns FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
n AS (SELECT conv_id, d, turns[1:d] AS path, d = len(turns) AS ended FROM q, unnest(range(0, len(turns) + 1)) AS u(d)),
g AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends,
             CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS own FROM n GROUP BY d, path),
c AS (SELECT path[1:d - 1] AS up, count(*) AS n_children FROM g WHERE d > 0 GROUP BY up),
x AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c ON path = up),
s AS (SELECT path[1:a] AS above, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM x, unnest(range(0, d + 1)) AS u(a) GROUP BY above)
SELECT x.conv_id, d AS depth, p.conv_id AS parent_conv_id, x.n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN s ON above = path LEFT JOIN (SELECT path AS of, conv_id FROM g) p ON d > 0 AND of = path[1:d - 1]"""

SQL = {"op11_centroid_clustering": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_conversation_trie": OP13_SQL, "op1_url_filters": OP1_SQL, "op4_decontamination": OP4_SQL, "op5_warc": OP5_SQL, "op9_mixing": OP9_SQL}
