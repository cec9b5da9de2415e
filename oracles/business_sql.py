"""Checks for the business, ledger and event queries."""

from corpuscope.functions import lexicon as lx
from corpuscope.sources import bindings as b
from oracles.audit_sql import RECS
from oracles.fragments import members, q
from oracles.limits import ENTITLED as _ENT, LIMITS, plan_value as _plan

U, P, A, S, PE, W = (f"({t}) AS t" for t in (b.USERS_SQL, b.PAYMENTS_SQL, b.AUDITS_SQL, b.SUBSCRIPTIONS_SQL, b.PRODUCT_EVENTS_SQL, b.WEBHOOKS_SQL))
AS_OF = f"TIMESTAMP '{b.AS_OF_ORDERS}'"
_SERIES = f"""d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day),
 series AS (SELECT day, CAST(coalesce(r, 0) AS BIGINT) AS revenue_cents, coalesce(u, 0) AS signups, coalesce(a, 0) AS audits FROM d
 LEFT JOIN (SELECT CAST(paid_at AS DATE) AS day, sum(amount_cents) AS r FROM {P} WHERE status = 'SUCCEEDED' AND NOT is_demo GROUP BY 1) AS x USING (day)
 LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS u FROM {U} WHERE NOT is_demo AND NOT is_deleted GROUP BY 1) AS y USING (day)
 LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS a FROM {A} WHERE NOT is_deleted AND NOT is_demo GROUP BY 1) AS z USING (day))"""


def i64(x):
    return f"CAST({x} AS BIGINT)"


_FUN = ", ".join(f"count(*) FILTER (WHERE name = '{n}') AS {n}" for n in lx.FUNNEL_COUNTS)
_LIST = "[" + ", ".join(lx.FUNNEL_STEPS) + "]"
_BAL = f"bal AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY created_at, entry_id) AS balance FROM ({b.LEDGER_SQL}) AS l)"
FIRST = f"fd AS (SELECT * FROM ({b.WEBHOOKS_SQL}) AS w QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY delivery_id) = 1)"
_UPD, _PAID = "type = 'customer.subscription.updated'", "type = 'invoice.paid'"
_STAT = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.SUBSCRIPTION_STATUS_MAP.items()) + " ELSE 'INCOMPLETE' END"
_KEYS = " UNION ALL ".join(
    f"SELECT event_id, '{k}' AS k, json_type(j, '$.{k}') AS t, json_extract_string(j, '$.{k}') AS v FROM je" for k in lx.ALLOWED_PROPERTY_KEYS)

SQL = {
    "m1_overview_counts": f"""WITH u AS (SELECT * FROM {U} WHERE NOT is_deleted AND NOT is_demo), a AS (SELECT * FROM {A} WHERE NOT is_deleted AND NOT is_demo), c AS (SELECT * FROM ({b.CONTACTS_SQL}) AS m WHERE NOT is_demo)
      SELECT 'users_total' AS metric, count(*) AS value FROM u UNION ALL SELECT 'users_active', count(*) FROM u WHERE status = 'ACTIVE' UNION ALL SELECT 'users_suspended', count(*) FROM u WHERE status = 'SUSPENDED'
      UNION ALL SELECT 'users_new', count(*) FROM u WHERE created_at >= {AS_OF} - INTERVAL 30 DAYS UNION ALL SELECT 'audits_total', count(*) FROM a
      UNION ALL SELECT 'audits_completed', count(*) FROM a WHERE status = 'COMPLETED' UNION ALL SELECT 'audits_running', count(*) FROM a WHERE status = 'RUNNING' UNION ALL SELECT 'audits_queued', count(*) FROM a WHERE status = 'QUEUED'
      UNION ALL SELECT 'audits_failed', count(*) FROM a WHERE status = 'FAILED' UNION ALL SELECT 'audits_average_score', {i64('floor(avg(overall_score) + 0.5)')} FROM a WHERE status = 'COMPLETED'
      UNION ALL SELECT 'contacts_total', count(*) FROM c UNION ALL SELECT 'contacts_unread', count(*) FROM c WHERE unread
      UNION ALL SELECT 'subscriptions_active', count(*) FROM {S} WHERE NOT is_demo AND status IN ('ACTIVE', 'TRIALING')""",
    "m2_revenue_split": f"""SELECT {i64("sum(amount_cents) FILTER (WHERE status = 'SUCCEEDED')")} AS gross_cents, {i64("sum(amount_cents) FILTER (WHERE status = 'SUCCEEDED' AND kind = 'ONE_TIME_AUDIT')")} AS one_time_cents,
      {i64("sum(amount_cents) FILTER (WHERE status = 'SUCCEEDED' AND kind = 'SUBSCRIPTION')")} AS subscription_cents, {i64(f"coalesce(sum(amount_cents) FILTER (WHERE status = 'SUCCEEDED' AND paid_at >= {AS_OF} - INTERVAL 30 DAYS), 0)")} AS last_30_days_cents,
      {i64('sum(refunded_cents)')} AS refunded_cents, count(*) FILTER (WHERE status = 'SUCCEEDED' AND kind = 'ONE_TIME_AUDIT') AS purchases FROM {P} WHERE NOT is_demo""",
    "m3_mrr": f"SELECT plan, count(*) AS subscriptions, {_plan(1)} AS price_cents, count(*) * {_plan(1)} AS mrr_cents FROM {S} WHERE status IN ('ACTIVE', 'TRIALING') AND NOT is_demo GROUP BY plan",
    "m4_daily_series": f"WITH {_SERIES} SELECT * FROM series",
    "m5_series_totals": f"WITH {_SERIES} SELECT {i64('sum(revenue_cents)')} AS revenue_cents, {i64('sum(signups)')} AS signups, {i64('sum(audits)')} AS audits FROM series WHERE day >= DATE '{b.AS_OF_ORDERS[:10]}' - INTERVAL 1000 DAYS",
    "m6_funnel_counts": f"SELECT {_FUN} FROM {PE} WHERE NOT is_demo AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25 12:00:00'",
    "m7_funnel_conversion": f"""WITH c AS (SELECT {_FUN} FROM {PE} WHERE NOT is_demo), l AS (SELECT {_LIST} AS v, {"[" + ", ".join(q(n) for n in lx.FUNNEL_STEPS) + "]"} AS n FROM c),
      r AS (SELECT unnest(range(0, 9)) AS pos, v, n FROM l) SELECT CAST(pos AS INT) AS pos, n[pos + 1] AS step, v[pos + 1] AS value, CASE WHEN pos > 0 AND v[pos] > 0 THEN {i64('floor(100.0 * v[pos + 1] / v[pos] + 0.5)')} END AS rate FROM r""",
    "m8_top_events": f"SELECT name, count(*) AS events FROM {PE} WHERE NOT is_demo AND created_at >= TIMESTAMP '2024-01-10' GROUP BY 1",
    "m9_job_health": f"""WITH j AS (SELECT * FROM {A} WHERE NOT is_demo) SELECT 'QUEUED' AS item, count(*) AS n, min(created_at) AS at FROM j WHERE status = 'QUEUED' UNION ALL SELECT 'RUNNING', count(*), NULL FROM j WHERE status = 'RUNNING'
      UNION ALL SELECT 'FAILED', count(*), NULL FROM j WHERE status = 'FAILED' UNION ALL SELECT 'COMPLETED', count(*), NULL FROM j WHERE status = 'COMPLETED'
      UNION ALL (SELECT 'failure ' || audit_id, 1, created_at FROM j WHERE status = 'FAILED' ORDER BY created_at DESC, audit_id DESC LIMIT 5)""",
    "m10_search_listing": f"""WITH u AS (SELECT * FROM {U} WHERE NOT is_deleted AND NOT is_demo AND status = 'ACTIVE' AND (name ILIKE '%R#00000001%' OR email ILIKE '%R#00000001%'))
      SELECT user_id, name, email, status, created_at, (SELECT count(*) FROM u) AS total FROM u ORDER BY created_at DESC NULLS LAST, user_id LIMIT 25 OFFSET 2""",
    "m11_listing_with_parent": f"""WITH p AS (SELECT * FROM {P}), a AS (SELECT user_id, count(*) AS n FROM {A} WHERE NOT is_deleted GROUP BY 1), c AS (SELECT user_id, count(*) AS n FROM p GROUP BY 1), u AS (SELECT * FROM {U})
      SELECT payment_id, p.user_id, u.name, u.email, p.kind, p.status, amount_cents, coalesce(c.n, 0) AS user_payments, coalesce(a.n, 0) AS user_audits FROM p LEFT JOIN u USING (user_id) LEFT JOIN a USING (user_id) LEFT JOIN c USING (user_id)""",
    "m12_recent_per_user": f"SELECT user_id, CAST(row_number() OVER w AS INT) AS rank, payment_id, amount_cents FROM {P} WINDOW w AS (PARTITION BY user_id ORDER BY created_at DESC, payment_id DESC) QUALIFY row_number() OVER w <= 5",
    "m13_open_actions": f"""WITH {RECS} SELECT user_id, row_number() OVER w AS rank, rec.site_key, priority, check_id, impact, effort FROM rec JOIN ({b.SITE_AUDITS_SQL}) AS a USING (site_key)
      WHERE horizon = 'DO_FIRST' AND status = 'COMPLETED' AND NOT is_archived WINDOW w AS (PARTITION BY user_id ORDER BY completed_at DESC, rec.site_key DESC, priority) QUALIFY row_number() OVER w <= 5""",
    "m14_status_counts": f"SELECT s AS status, (SELECT count(*) FROM {A} WHERE status = s) AS n FROM (SELECT unnest(['COMPLETED', 'RUNNING', 'QUEUED', 'FAILED', 'CANCELED']) AS s) AS x",
    "m15_snapshot_totals": """SELECT count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (WHERE event_type = 'signup') AS signups, count(*) FILTER (WHERE event_type = 'purchase') AS one_time_sales, count(*) FILTER (WHERE event_type = 'click') AS audits_created,
      count(*) FILTER (WHERE event_type = 'view') AS audits_completed, count(*) FILTER (WHERE event_type = 'error') AS demo_runs, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS preview_runs,
      CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS revenue_cents FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'""",
    "m16_month_rollup": f"""WITH x AS (SELECT strftime(paid_at, '%Y-%m') AS month, kind, amount_cents, 0 AS s FROM {P} WHERE status = 'SUCCEEDED' AND NOT is_demo UNION ALL SELECT strftime(created_at, '%Y-%m'), NULL, 0, 1 FROM {U} WHERE NOT is_demo AND NOT is_deleted AND created_at IS NOT NULL)
      SELECT coalesce(month, 'total') AS month, {i64('sum(s)')} AS signups, count(*) FILTER (WHERE kind = 'ONE_TIME_AUDIT') AS one_time_sales, count(*) FILTER (WHERE kind = 'SUBSCRIPTION') AS subscription_invoices,
      {i64("coalesce(sum(amount_cents) FILTER (WHERE kind = 'ONE_TIME_AUDIT'), 0)")} AS one_time_cents, {i64("coalesce(sum(amount_cents) FILTER (WHERE kind = 'SUBSCRIPTION'), 0)")} AS subscription_cents, {i64('sum(amount_cents)')} AS gross_cents FROM x GROUP BY ROLLUP (month)""",
    "m16_recurring_by_month": f"""WITH s AS (SELECT * FROM {S} WHERE NOT is_demo), ends AS (SELECT unnest(generate_series(date_trunc('month', (SELECT min(created_at) FROM s)), (SELECT max(created_at) FROM s), INTERVAL 1 MONTH)) AS m),
      held AS (SELECT m, user_id, arg_max(plan, (created_at, subscription_id)) AS plan, arg_max(status, (created_at, subscription_id)) AS status FROM ends JOIN s ON created_at < m + INTERVAL 1 MONTH GROUP BY ALL)
      SELECT strftime(m, '%Y-%m') AS month, count(*) FILTER (WHERE status IN ('ACTIVE', 'TRIALING')) AS active_subscriptions,
      {i64("coalesce(sum(CASE plan WHEN 'STARTER' THEN 2900 WHEN 'GROWTH' THEN 7900 WHEN 'AGENCY' THEN 19900 ELSE 0 END) FILTER (WHERE status IN ('ACTIVE', 'TRIALING')), 0)")} AS recurring_cents FROM held GROUP BY m""",
    "m17_demo_segregation": f"""WITH x AS (SELECT amount_cents, v.is_demo FROM {P} JOIN (SELECT user_id AS uid, is_demo FROM ({b.USERS_SQL}) AS u) AS v ON uid = user_id WHERE status = 'SUCCEEDED')
      SELECT 'with_demo' AS scope, count(*) AS payments, {i64('sum(amount_cents)')} AS revenue_cents FROM x UNION ALL SELECT 'without_demo', count(*), {i64('sum(amount_cents)')} FROM x WHERE NOT is_demo UNION ALL SELECT 'demo_only', count(*), {i64('sum(amount_cents)')} FROM x WHERE is_demo""",
    "m18_preview_run_stats": f"""SELECT CAST(created_at AS DATE) AS day, count(*) AS runs, count(*) FILTER (WHERE success) AS succeeded, {i64('floor(100.0 * count(*) FILTER (WHERE success) / count(*) + 0.5)')} AS success_rate,
      count(*) FILTER (WHERE error_code = 'TIMEOUT') AS timeouts, count(*) FILTER (WHERE error_code = 'BLOCKED') AS blocked, round(avg(score) FILTER (WHERE success), 4) AS average_score, round(avg(duration_ms), 4) AS average_ms, count(DISTINCT domain) AS domains
      FROM ({b.PREVIEW_RUNS_SQL}) AS r GROUP BY 1""",
    "m18_preview_domains": f"""WITH r AS (SELECT CAST(created_at AS DATE) AS day, domain FROM ({b.PREVIEW_RUNS_SQL}) AS p), d AS (SELECT DISTINCT day FROM r)
      SELECT d.day, count(DISTINCT domain) AS domains, true AS estimate_is_near FROM d JOIN r ON r.day BETWEEN d.day - 6 AND d.day GROUP BY d.day""",
    "l1_ledger_balance": f"WITH {_BAL} SELECT entry_id, user_id, CAST(balance AS BIGINT) AS balance FROM bal",
    "l2_ledger_reconcile": f"""WITH {_BAL}, tot AS (SELECT user_id, sum(delta) AS t FROM bal GROUP BY 1) SELECT 'entry' AS kind, entry_id AS id, {i64('balance + 1')} AS recorded, {i64('balance')} AS expected FROM bal WHERE entry_id % 97 = 0
      UNION ALL SELECT 'account', u.user_id, one_time_credits, {i64('coalesce(t, 0)')} FROM ({b.USERS_SQL}) AS u LEFT JOIN tot ON tot.user_id = u.user_id WHERE coalesce(t, 0) <> one_time_credits""",
    "l3_entitlements": f"WITH {_ENT} SELECT *, audits_remaining + one_time_credits AS total_available FROM ent2",
    "l4_audit_limits": f"WITH {_ENT} {LIMITS}",
    "l5_credit_replay": f"""WITH RECURSIVE lg AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, request_id) AS rn FROM ({b.CREDIT_LOG_SQL}) AS c),
      rep AS (SELECT user_id, 0 AS rn, CAST(0 AS BIGINT) AS request_id, '' AS action, '' AS outcome, CAST(0 AS BIGINT) AS bal, CAST(0 AS BIGINT) AS used FROM (SELECT DISTINCT user_id FROM lg) AS z
      UNION ALL SELECT l.user_id, l.rn, l.request_id, l.action, CASE WHEN l.action <> 'reserve' THEN upper(l.action) WHEN used < 2 THEN 'ALLOWANCE' WHEN bal >= 1 THEN 'CREDIT' ELSE 'REFUSED' END,
        CASE l.action WHEN 'grant' THEN bal + l.amount WHEN 'revoke' THEN bal - least(l.amount, bal) WHEN 'reserve' THEN CASE WHEN used < 2 THEN bal ELSE greatest(0, bal - 1) END ELSE bal END,
        CASE WHEN l.action = 'renew' THEN 0 WHEN l.action = 'reserve' THEN least(2, used + 1) ELSE used END FROM rep r JOIN lg l ON l.user_id = r.user_id AND l.rn = r.rn + 1)
      SELECT request_id, user_id, action, outcome, bal AS balance_after, used AS allowance_used FROM rep WHERE rn > 0""",
    "l5_credit_history": f"""WITH RECURSIVE lg AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, request_id) AS rn FROM ({b.CREDIT_HISTORY_SQL}) AS c),
      rep AS (SELECT user_id, 0 AS rn, CAST(0 AS BIGINT) AS request_id, '' AS action, '' AS outcome, CAST(0 AS BIGINT) AS bal, CAST(0 AS BIGINT) AS used, 'STARTER' AS plan, CAST([] AS BIGINT[]) AS on_plan, CAST([] AS BIGINT[]) AS on_credit FROM (SELECT DISTINCT user_id FROM lg) AS z
      UNION ALL SELECT user_id, rn, request_id, action, outcome, CASE outcome WHEN 'GRANT' THEN bal + amount WHEN 'REVOKE' THEN greatest(0, bal - amount) WHEN 'CREDIT' THEN bal - 1 WHEN 'CREDIT_BACK' THEN bal + 1 ELSE bal END,
        CASE outcome WHEN 'ALLOWANCE' THEN used + 1 WHEN 'ALLOWANCE_BACK' THEN greatest(0, used - 1) WHEN 'RENEW' THEN 0 WHEN 'PLAN_CHANGED' THEN 0 ELSE used END, CASE WHEN outcome = 'PLAN_CHANGED' THEN wanted ELSE plan END,
        CASE outcome WHEN 'ALLOWANCE' THEN list_append(on_plan, audit_id) WHEN 'ALLOWANCE_BACK' THEN list_filter(on_plan, lambda a: a <> audit_id) ELSE on_plan END,
        CASE outcome WHEN 'CREDIT' THEN list_append(on_credit, audit_id) WHEN 'CREDIT_BACK' THEN list_filter(on_credit, lambda a: a <> audit_id) ELSE on_credit END
        FROM (SELECT l.user_id, l.rn, l.request_id, l.action, l.amount, l.audit_id, l.plan AS wanted, r.bal, r.used, r.plan, r.on_plan, r.on_credit, CASE l.action
          WHEN 'reserve' THEN CASE WHEN r.used < CASE r.plan WHEN 'STARTER' THEN 3 WHEN 'GROWTH' THEN 15 WHEN 'AGENCY' THEN 60 ELSE 0 END THEN 'ALLOWANCE' WHEN r.bal >= 1 THEN 'CREDIT' ELSE 'REFUSED' END
          WHEN 'refund' THEN CASE WHEN list_contains(r.on_plan, l.audit_id) THEN 'ALLOWANCE_BACK' WHEN list_contains(r.on_credit, l.audit_id) THEN 'CREDIT_BACK' ELSE 'NOTHING' END
          WHEN 'plan' THEN CASE WHEN l.plan <> r.plan THEN 'PLAN_CHANGED' ELSE 'PLAN_KEPT' END ELSE upper(l.action) END AS outcome
          FROM rep r JOIN lg l ON l.user_id = r.user_id AND l.rn = r.rn + 1) AS y)
      SELECT request_id, user_id, action, plan, outcome, bal AS balance_after, used AS allowance_used FROM rep WHERE rn > 0""",
    "e1_event_sanitize": f"""WITH r AS (SELECT * FROM ({b.RAW_EVENTS_SQL}) AS x WHERE name IN {members(lx.ANALYTICS_EVENTS)}), je AS (SELECT event_id, props AS j FROM r WHERE json_valid(props)), kv AS ({_KEYS}),
      pr AS (SELECT event_id, string_agg(k || '=' || CASE WHEN t = 'VARCHAR' THEN v[:120] ELSE v END, '|' ORDER BY k || '=' || v) AS properties FROM kv WHERE t IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') GROUP BY 1)
      SELECT r.event_id, name, user_id, session_key[:64] AS session_key, path[:200] AS path, coalesce(properties, '') AS properties FROM r LEFT JOIN pr USING (event_id)""",
    "e2_event_dedupe": f"SELECT event_id, min(delivery_id) AS delivery_id, arg_min(type, delivery_id) AS type, count(*) - 1 AS duplicates FROM {W} GROUP BY 1",
    "e2_credit_grants": f"WITH {FIRST} SELECT session_ref, min(delivery_id) AS granted_by, count(*) AS events FROM fd WHERE type = 'checkout.session.completed' AND payment_status = 'paid' GROUP BY 1",
    "e3_event_route": f"WITH {FIRST} SELECT CASE WHEN type IN {members(lx.PAYMENT_EVENT_TYPES)} THEN type ELSE 'none' END AS handler, CASE WHEN type IN {members(lx.PAYMENT_EVENT_TYPES)} THEN 'PROCESSED' ELSE 'IGNORED' END AS status, count(*) AS events FROM fd GROUP BY ALL",
    "e4_resolve_user": f"""WITH u AS (SELECT * FROM {U}) SELECT delivery_id, coalesce(a.user_id, c.user_id, d.user_id) AS user_id, CASE WHEN a.user_id IS NOT NULL THEN 'metadata' WHEN c.user_id IS NOT NULL THEN 'client' WHEN d.user_id IS NOT NULL THEN 'customer' ELSE 'none' END AS matched_by
      FROM ({b.WEBHOOKS_SQL}) AS w LEFT JOIN u a ON CAST(a.user_id AS VARCHAR) = metadata_user LEFT JOIN u c ON CAST(c.user_id AS VARCHAR) = client_reference LEFT JOIN u d ON d.customer_ref = w.customer_ref""",
    "e5_subscription_state": f"""WITH {FIRST}, s AS (SELECT * FROM fd WHERE type IN ('customer.subscription.updated', 'customer.subscription.deleted', 'invoice.paid', 'invoice.payment_failed')),
      al AS (SELECT s.* FROM s JOIN (SELECT subscription_ref, min(delivery_id) AS born FROM s WHERE {_UPD} GROUP BY 1) AS o USING (subscription_ref) WHERE delivery_id >= born),
      h AS (SELECT *, last_value(CASE WHEN {_UPD} THEN plan END IGNORE NULLS) OVER w AS pb, last_value(CASE WHEN {_UPD} OR {_PAID} THEN period END IGNORE NULLS) OVER w AS qb FROM al WINDOW w AS (PARTITION BY subscription_ref ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT subscription_ref, arg_max(plan, delivery_id) FILTER (WHERE {_UPD}) AS plan, arg_max(CASE WHEN {_UPD} THEN {_STAT} WHEN {_PAID} THEN 'ACTIVE' WHEN type = 'invoice.payment_failed' THEN 'PAST_DUE' ELSE 'CANCELED' END, delivery_id) AS status,
      arg_max(period, delivery_id) FILTER (WHERE {_UPD} OR {_PAID}) AS period, count(*) FILTER (WHERE ({_UPD} AND pb <> plan) OR ({_PAID} AND period > qb)) AS usage_resets, count(*) AS events FROM h GROUP BY 1""",
    "e6_payment_upsert": f"""WITH {FIRST}, p AS (SELECT delivery_id, amount_cents, created_at, CASE WHEN type LIKE 'invoice%' THEN invoice_ref ELSE session_ref END AS payment_ref, CASE WHEN type LIKE 'invoice%' THEN 'SUBSCRIPTION' ELSE 'ONE_TIME_AUDIT' END AS kind,
        CASE WHEN type = 'invoice.paid' OR (type LIKE 'checkout%' AND payment_status = 'paid') THEN 'SUCCEEDED' WHEN type = 'invoice.payment_failed' THEN 'FAILED' ELSE 'PENDING' END AS status
        FROM fd WHERE type IN ('checkout.session.completed', 'invoice.paid', 'invoice.payment_failed'))
      SELECT payment_ref, arg_max(kind, delivery_id) AS kind, arg_max(status, delivery_id) AS status, arg_max(amount_cents, delivery_id) AS amount_cents,
        CASE WHEN arg_max(status, delivery_id) = 'SUCCEEDED' THEN arg_max(created_at, delivery_id) END AS paid_at, count(*) AS updates FROM p GROUP BY 1""",
    "e7_rate_limit": """WITH RECURSIVE lg AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      rep AS (SELECT user_id, 0 AS rn, CAST(0 AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS st, false AS allowed, CAST(0 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS retry_after FROM (SELECT DISTINCT user_id FROM lg) AS z
      UNION ALL SELECT user_id, rn, event_id, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3, CASE WHEN len(live) < 3 THEN 2 - len(live) ELSE 0 END,
        CASE WHEN len(live) < 3 THEN 0 ELSE greatest(1, CAST(ceil((live[1] + 86400000000 - t) / 1000000.0) AS BIGINT)) END
        FROM (SELECT l.user_id, l.rn, l.event_id, l.t, list_filter(r.st, lambda x: x >= l.t - 86400000000) AS live FROM rep r JOIN lg l ON l.user_id = r.user_id AND l.rn = r.rn + 1) AS y)
      SELECT event_id, user_id, allowed, remaining, retry_after FROM rep WHERE rn > 0""",
    "e7_rate_limit_rules": f"""WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('auth:signin', 8, 900), ('auth:signup', 10, 3600), ('auth:reset-request', 5, 3600), ('auth:reset-confirm', 10, 3600),
        ('contact:submit', 5, 3600), ('preview:run', 6, 3600), ('audit:create', 30, 3600), ('report:download', 60, 3600)) AS v(bucket, most, secs)),
      tries AS (SELECT event_id, bucket, sha256('pepper:id:' || lower(bucket || ':' || identifier)) AS h, epoch_us(ts) AS t FROM ({b.ATTEMPTS_SQL}) AS a),
      lg AS (SELECT tries.*, most, secs, row_number() OVER (PARTITION BY h ORDER BY t, event_id) AS rn FROM tries JOIN rules USING (bucket)),
      rep AS (SELECT h, 0 AS rn, CAST(0 AS BIGINT) AS event_id, '' AS bucket, CAST([] AS BIGINT[]) AS st, false AS allowed, CAST(0 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS retry_after FROM (SELECT DISTINCT h FROM lg) AS z
      UNION ALL SELECT h, rn, event_id, bucket, CASE WHEN len(live) < most THEN list_append(live, t) ELSE live END, len(live) < most, CASE WHEN len(live) < most THEN most - 1 - len(live) ELSE 0 END,
        CASE WHEN len(live) < most THEN 0 ELSE greatest(1, CAST(ceil((live[1] + secs * 1000000 - t) / 1000000.0) AS BIGINT)) END
        FROM (SELECT l.h, l.rn, l.event_id, l.bucket, l.t, l.most, CAST(l.secs AS BIGINT) AS secs, list_filter(r.st, lambda x: x >= l.t - CAST(l.secs AS BIGINT) * 1000000) AS live FROM rep r JOIN lg l ON l.h = r.h AND l.rn = r.rn + 1) AS y)
      SELECT event_id, bucket, h AS identifier_hash, allowed, remaining, retry_after FROM rep WHERE rn > 0 UNION ALL SELECT event_id, bucket, h, true, NULL, 0 FROM tries WHERE bucket = 'search:run'""",
    "e8_rate_limit_usage": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS attempts FROM events",
    "e9_event_retention": f"SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '{b.AS_OF_EVENTS}' - INTERVAL 240 HOURS) AS kept, count(*) FILTER (WHERE ts < TIMESTAMP '{b.AS_OF_EVENTS}' - INTERVAL 240 HOURS) AS dropped FROM events GROUP BY 1",
    "e10_hash_identifier": "SELECT c_custkey, c_name, sha256('pepper:id:' || lower(trim(c_name))) AS identifier_hash FROM customer",
    "e11_daily_event_window": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events FROM events GROUP BY ALL",
}

SQL["e11_stream_daily_counts"] = SQL["e11_daily_event_window"]
SQL["e7_stream_rate_limit"] = SQL["e7_rate_limit"]
SQL |= {f"{e}_stream_{name}": SQL[f"{e}_{name}"] for e, name in (("e2", "event_dedupe"), ("e2", "credit_grants"), ("e4", "resolve_user"), ("e5", "subscription_state"), ("e6", "payment_upsert"))}
