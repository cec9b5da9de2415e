"""Entitlements and limits of a user's plan."""

from corpuscope.functions import lexicon as lx
from corpuscope.sources import bindings as b
from oracles.fragments import members


def plan_value(field):
    return "CASE plan " + " ".join(f"WHEN '{p[0]}' THEN {p[field]}" for p in lx.PLANS) + " END"


ENTITLED = f"""ent AS (SELECT t.user_id, coalesce(s.plan, 'FREE') AS plan, s.plan IS NOT NULL AS subscription_active, coalesce(s.audits_used, 0) AS audits_used, one_time_credits FROM ({b.USERS_SQL}) AS t
  LEFT JOIN (SELECT * FROM ({b.SUBSCRIPTIONS_SQL}) AS q WHERE status IN {members(lx.ENTITLED_STATUSES)} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, subscription_id DESC) = 1) AS s ON s.user_id = t.user_id),
ent2 AS (SELECT *, greatest(0, CASE WHEN subscription_active THEN {plan_value(2)} ELSE 0 END - audits_used) AS audits_remaining FROM ent)"""
LIMITS = f"SELECT user_id, plan, audits_remaining + one_time_credits > 0 AS can_create, CASE WHEN audits_remaining > 0 THEN {plan_value(3)} ELSE greatest(10, {plan_value(3)}) END AS page_limit, CASE WHEN audits_remaining > 0 THEN {plan_value(4)} ELSE greatest(1, {plan_value(4)}) END AS competitor_limit FROM ent2"
SITES = f"""{ENTITLED},
sites AS (SELECT s.*, coalesce(l.page_limit, 1) AS page_limit, coalesce(l.competitor_limit, 0) AS competitor_limit
  FROM ({b.SITES_SQL}) AS s LEFT JOIN ({LIMITS}) AS l ON l.user_id = s.owner_id)"""
