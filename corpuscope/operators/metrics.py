"""Business figures: one scan per table with conditional aggregates."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuscope.functions import lexicon as lx
from corpuscope.functions.sqltext import listed, q
from corpuscope.operators.joins import lookup
from corpuscope.operators.running import running


def without_demo(rows: DataFrame, include_demo: bool = False) -> DataFrame:
    """Rows of real users.  The column is required: a table without it can't be told apart."""
    return rows if include_demo else rows.where("NOT is_demo")


def _long(row: DataFrame) -> DataFrame:
    """One wide row as (metric, value) rows."""
    pairs = ", ".join(f"{q(c)}, CAST({c} AS BIGINT)" for c in row.columns)
    return row.selectExpr(f"stack({len(row.columns)}, {pairs}) AS (metric, value)")


def overview_counts(users: DataFrame, audits: DataFrame, contacts: DataFrame, as_of: str, include_demo: bool = False, subscriptions: DataFrame | None = None) -> DataFrame:
    recent = f"created_at >= TIMESTAMP '{as_of}' - INTERVAL 30 DAYS"
    people = without_demo(users, include_demo).where("NOT is_deleted").agg(
        F.count("*").alias("users_total"), F.expr("count_if(status = 'ACTIVE')").alias("users_active"),
        F.expr("count_if(status = 'SUSPENDED')").alias("users_suspended"), F.expr(f"count_if({recent})").alias("users_new"),
    )
    work = without_demo(audits, include_demo).where("NOT is_deleted").agg(
        F.count("*").alias("audits_total"),
        *[F.expr(f"count_if(status = '{s}')").alias(f"audits_{s.lower()}") for s in ("COMPLETED", "RUNNING", "QUEUED", "FAILED")],
        F.expr("floor(avg(CASE WHEN status = 'COMPLETED' THEN overall_score END) + 0.5)").alias("audits_average_score"),
    )
    mail = without_demo(contacts, include_demo).agg(F.count("*").alias("contacts_total"), F.expr("count_if(unread)").alias("contacts_unread"))
    counts = _long(people).unionByName(_long(work)).unionByName(_long(mail))
    if subscriptions is None:
        return counts
    live = without_demo(subscriptions, include_demo).agg(F.count_if(F.col("status").isin(*lx.MRR_STATUSES)).alias("subscriptions_active"))
    return counts.unionByName(_long(live))


def revenue_split(payments: DataFrame, as_of: str, include_demo: bool = False) -> DataFrame:
    paid = "status = 'SUCCEEDED'"

    def total(test):
        return F.expr(f"coalesce(sum(CASE WHEN {test} THEN amount_cents END), 0L)")

    return without_demo(payments, include_demo).agg(
        total(paid).alias("gross_cents"), total(f"{paid} AND kind = 'ONE_TIME_AUDIT'").alias("one_time_cents"),
        total(f"{paid} AND kind = 'SUBSCRIPTION'").alias("subscription_cents"),
        total(f"{paid} AND paid_at >= TIMESTAMP '{as_of}' - INTERVAL 30 DAYS").alias("last_30_days_cents"),
        F.expr("coalesce(sum(refunded_cents), 0L)").alias("refunded_cents"),
        F.expr(f"count_if({paid} AND kind = 'ONE_TIME_AUDIT')").alias("purchases"),
    )


#: List price of a plan in cents.
PRICE = "CASE plan " + " ".join(f"WHEN {q(p[0])} THEN {p[1]}" for p in lx.PLANS) + " ELSE 0 END"


def mrr(subscriptions: DataFrame, include_demo: bool = False) -> DataFrame:
    """Recurring revenue at list price (a constant of four plans)."""
    price = PRICE
    return (
        without_demo(subscriptions, include_demo).where(F.col("status").isin(*lx.MRR_STATUSES)).groupBy("plan").agg(F.count("*").alias("subscriptions"))
        .selectExpr("plan", "subscriptions", f"{price} AS price_cents", f"subscriptions * {price} AS mrr_cents")
    )


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every UTC day of a window; its length is the window's, not the data's."""
    return spark.range(1).selectExpr(f"explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS day")


def daily_series(payments: DataFrame, users: DataFrame, audits: DataFrame, start: str, end: str, include_demo: bool = False) -> DataFrame:
    def per_day(rows, at, value, name):
        inside = f"{at} >= TIMESTAMP '{start} 00:00:00' AND {at} < TIMESTAMP '{end} 00:00:00' + INTERVAL 1 DAY"
        return rows.where(inside).groupBy(F.to_date(at).alias("day")).agg(value.alias(name))

    revenue = per_day(without_demo(payments, include_demo).where("status = 'SUCCEEDED'"), "paid_at", F.sum("amount_cents"), "revenue_cents")
    signups = per_day(without_demo(users, include_demo).where("NOT is_deleted"), "created_at", F.count("*"), "signups")
    started = per_day(without_demo(audits, include_demo).where("NOT is_deleted"), "created_at", F.count("*"), "audits")
    out = days(payments.sparkSession, start, end)
    for part in (revenue, signups, started):
        out = out.join(part, "day", "left")
    return out.fillna(0, ["revenue_cents", "signups", "audits"])


def series_totals(series: DataFrame, as_of: str, window: int) -> DataFrame:
    return series.where(f"day >= DATE '{as_of[:10]}' - INTERVAL {window} DAYS").agg(
        *[F.expr(f"coalesce(sum({c}), 0L)").alias(c) for c in ("revenue_cents", "signups", "audits")]
    )


def funnel_counts(events: DataFrame, since: str | None = None, until: str | None = None, include_demo: bool = False) -> DataFrame:
    rows = without_demo(events, include_demo)
    if since:
        rows = rows.where(f"created_at >= TIMESTAMP '{since}'")
    if until:
        rows = rows.where(f"created_at <= TIMESTAMP '{until}'")
    return rows.agg(*[F.expr(f"count_if(name = '{n}')").alias(n) for n in lx.FUNNEL_COUNTS])


def funnel_conversion(counts: DataFrame) -> DataFrame:
    """Steps in order with the share of the step before, null when that one is empty."""
    steps = ", ".join(f"named_struct('step', {q(n)}, 'value', {n})" for n in lx.FUNNEL_STEPS)
    rate = "CASE WHEN pos > 0 AND s[pos - 1].value > 0 THEN CAST(floor(100D * s[pos].value / s[pos - 1].value + 0.5) AS BIGINT) END"
    return counts.selectExpr(f"array({steps}) AS s").selectExpr("s", "posexplode(s) AS (pos, x)").selectExpr(
        "pos", "x.step AS step", "x.value AS value", f"{rate.replace('s[pos - 1]', 'get(s, pos - 1)')} AS rate"
    )


def top_events(events: DataFrame, since: str) -> DataFrame:
    return (
        without_demo(events).where(f"created_at >= TIMESTAMP '{since}'").groupBy("name").agg(F.count("*").alias("events"))
        .orderBy(F.desc("events"), "name")
    )


def job_health(jobs: DataFrame, include_demo: bool = False) -> DataFrame:
    jobs = without_demo(jobs, include_demo)
    counts = jobs.agg(*[F.expr(f"count_if(status = '{s}')").alias(s) for s in ("QUEUED", "RUNNING", "FAILED", "COMPLETED")],
                      F.expr("min(CASE WHEN status = 'QUEUED' THEN created_at END)").alias("oldest"))
    totals = counts.selectExpr(
        "stack(4, " + ", ".join(f"'{s}', {s}" for s in ("QUEUED", "RUNNING", "FAILED", "COMPLETED")) + ") AS (item, n)", "oldest"
    ).selectExpr("item", "n", "CASE WHEN item = 'QUEUED' THEN oldest END AS at")
    latest = jobs.where("status = 'FAILED'").orderBy(F.desc("created_at"), F.desc("audit_id")).limit(5)
    return totals.unionByName(latest.selectExpr("concat('failure ', audit_id) AS item", "1L AS n", "created_at AS at"))


def search_listing(users: DataFrame, text: str, status: str | None, offset: int, limit: int) -> DataFrame:
    """One page of matching users and the number of all matches."""
    needle = q(f"%{text}%")
    rows = without_demo(users).where("NOT is_deleted").where(f"name ILIKE {needle} OR email ILIKE {needle}")
    if status:
        rows = rows.where(F.col("status") == status)
    total = rows.agg(F.count("*")).scalar()
    page = rows.orderBy(F.desc_nulls_last("created_at"), "user_id").offset(offset).limit(limit)
    return page.select("user_id", "name", "email", "status", "created_at", total.alias("total"))


def listing_with_parent(payments: DataFrame, users: DataFrame, audits: DataFrame) -> DataFrame:
    """Every payment with its user and the user's numbers of audits and payments."""
    per_user = payments.groupBy("user_id").agg(F.count("*").alias("user_payments"))
    audited = audits.where("NOT is_deleted").groupBy("user_id").agg(F.count("*").alias("user_audits"))
    dim = users.select("user_id", "name", "email").join(per_user, "user_id", "left").join(audited, "user_id", "left")
    return lookup(payments, dim, ["user_id"], "payment_id").selectExpr(
        "payment_id", "user_id", "name", "email", "kind", "status", "amount_cents",
        "coalesce(user_payments, 0L) AS user_payments", "coalesce(user_audits, 0L) AS user_audits",
    )


def recent_per_user(rows: DataFrame, at: str, tie: str, limit: int = 20) -> DataFrame:
    """Latest rows per user; Spark limits each group before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def open_actions(recommended: DataFrame, audits: DataFrame, limit: int = 5) -> DataFrame:
    """First fixes of each user over the live completed audits, newest audit first."""
    live = audits.where("status = 'COMPLETED' AND NOT is_archived AND NOT is_deleted")
    rows = recommended.where("horizon = 'DO_FIRST'").join(live, "site_key")
    w = Window.partitionBy("user_id").orderBy(F.desc("completed_at"), F.desc("site_key"), "priority")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        "user_id", "rank", "site_key", "priority", "check_id", "impact", "effort"
    )


def status_counts(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """Count per status, 0 for the absent ones."""
    wide = rows.agg(*[F.expr(f"count_if(status = '{s}')").alias(s) for s in statuses])
    return wide.selectExpr(f"stack({len(statuses)}, " + ", ".join(f"'{s}', {s}" for s in statuses) + ") AS (status, n)")


SNAPSHOT = {
    "signups": "event_type = 'signup'", "one_time_sales": "event_type = 'purchase'", "audits_created": "event_type = 'click'",
    "audits_completed": "event_type = 'view'", "demo_runs": "event_type = 'error'", "preview_runs": "event_type IN ('view', 'click')",
}


def daily_snapshot(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        *[F.expr(f"count_if({t})").alias(n) for n, t in SNAPSHOT.items()],
        F.expr("coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END), 0L)").alias("revenue_cents"),
    )


def snapshot_totals(snapshot: DataFrame, start: str, end: str) -> DataFrame:
    inside = snapshot.where(f"day BETWEEN DATE '{start}' AND DATE '{end}'")
    return inside.agg(F.count("*").alias("days"), *[F.sum(c).alias(c) for c in (*SNAPSHOT, "revenue_cents")])


def month_rollup(payments: DataFrame, users: DataFrame, include_demo: bool = False) -> DataFrame:
    """Per month and in total: new users, payments and revenue by kind."""
    paid = without_demo(payments, include_demo).where("status = 'SUCCEEDED'").selectExpr(
        "date_format(paid_at, 'yyyy-MM') AS month", "kind", "amount_cents", "0 AS signup")
    joined = without_demo(users, include_demo).where("NOT is_deleted AND created_at IS NOT NULL").selectExpr(
        "date_format(created_at, 'yyyy-MM') AS month", "CAST(NULL AS STRING) AS kind", "0L AS amount_cents", "1 AS signup")

    def of(kind, what):
        return F.expr(f"coalesce(sum(CASE WHEN kind = '{kind}' THEN {what} END), 0L)")

    return paid.unionByName(joined).rollup("month").agg(
        F.sum("signup").alias("signups"), of("ONE_TIME_AUDIT", "1L").alias("one_time_sales"),
        of("SUBSCRIPTION", "1L").alias("subscription_invoices"), of("ONE_TIME_AUDIT", "amount_cents").alias("one_time_cents"),
        of("SUBSCRIPTION", "amount_cents").alias("subscription_cents"), F.sum("amount_cents").alias("gross_cents"),
    ).withColumn("month", F.coalesce("month", F.lit("total")))


def recurring_by_month(history: DataFrame, include_demo: bool = False) -> DataFrame:
    """Subscriptions in force and their list price at the end of every month from the first to the last change.

    ``history`` holds the states (plan, status) that each user's subscription took on at ``created_at``; a
    state holds until the user's next one.  Each change moves the figures by its difference from the
    state before, and the moves add up month by month, so no state is joined to the months it spans.
    The last step runs in one task over a row for each month.  Rows without user or time, and an
    unknown plan or status, add nothing."""
    live = f"CASE WHEN status IN {listed(lx.MRR_STATUSES)} THEN 1L ELSE 0L END"
    states = without_demo(history, include_demo).where("user_id IS NOT NULL AND created_at IS NOT NULL").selectExpr(
        "user_id", "created_at", "subscription_id", f"{live} AS live", f"CAST({live} * {PRICE} AS BIGINT) AS price")
    steps = running(states, ["user_id"], ["created_at", "subscription_id"], {
        "live_before": ("last", F.col("live"), "before"), "price_before": ("last", F.col("price"), "before")}, F.date_trunc("month", "created_at"))
    moves = steps.groupBy(F.trunc("created_at", "month").alias("month")).agg(
        F.expr("sum(live - coalesce(live_before, 0L))").alias("live"), F.expr("sum(price - coalesce(price_before, 0L))").alias("price"))
    months = moves.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a IS NOT NULL").selectExpr("explode(sequence(a, b, INTERVAL 1 MONTH)) AS month")
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return months.join(moves, "month", "left").select(
        F.date_format("month", "yyyy-MM").alias("month"), F.coalesce(F.sum("live").over(so_far), F.lit(0)).alias("active_subscriptions"),
        F.coalesce(F.sum("price").over(so_far), F.lit(0)).alias("recurring_cents"))


def demo_segregation(payments: DataFrame, users: DataFrame) -> DataFrame:
    """Revenue and payments with and without demonstration users."""
    flagged = lookup(payments.drop("is_demo").where("status = 'SUCCEEDED'"), users.select("user_id", "is_demo"), ["user_id"], "payment_id")
    wide = flagged.agg(
        F.expr("count(*)").alias("all_n"), F.expr("sum(amount_cents)").alias("all_c"),
        F.expr("count_if(NOT is_demo)").alias("real_n"), F.expr("sum(CASE WHEN NOT is_demo THEN amount_cents END)").alias("real_c"),
    )
    return wide.selectExpr(
        "stack(3, 'with_demo', all_n, all_c, 'without_demo', real_n, real_c, 'demo_only', all_n - real_n, all_c - real_c)"
        " AS (scope, payments, revenue_cents)")


def preview_run_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("runs"), F.expr("count_if(success)").alias("succeeded"),
        F.expr("floor(100D * count_if(success) / count(*) + 0.5)").cast("bigint").alias("success_rate"),
        F.expr("count_if(error_code = 'TIMEOUT')").alias("timeouts"), F.expr("count_if(error_code = 'BLOCKED')").alias("blocked"),
        F.expr("round(avg(CASE WHEN success THEN score END), 4)").alias("average_score"),
        F.expr("round(avg(duration_ms), 4)").alias("average_ms"), F.count_distinct("domain").alias("domains"),
    )


def domain_sketches(runs: DataFrame, precision: int = 12) -> DataFrame:
    """A mergeable sketch of the distinct domains of each day: at most a few kilobytes, however many runs.

    The relative standard error is about 1.04 / sqrt(2 ** precision).  Null domains count as none."""
    return runs.where("created_at IS NOT NULL").groupBy(F.to_date("created_at").alias("day")).agg(F.hll_sketch_agg("domain", precision).alias("sketch"))


def domains_in_windows(sketches: DataFrame, days: int) -> DataFrame:
    """Estimated distinct domains of the ``days`` days up to each day that has a sketch, from the sketches alone."""
    shown = sketches.selectExpr("day AS of_day", "sketch", f"explode(sequence(day, date_add(day, {days - 1}))) AS day")
    merged = shown.groupBy("day").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimated_domains"), F.max("of_day").alias("last"))
    return merged.where("day = last").drop("last")


def exact_domains_in_windows(runs: DataFrame, days: int) -> DataFrame:
    """The same counts exactly; every pair of day and domain is shown to each window that holds it."""
    pairs = runs.where("created_at IS NOT NULL").select(F.to_date("created_at").alias("of_day"), "domain").distinct()
    shown = pairs.selectExpr("of_day", "domain", f"explode(sequence(of_day, date_add(of_day, {days - 1}))) AS day")
    once = shown.groupBy("day", "domain").agg(F.max("of_day").alias("last"))
    return once.groupBy("day").agg(F.count("domain").alias("domains"), F.max("last").alias("last")).where("day = last").drop("last")
