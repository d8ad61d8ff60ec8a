"""Dashboards over contributions, users and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexvigil import bridge
from hexvigil.operators import activity as act
from hexvigil.operators import activity_bitmaps as bits
from hexvigil.session import scratch_path
from hexvigil.plans.registry import R, query, rounded

NOW = "2024-01-31 00:00:00"
CONTRIB_NOW = "1999-07-01 00:00:00"

CONTRIB_SQL = """SELECT 'eval' AS contrib_type, s_name AS vendor, l_shipdate AS received_at FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 UNION ALL SELECT 'attack_map', NULL, o_orderdate FROM orders UNION ALL SELECT 'ioc_bundle', NULL, ts FROM events"""


def contributions(spark, sf):
    """All three record kinds in one frame: evaluations, attack maps, indicator bundles."""
    ev = bridge.evals(spark, sf, "vendor", "received_at").withColumn("contrib_type", F.lit("eval"))
    am = bridge.incidents(spark, sf, "received_at").withColumn("contrib_type", F.lit("attack_map"))
    io = bridge.table(spark, sf, "events").select(F.col("ts").alias("received_at")).withColumn(
        "contrib_type", F.lit("ioc_bundle")
    )
    return ev.unionByName(am, allowMissingColumns=True).unionByName(io, allowMissingColumns=True)


@query("a23_ioc_types", "SELECT ioc_type, count(*) AS count FROM bundle_ioc GROUP BY ioc_type", ("bundle_ioc",))
def ioc_types(spark, sf):
    return act.type_distribution(bridge.bundle_ioc(spark, sf))


@query(
    "a24_contribution_stats",
    f"""SELECT coalesce(contrib_type, 'all') AS contrib_type, count(*) AS contributions, count(DISTINCT vendor) AS unique_vendors FROM ({CONTRIB_SQL}) GROUP BY ROLLUP (contrib_type)""",
)
def contribution_stats(spark, sf):
    return act.contribution_stats(contributions(spark, sf))


@query(
    "a24_source_counts",
    "SELECT coalesce(source, 'all') AS source, count(*) AS items FROM documents GROUP BY ROLLUP (source)",
)
def source_counts(spark, sf):
    return act.source_counts(bridge.table(spark, sf, "documents").select("source"))


@query(
    "a25_daily_by_type",
    f"""SELECT CAST(received_at AS DATE) AS day, contrib_type, count(*) AS count FROM ({CONTRIB_SQL})
 WHERE received_at >= TIMESTAMP '{CONTRIB_NOW}' - INTERVAL 90 DAY AND received_at < TIMESTAMP '{CONTRIB_NOW}' GROUP BY 1, 2""",
)
def daily_by_type(spark, sf):
    df = contributions(spark, sf).select("received_at", "contrib_type")
    return act.daily_counts(df, "received_at", CONTRIB_NOW, 90, ("contrib_type",))


@query(
    "a25_daily_requests",
    f"""SELECT CAST(ts AS DATE) AS day, count(*) AS count FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND ts < TIMESTAMP '{NOW}' GROUP BY 1""",
)
def daily_requests(spark, sf):
    return act.daily_counts(bridge.request_log(spark, sf), "ts", NOW, 30)


@query(
    "a25_daily_users",
    f"""SELECT CAST(created_at AS DATE) AS day, count(*) AS count FROM members WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND created_at < TIMESTAMP '{NOW}' GROUP BY 1""",
    ("members",),
)
def daily_users(spark, sf):
    return act.daily_counts(bridge.members(spark, sf), "created_at", NOW, 90)


@query("a26_industry_distribution", "SELECT industry AS value, count(*) AS count FROM evals GROUP BY 1", ("evals",))
def industry_distribution(spark, sf):
    return act.distribution(bridge.evals(spark, sf, "industry"), "industry")


@query(
    "a28_user_activity",
    f"""SELECT count(*) AS total_users, count(*) FILTER (last_used >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS active_last_30d,
 count(*) - count(*) FILTER (last_used >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS inactive, count(*) FILTER (request_count = 0) AS requests_0,
 count(*) FILTER (request_count BETWEEN 1 AND 10) AS requests_1_10, count(*) FILTER (request_count BETWEEN 11 AND 100) AS requests_11_100,
 count(*) FILTER (request_count BETWEEN 101 AND 1000) AS requests_101_1000, count(*) FILTER (request_count > 1000) AS requests_over_1000 FROM members""",
    ("members",),
)
def user_activity(spark, sf):
    return act.user_activity(bridge.members(spark, sf), NOW)


@query("a28_tier_distribution", "SELECT tier, count(*) AS count FROM members GROUP BY tier", ("members",))
def tier_distribution(spark, sf):
    return act.tier_distribution(bridge.members(spark, sf))


@query(
    "a29_invite_metrics",
    f"""SELECT count(*) AS total_users, count(*) FILTER (invite_count > 0) AS inviters, {R('100.0 * count(*) FILTER (invite_count > 0) / count(*)')} AS inviter_pct,
 CAST(sum(invite_count) AS BIGINT) AS total_invited, count(invited_by) AS invited_users, {R('sum(invite_count) / count(*)')} AS viral_coefficient FROM members""",
    ("members",),
)
def invite_metrics(spark, sf):
    return rounded(act.invite_metrics(bridge.members(spark, sf)), "inviter_pct", "viral_coefficient")


HEALTH_SQL = f"""SELECT *, {R('CASE WHEN last_week > 0 THEN 100.0 * (this_week - last_week) / last_week WHEN this_week > 0 THEN 100 ELSE 0 END')} AS velocity_pct,
 {R('total_contributions / total_users')} AS supply_demand_ratio FROM (SELECT count(*) AS total_contributions,
 count(*) FILTER (received_at >= TIMESTAMP '{CONTRIB_NOW}' - INTERVAL 7 DAY) AS this_week,
 count(*) FILTER (received_at >= TIMESTAMP '{CONTRIB_NOW}' - INTERVAL 14 DAY AND received_at < TIMESTAMP '{CONTRIB_NOW}' - INTERVAL 7 DAY) AS last_week,
 count(DISTINCT industry) AS unique_industries, count(DISTINCT category) AS unique_categories, (SELECT count(*) FROM members) AS total_users
 FROM evals WHERE received_at < TIMESTAMP '{CONTRIB_NOW}')"""


@query("a30_network_health", HEALTH_SQL, ("evals", "members"))
def network_health(spark, sf):
    ev = bridge.evals(spark, sf, "received_at", "industry", "category")
    out = act.network_health(ev, bridge.members(spark, sf), CONTRIB_NOW)
    return rounded(out, "velocity_pct", "supply_demand_ratio")


@query(
    "a30_public_health",
    f"SELECT total_contributions, velocity_pct, this_week, unique_industries, unique_categories, total_users FROM ({HEALTH_SQL})",
    ("evals", "members"),
)
def public_health(spark, sf):
    return act.public_health(network_health(spark, sf))


@query(
    "a31_engagement_funnel",
    """SELECT (SELECT count(*) FROM members) AS registered, (SELECT count(*) FROM members WHERE verified) AS verified,
 (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS contributed,
 (SELECT count(DISTINCT user_id) FROM request_log WHERE endpoint LIKE '/query%') AS queried,
 (SELECT count(*) FROM (SELECT user_id FROM request_log GROUP BY user_id HAVING count(DISTINCT CAST(ts AS DATE)) > 1)) AS returned""",
    ("members", "request_log"),
)
def engagement_funnel(spark, sf):
    return act.engagement_funnel(
        bridge.members(spark, sf), bridge.evals(spark, sf, "submitter"), bridge.request_log(spark, sf)
    )


@query(
    "a32_retention_cohorts",
    f"""WITH c AS (SELECT user_id, CAST(created_at AS DATE) AS d, CAST(date_trunc('week', created_at) AS DATE) AS week FROM members WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 56 DAY),
 u AS (SELECT c.user_id, week, max(CASE WHEN date_diff('day', d, CAST(ts AS DATE)) BETWEEN 7 AND 13 THEN 1 ELSE 0 END) AS w1,
 max(CASE WHEN date_diff('day', d, CAST(ts AS DATE)) BETWEEN 14 AND 20 THEN 1 ELSE 0 END) AS w2, max(CASE WHEN date_diff('day', d, CAST(ts AS DATE)) BETWEEN 28 AND 34 THEN 1 ELSE 0 END) AS w4
 FROM c LEFT JOIN request_log r ON r.user_id = c.user_id GROUP BY 1, 2)
 SELECT week, count(*) AS size, CAST(sum(w1) AS BIGINT) AS retained_1w, CAST(sum(w2) AS BIGINT) AS retained_2w, CAST(sum(w4) AS BIGINT) AS retained_4w FROM u GROUP BY week""",
    ("members", "request_log"),
)
def retention_cohorts(spark, sf):
    return act.retention_cohorts(bridge.members(spark, sf), bridge.request_log(spark, sf), NOW)


def stored_days(spark, sf):
    """The request log as stored day bitmaps, read back."""
    path = scratch_path(spark, "days")
    bits.store_days(bits.day_bitmaps(bridge.request_log(spark, sf), "user_id", "ts", {"queried": F.col("endpoint").startswith("/query")}), path)
    return spark.read.parquet(path)


@query(
    "a31_funnel_from_bitmaps",
    """SELECT (SELECT count(*) FROM members) AS registered, (SELECT count(*) FROM members WHERE verified) AS verified,
 (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS contributed,
 (SELECT count(DISTINCT user_id) FROM request_log WHERE endpoint LIKE '/query%') AS queried,
 (SELECT count(*) FROM (SELECT user_id FROM request_log GROUP BY user_id HAVING count(DISTINCT CAST(ts AS DATE)) > 1)) AS returned""",
    ("members", "request_log"),
)
def funnel_from_bitmaps(spark, sf):
    return bits.funnel(stored_days(spark, sf), bridge.members(spark, sf), bridge.evals(spark, sf, "submitter"))


@query(
    "a28_active_by_window",
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM request_log), e AS (SELECT DISTINCT day FROM d)
 SELECT e.day, count(DISTINCT d.user_id) FILTER (d.day = e.day) AS daily, count(DISTINCT d.user_id) FILTER (d.day > e.day - 7) AS weekly, count(DISTINCT d.user_id) AS monthly
 FROM e JOIN d ON d.day <= e.day AND d.day > e.day - 30 GROUP BY e.day""",
    ("request_log",),
)
def active_by_window(spark, sf):
    """Users active on each day, in the seven and in the thirty days that end with it."""
    days = stored_days(spark, sf).where("kind = 'any'")
    ends = days.select("bucket", "users", "day", F.explode(F.expr("sequence(day, date_add(day, 29))")).alias("end"))
    ends = ends.join(days.select(F.col("day").alias("end")).distinct(), "end")
    spans = {"daily": 1, "weekly": 7, "monthly": 30}
    named = F.array_compact(F.array(*[F.when(F.date_diff("end", "day") < n, F.lit(k)) for k, n in spans.items()]))
    counted = bits.users_of(ends.withColumn("span", F.explode(named)), "end", "span")
    wide = counted.groupBy(F.col("end").alias("day")).pivot("span", list(spans)).agg(F.first("users"))
    return wide.select("day", *spans)


@query(
    "a32_retention_from_bitmaps",
    f"""WITH c AS (SELECT user_id, CAST(created_at AS DATE) AS d, CAST(date_trunc('week', created_at) AS DATE) AS week FROM members WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 56 DAY),
 u AS (SELECT c.user_id, week, max(CASE WHEN date_diff('day', d, CAST(ts AS DATE)) BETWEEN 7 AND 13 THEN 1 ELSE 0 END) AS w1,
 max(CASE WHEN date_diff('day', d, CAST(ts AS DATE)) BETWEEN 14 AND 20 THEN 1 ELSE 0 END) AS w2, max(CASE WHEN date_diff('day', d, CAST(ts AS DATE)) BETWEEN 28 AND 34 THEN 1 ELSE 0 END) AS w4
 FROM c LEFT JOIN request_log r ON r.user_id = c.user_id GROUP BY 1, 2)
 SELECT week, count(*) AS size, CAST(sum(w1) AS BIGINT) AS retained_1w, CAST(sum(w2) AS BIGINT) AS retained_2w, CAST(sum(w4) AS BIGINT) AS retained_4w FROM u GROUP BY week""",
    ("members", "request_log"),
)
def retention_from_bitmaps(spark, sf):
    recent = bridge.members(spark, sf).where(F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL 56 DAY"))
    created = bits.day_bitmaps(recent, "user_id", "created_at")
    return bits.retention(created, stored_days(spark, sf), {"retained_1w": (7, 14), "retained_2w": (14, 21), "retained_4w": (28, 35)})
