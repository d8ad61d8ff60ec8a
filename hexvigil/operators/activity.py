"""Contribution and request activity: counts over time, users, funnel, cohorts.

Nothing reads the clock: every time-relative operator takes ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _since(as_of: str, days: int) -> Column:
    return _at(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def type_distribution(iocs: DataFrame, column: str = "ioc_type") -> DataFrame:
    """A23."""
    return iocs.groupBy(column).agg(F.count("*").alias("count"))


def contribution_stats(contributions: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows and distinct vendors per contribution type, with the total under 'all'."""
    vendors = F.approx_count_distinct("vendor") if approximate else F.count_distinct("vendor")
    return (
        contributions.rollup("contrib_type")
        .agg(F.count("*").alias("contributions"), vendors.alias("unique_vendors"), F.grouping("contrib_type").alias("__g"))
        .select(
            F.when(F.col("__g") == 1, "all").otherwise(F.col("contrib_type")).alias("contrib_type"),
            "contributions",
            "unique_vendors",
        )
    )


def source_counts(items: DataFrame) -> DataFrame:
    """Ledger items per source, with the total under 'all'."""
    return (
        items.rollup("source")
        .agg(F.count("*").alias("items"), F.grouping("source").alias("__g"))
        .select(F.when(F.col("__g") == 1, "all").otherwise(F.col("source")).alias("source"), "items")
    )


def daily_counts(df: DataFrame, ts: str, as_of: str, days: int = 90, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per day of the last ``days`` days, optionally per type."""
    return (
        df.where((F.col(ts) >= _since(as_of, days)) & (F.col(ts) < _at(as_of)))
        .groupBy(F.to_date(ts).alias("day"), *by)
        .agg(F.count("*").alias("count"))
    )


DISTRIBUTION_COLUMNS = ("industry", "org_size", "role")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Only the bucketed context columns may be asked for."""
    if column not in DISTRIBUTION_COLUMNS:
        raise ValueError(f"distribution is limited to {DISTRIBUTION_COLUMNS}")
    return (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    )


def user_activity(users: DataFrame, as_of: str) -> DataFrame:
    """Users, active within 30 days, and request-count buckets, in one row."""
    rc = F.col("request_count")

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    active = n(F.col("last_used") >= _since(as_of, 30))
    return users.agg(
        F.count("*").alias("total_users"),
        active.alias("active_last_30d"),
        (F.count("*") - active).alias("inactive"),
        n(rc == 0).alias("requests_0"),
        n(rc.between(1, 10)).alias("requests_1_10"),
        n(rc.between(11, 100)).alias("requests_11_100"),
        n(rc.between(101, 1000)).alias("requests_101_1000"),
        n(rc > 1000).alias("requests_over_1000"),
    )


def tier_distribution(users: DataFrame) -> DataFrame:
    return users.groupBy("tier").agg(F.count("*").alias("count"))


def invite_metrics(users: DataFrame) -> DataFrame:
    """Inviter share and viral coefficient."""
    total = F.count("*")
    inviters = F.count(F.when(F.col("invite_count") > 0, 1))
    invited = F.coalesce(F.sum("invite_count"), F.lit(0))
    return users.agg(
        total.alias("total_users"),
        inviters.alias("inviters"),
        F.when(total > 0, 100.0 * inviters / total).otherwise(0.0).alias("inviter_pct"),
        invited.alias("total_invited"),
        F.count("invited_by").alias("invited_users"),
        F.when(total > 0, invited / total).otherwise(0.0).alias("viral_coefficient"),
    )


def network_health(contributions: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Weekly velocity, supply per user, coverage; one pass over the contributions."""
    ts = F.col("received_at")
    week, fortnight = _since(as_of, 7), _since(as_of, 14)
    n_users = users.agg(F.count("*")).scalar()
    counted = contributions.where(ts < _at(as_of)).agg(
        F.count("*").alias("total_contributions"),
        F.count(F.when(ts >= week, 1)).alias("this_week"),
        F.count(F.when((ts >= fortnight) & (ts < week), 1)).alias("last_week"),
        F.count_distinct("industry").alias("unique_industries"),
        F.count_distinct("category").alias("unique_categories"),
    )
    this, last = F.col("this_week"), F.col("last_week")
    return counted.withColumn("total_users", n_users).withColumns(
        {
            "velocity_pct": F.when(last > 0, 100.0 * (this - last) / last)
            .when(this > 0, 100.0)
            .otherwise(0.0),
            "supply_demand_ratio": F.when(
                F.col("total_users") > 0, F.col("total_contributions") / F.col("total_users")
            ).otherwise(F.col("total_contributions").cast("double")),
        }
    )


PUBLIC_FIELDS = ["total_contributions", "velocity_pct", "this_week", "unique_industries", "unique_categories", "total_users"]


def public_health(health: DataFrame) -> DataFrame:
    """The columns that may be shown in public."""
    return health.select(*PUBLIC_FIELDS)


def engagement_funnel(users: DataFrame, contributions: DataFrame, request_log: DataFrame) -> DataFrame:
    """Registered, verified, contributed, queried, returned (active on more than one day)."""
    per_day = request_log.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.max(F.col("endpoint").startswith("/query")).alias("queried")
    )
    per_user = per_day.groupBy("user_id").agg(F.count("*").alias("days"), F.max("queried").alias("queried"))
    demand = per_user.agg(
        F.count(F.when(F.col("queried"), 1)).alias("queried"), F.count(F.when(F.col("days") > 1, 1)).alias("returned")
    )
    contributed = contributions.agg(F.count_distinct("submitter")).scalar()
    registered = users.agg(F.count("*")).scalar()
    verified = users.agg(F.count(F.when(F.col("verified"), 1))).scalar()
    return demand.select(
        registered.alias("registered"),
        verified.alias("verified"),
        contributed.alias("contributed"),
        "queried",
        "returned",
    )


def retention_cohorts(users: DataFrame, request_log: DataFrame, as_of: str, weeks: int = 8) -> DataFrame:
    """Weekly (Monday) registration cohorts; active in days [7,14), [14,21), [28,35) after registration.

    Requests shrink to one row per user and day before they meet the users.
    """
    cohort = users.where(F.col("created_at") >= _since(as_of, 7 * weeks)).select(
        "user_id",
        F.to_date("created_at").alias("created_on"),
        F.to_date(F.date_trunc("week", "created_at")).alias("week"),
    )
    days = request_log.select("user_id", F.to_date("ts").alias("day")).distinct()
    after = F.date_diff("day", "created_on")

    def active(lo: int, hi: int) -> Column:
        return F.coalesce(F.max(F.when((after >= lo) & (after < hi), 1)), F.lit(0))

    per_user = (
        cohort.join(days, "user_id", "left")
        .groupBy("user_id", "week")
        .agg(active(7, 14).alias("w1"), active(14, 21).alias("w2"), active(28, 35).alias("w4"))
    )
    return per_user.groupBy("week").agg(
        F.count("*").alias("size"),
        F.sum("w1").alias("retained_1w"),
        F.sum("w2").alias("retained_2w"),
        F.sum("w4").alias("retained_4w"),
    )
