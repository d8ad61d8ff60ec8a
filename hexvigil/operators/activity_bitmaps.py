"""A28, A31, A32 from stored day bitmaps: any window of days without reading the log again.

A bitmap row holds which of 32 768 users were active on a day; a day of a billion users takes 30 000 rows of 4 KB.  Days
are written as partitions, so a new day reads that day's log alone, and funnels, windows and cohorts join the few rows of
the days they ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_bitmaps(log: DataFrame, key: str, ts: str, kinds: dict[str, Column] | None = None) -> DataFrame:
    """(day, kind, bucket, users): a bitmap of the users of each day, one of all (``any``) and one per condition of ``kinds``.

    ``key`` is a whole number; rows without one or without a time are left out.  Repeats of a user and day set one bit.
    """
    kinds = {"any": F.lit(True)} | (kinds or {})
    named = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in kinds.items()]))
    user = F.col(key).cast("long")
    rows = log.where(user.isNotNull() & F.col(ts).isNotNull()).select(user.alias("user"), F.to_date(ts).alias("day"), F.explode(named).alias("kind"))
    return rows.groupBy("day", "kind", F.bitmap_bucket_number("user").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("user")).alias("users")
    )


def store_days(bitmaps: DataFrame, path: str) -> None:
    """Writes days as partitions; a day that is written again replaces itself, other days aren't touched."""
    bitmaps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def users_of(bitmaps: DataFrame, *by: str) -> DataFrame:
    """Distinct users per ``by`` over all days given."""
    joined = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return joined.groupBy(*by).agg(F.sum(F.bitmap_count("users")).alias("users"))


def both(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, users) of the users in both, where each has a row."""
    every = left.select(*keys, "users").unionByName(right.select(*keys, "users"))
    return every.groupBy(*keys).agg(F.count("*").alias("n"), F.bitmap_and_agg("users").alias("users")).where("n = 2").drop("n")


def returned_users(bitmaps: DataFrame) -> DataFrame:
    """One row ``users``: those active on more than one of the days, as the days' bitmaps beside all earlier ones."""
    rows = bitmaps.where("kind = 'any'").select("bucket", "day", "users")
    before = Window.partitionBy("bucket").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("seen", F.bitmap_or_agg("users").over(before)).withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy("day")))
    later = seen.where("nth > 1")
    again = both(later.select("bucket", "day", "users"), later.select("bucket", "day", F.col("seen").alias("users")), ["bucket", "day"])
    return users_of(again)


def funnel(bitmaps: DataFrame, users: DataFrame, contributions: DataFrame) -> DataFrame:
    """The stages of ``activity.engagement_funnel``, the requests' ones from the bitmaps (kinds any and queried)."""
    zero = F.lit(0)
    queried = users_of(bitmaps.where("kind = 'queried'")).select(F.coalesce("users", zero).alias("queried"))
    returned = returned_users(bitmaps).select(F.coalesce("users", zero).alias("returned"))
    registered = users.agg(F.count("*").alias("registered"), F.count(F.when(F.col("verified"), 1)).alias("verified"))
    contributed = contributions.agg(F.count_distinct("submitter").alias("contributed"))
    return registered.join(contributed).join(queried).join(returned)  # one row each


def retention(created: DataFrame, bitmaps: DataFrame, periods: dict[str, tuple[int, int]]) -> DataFrame:
    """Per week of creation its size and, for each period of days [from, to) after creation, who was active in it.

    ``created`` holds bitmaps by day of creation (kind any).  Of the activity only the days that a period reaches meet it.
    """
    born = created.where("kind = 'any'").select(F.col("day").alias("born"), "bucket", "users")
    reach = F.array(*[F.struct(F.lit(name).alias("period"), F.lit(a).alias("a"), F.lit(b - 1).alias("b")) for name, (a, b) in periods.items()])
    wanted = born.select("born", "bucket", F.inline(reach)).withColumn("day", F.explode(F.expr("sequence(date_add(born, a), date_add(born, b))")))
    active = (
        wanted.join(bitmaps.where("kind = 'any'").select("day", "bucket", "users"), ["day", "bucket"])
        .groupBy("born", "period", "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    )
    cohorts = born.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
    kept = both(cohorts, active, ["born", "period", "bucket"])
    week = F.to_date(F.date_trunc("week", "born")).alias("week")
    sizes = born.groupBy(week).agg(F.sum(F.bitmap_count("users")).alias("size"))
    counts = kept.groupBy(week).agg(*[F.sum(F.when(F.col("period") == p, F.bitmap_count("users")).otherwise(0)).alias(p) for p in periods])
    return sizes.join(counts, "week", "left").na.fill(0, list(periods))
