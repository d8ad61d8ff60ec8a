"""Medians and positions that are kept up, from stored quantile sketches.

Beside its sums each day and group keeps a mergeable KLL sketch of its values, a few KB however many rows it has.  A rank
or quantile of any days comes from merging their sketches; the exact operators (``prefix``, ``scores``) are the check.
With k = 800 a rank is off by less than half a percent of the rows, 99 times of 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; the rank error falls as one over it.
K = 800
#: Even ranks whose values tell a row's position.
CUTS = 100


def sketched(rows: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """(keys, n, total, sketch) of the values; nulls are left out, a group without values gives no row.

    A hot group is sketched in every task and the sketches are merged.
    """
    given = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    v = F.col(value).cast("double")
    return given.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of the same keys as one, with their sums."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(share: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(share)))


def rank(value: float) -> Column:
    """The share of values at or below ``value``."""
    return F.kll_sketch_get_rank_double("sketch", F.lit(float(value)))


def store_batch(rows: DataFrame, keys: list[str], value: str, path: str, batch: int, k: int = K) -> None:
    """One batch's sketches as a part of its own; a repeated batch replaces itself, earlier ones aren't read."""
    sketched(rows, keys, value, k).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def positions_from(sketches: DataFrame, scores: DataFrame, keys: list[str], value: str, cuts: int = CUTS) -> DataFrame:
    """``scores`` (keys, value and others) with ``position``: the share of its group's values at or below it.

    A group's sketch gives the values at ``cuts`` even ranks, so a position is off by half a cut more than a rank.  Rows
    meet the cuts of their group by key; groups are few beside rows, and rows of a hot group are spread over salts.
    """
    salts = 16
    shares = F.array(*[F.lit((i + 0.5) / cuts) for i in range(cuts)])
    spread = merged(sketches, keys).select(
        *keys, F.kll_sketch_get_quantile_double("sketch", shares).alias("__cuts"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")
    )
    salted = scores.withColumn("__salt", F.pmod(F.xxhash64(*scores.columns), F.lit(salts)).cast("int"))
    joined = salted.join(spread, [*keys, "__salt"], "left")
    below = F.size(F.filter("__cuts", lambda c: c <= F.col(value).cast("double"))) / F.lit(float(cuts))
    return joined.withColumn("position", F.when(F.col(value).isNotNull() & F.col("__cuts").isNotNull(), below)).drop("__salt", "__cuts")
