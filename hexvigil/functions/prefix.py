"""Order statistics that do not depend on one group fitting into one task.

A plain window over a group sorts the whole group in a single task.  Here equal
values are counted first (map-side combined), the value range of each group is
cut into buckets at its quantiles, and only bucket totals are accumulated per group.  A hot group
is thereby spread over as many tasks as it has buckets, and results stay exact.  Groups of a few
thousand distinct values, however many rows they have, are accumulated as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexvigil.session import cut_lineage

BUCKETS = 1024
#: A group of no more distinct values is accumulated in one go; only larger ones are cut into buckets.
WHOLE = 8192
#: Distinct values of one bucket that a task sorts; where an even cut of the range leaves more, quantiles cut it.
DEEP = 1 << 20


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond).drop(*[f"__r_{k}" for k in keys])


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def _small(counts: DataFrame, keys: list[str]) -> bool:
    """Whether no group has more than WHOLE distinct values; ``counts`` is read once more, so it should be kept."""
    largest = counts.groupBy(*keys).agg(F.count("*").alias("__d")).agg(F.max("__d")).first()[0]
    return (largest or 0) <= WHOLE


def _accumulated(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``below`` and ``total`` of each counted value of small groups."""
    group = Window.partitionBy(*keys)
    before = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(before), F.lit(0))
    return counts.select(*keys, value, "n", below.alias("below"), F.sum("n").over(group).alias("total"))


def _bucketed(
    counts: DataFrame, keys: list[str], value: str, lo: float | None, hi: float | None, buckets: int
) -> DataFrame:
    """Counts with the bucket ``__b`` of their value; values outside a known range fall into the end buckets.

    Without a known range the buckets of a group hold about as many distinct values each,
    whatever single values lie far out.
    """
    v = F.col(value).cast("double")
    if lo is None or hi is None:
        at = [i / buckets for i in range(1, buckets)]
        # The row total makes this read the same columns as every other use, so one shuffle serves all.
        cut = counts.groupBy(*keys).agg(
            F.percentile_approx(v, at, F.lit(10 * buckets)).alias("__cuts"), F.sum("n").alias("__rows")
        )
        cut = cut.where("__rows > 0").drop("__rows")
        return _null_safe_join(counts, cut, keys).withColumn("__b", _place(v, F.col("__cuts"), buckets)).drop("__cuts")
    low, high = float(lo), float(hi)
    share = (v - low) / (high - low) if high > low else F.lit(0.0)
    bucket = F.least(F.greatest(F.floor(share * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    return counts.withColumn("__b", bucket)


def _evenly(counts: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """Counts with the bucket ``__b`` of their value in an even cut of the range that their group has."""
    v = F.col(value).cast("double")
    span = counts.groupBy(*keys).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    share = F.when(width > 0, (v - F.col("__lo")) / width).otherwise(0.0)
    bucket = F.least(F.greatest(F.floor(share * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    return _null_safe_join(counts, span, keys).withColumn("__b", bucket).drop("__lo", "__hi")


def _place(v: Column, cuts: Column, buckets: int) -> Column:
    """How many of the sorted cuts lie below a value: first among every 32nd, then in that stretch."""
    step = 32
    if buckets <= step:
        return F.size(F.filter(cuts, lambda c: c < v)).cast("int")
    every = F.transform(F.sequence(F.lit(step), F.lit(buckets - 1), F.lit(step)), lambda i: F.get(cuts, i - 1))
    stretch = F.size(F.filter(every, lambda c: c < v)) * step
    return (stretch + F.size(F.filter(F.slice(cuts, stretch + 1, step), lambda c: c < v))).cast("int")


def _bucket_offsets(placed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per (keys, bucket): rows in it, rows in smaller buckets, rows of the group, smallest and largest value."""
    per_bucket = placed.groupBy(*keys, "__b").agg(
        F.sum("n").alias("__bn"), F.min(value).alias("__bmin"), F.max(value).alias("__bmax"), F.count("*").alias("__bd")
    )
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(
        *keys,
        "__b",
        "__bn",
        "__bmin",
        "__bmax",
        "__bd",
        F.coalesce(F.sum("__bn").over(before), F.lit(0)).alias("__before"),
        F.sum("__bn").over(Window.partitionBy(*keys)).alias("total"),
    )


def cumulative_counts(
    df: DataFrame,
    keys: list[str],
    value: str,
    lo: float | None = None,
    hi: float | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per (keys, distinct value): ``n`` equal rows, ``below`` rows with a smaller value, ``total`` rows.

    ``lo``/``hi`` give the known range of the value (scores 0-10, rates 0-100).  Without
    them the range is measured per group.
    """
    counts = cut_lineage(_counted(df, keys, value))
    if _small(counts, keys):
        return _accumulated(counts, keys, value)
    placed = _bucketed(counts, keys, value, lo, hi, buckets)
    offsets = _bucket_offsets(placed, keys, value).drop("__bn", "__bmin", "__bmax", "__bd")
    joined = _null_safe_join(placed, offsets, [*keys, "__b"])
    inside = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return joined.select(*keys, value, "n", below.alias("below"), "total")


def _rank_values(
    counts: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Column],
    lo: float | None,
    hi: float | None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Values at zero-based ranks (columns over ``total``) of each group of counted values.

    Bucket totals say which bucket holds a rank; only those buckets are looked into, and
    one that holds a single value not even that.
    """
    def at(rank: Column) -> Column:
        hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    picks = [at(rank).alias(name) for name, rank in ranks.items()]
    if _small(counts, keys):
        return _accumulated(counts, keys, value).groupBy(*keys).agg(*picks)
    holds = F.lit(False)
    for rank in ranks.values():
        holds = holds | ((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__bn")))
    even = lo is None or hi is None
    placed = _evenly(counts, keys, value, buckets) if even else _bucketed(counts, keys, value, lo, hi, buckets)
    targets = cut_lineage(_bucket_offsets(placed, keys, value).where(holds))
    if even and (targets.where("__bmin < __bmax").agg(F.max("__bd")).first()[0] or 0) > DEEP:
        placed = _bucketed(counts, keys, value, None, None, buckets)
        targets = _bucket_offsets(placed, keys, value).where(holds)
    plain = targets.where("__bmin = __bmax").select(
        *keys, F.col("__bmin").alias(value), F.col("__bn").alias("n"), F.col("__before").alias("below"), "total"
    )
    mixed = _null_safe_join(
        placed, targets.where("__bmin < __bmax").select(*keys, "__b", "__before", "total"), [*keys, "__b"]
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    deep = mixed.select(*keys, value, "n", below.alias("below"), "total")
    picked = plain.unionByName(deep)
    return picked.groupBy(*keys).agg(*picks)


def _median(counts: DataFrame, keys: list[str], value: str, lo: float | None, hi: float | None, name: str) -> DataFrame:
    total = F.col("total")
    found = _rank_values(
        counts, keys, value, {"__r1": F.floor((total - 1) / 2), "__r2": F.floor(total / 2)}, lo, hi
    )
    return found.select(*keys, ((F.col("__r1") + F.col("__r2")) / 2).alias(name))


def exact_median(
    df: DataFrame, keys: list[str], value: str, lo: float | None = None, hi: float | None = None, name: str = "median"
) -> DataFrame:
    """Median that averages the two middle rows of an even group."""
    return _median(cut_lineage(_counted(df, keys, value)), keys, value, lo, hi, name)


def exact_median_mad(
    df: DataFrame, keys: list[str], value: str, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """Median, and the upper-middle absolute deviation from it (element ``n // 2``)."""
    return median_mad_of_counts(_counted(df, keys, value), keys, value, lo, hi)


def median_mad_of_counts(
    counts: DataFrame, keys: list[str], value: str, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """Median and deviation of rows ``(*keys, value, n)``, which are read several times and so kept in a checkpoint."""
    counts = cut_lineage(counts)
    med = _median(counts, keys, value, lo, hi, "median")
    apart = _null_safe_join(counts, med, keys).select(
        *keys, F.abs(F.col(value) - F.col("median")).alias("__dev"), "n"
    )
    span = None if lo is None or hi is None else float(hi) - float(lo)
    # Two values may lie as far off on either side; ranks count rows, so their deviations need not be made one.
    mad = _rank_values(
        apart,
        keys,
        "__dev",
        {"mad": F.floor(F.col("total") / 2)},
        None if span is None else 0.0,
        span,
    )
    return _null_safe_join(med, mad, keys)


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` per key in (bucket, order) order.

    ``bucket`` must be a coarse, order-preserving step of the sort order (for
    example the day of a timestamp).  Only one row per bucket is accumulated
    per key; rows are accumulated within their bucket.
    """
    staged = df.withColumn("__b", bucket)
    sums = staged.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"))
    inside = (
        Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = _null_safe_join(staged, offsets, [*keys, "__b"])
    return joined.withColumn(name, F.col("__off") + F.sum(value).over(inside)).drop("__b", "__off")


def positions(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "position") -> DataFrame:
    """Zero-based position of every row per key in (bucket, order) order, without a whole-group sort."""
    staged = df.withColumn("__b", bucket)
    group = keys or ["__one"]
    if not keys:
        staged = staged.withColumn("__one", F.lit(1))
    sizes = staged.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*group, "__b").orderBy(*order)
    joined = _null_safe_join(staged, offsets, [*group, "__b"])
    out = joined.withColumn(name, F.col("__off") + F.row_number().over(inside) - 1).drop("__b", "__off")
    return out if keys else out.drop("__one")
