"""Order statistics against brute force, with one key holding most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from hexvigil.functions import prefix


def rows(seed, n=3000, continuous=False):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None])
        value = rnd.gauss(5, 3) if continuous else rnd.randint(0, 50) / 5
        out.append((key, value, i))
    out.append(("single", 4.2, n))
    return out


def grouped(data):
    groups = {}
    for k, v, *_ in data:
        groups.setdefault(k, []).append(v)
    return groups


@pytest.mark.parametrize("whole", [0, prefix.WHOLE])
@pytest.mark.parametrize("continuous,lo,hi", [(False, 0.0, 10.0), (True, None, None), (True, 2.0, 6.0)])
def test_median_and_mad(spark, monkeypatch, continuous, lo, hi, whole):
    monkeypatch.setattr(prefix, "WHOLE", whole)
    data = rows(1, continuous=continuous)
    df = spark.createDataFrame(data, "k string, v double, i int")
    got = {r.k: (r.median, r.mad) for r in prefix.exact_median_mad(df, ["k"], "v", lo, hi).collect()}
    expected = grouped(data)
    assert set(got) == set(expected)
    for k, values in expected.items():
        med = statistics.median(values)
        dev = sorted(abs(v - med) for v in values)
        assert got[k][0] == pytest.approx(med, abs=1e-12)
        assert got[k][1] == pytest.approx(dev[len(dev) // 2], abs=1e-12)


@pytest.mark.parametrize("whole", [0, prefix.WHOLE])
def test_cumulative_counts(spark, monkeypatch, whole):
    monkeypatch.setattr(prefix, "WHOLE", whole)
    data = rows(2)
    df = spark.createDataFrame(data, "k string, v double, i int")
    groups = grouped(data)
    for r in prefix.cumulative_counts(df, ["k"], "v", buckets=7).collect():
        values = groups[r.k]
        assert r.n == sum(v == r.v for v in values)
        assert r.below == sum(v < r.v for v in values)
        assert r.total == len(values)


def test_running_total_and_positions(spark):
    data = rows(3, 800)
    df = spark.createDataFrame(data, "k string, v double, i int")
    got = {r.i: r.t for r in prefix.running_total(df, ["k"], F.floor(F.col("i") / 37), ["i"], "v", "t").collect()}
    sums = {}
    for k, v, i in data:
        sums[k] = sums.get(k, 0.0) + v
        assert got[i] == pytest.approx(sums[k])
    order = {r.i: r.position for r in prefix.positions(df, [], F.floor(F.col("i") / 100), ["i"]).collect()}
    assert order == {i: i for *_, i in data}


def test_buckets_stay_even_beside_a_far_value(spark):
    counts = spark.range(1, 100_000).select(F.lit("g").alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    counts = counts.unionByName(spark.range(1).select(F.lit("g").alias("k"), F.lit(1e12).alias("v"), F.lit(1).alias("n")))
    sizes = prefix._bucketed(counts, ["k"], "v", None, None, prefix.BUCKETS).groupBy("__b").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 100_000 / 1024
    order = prefix._bucketed(counts, ["k"], "v", None, None, prefix.BUCKETS).groupBy("__b").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    rows = order.orderBy("__b").collect()
    assert all(x.b < y.a for x, y in zip(rows[:-1], rows[1:], strict=True))


@pytest.mark.parametrize("deep", [0, prefix.DEEP])
def test_ranks_of_large_groups_need_no_cuts_beside_every_row(spark, monkeypatch, deep):
    monkeypatch.setattr(prefix, "WHOLE", 0)
    monkeypatch.setattr(prefix, "DEEP", deep)
    cut = []
    place = prefix._place
    monkeypatch.setattr(prefix, "_place", lambda *a: cut.append(1) or place(*a))
    data = [("far", float(v), 0) for v in [*range(-40, 60), 1e12, -1e300]] + [("wide", v, 0) for v in (-1e308, 0.5, 1.5, 1e308)]
    data += [("ends", float("inf"), 0), ("ends", 1.0, 0), ("ends", 2.0, 0), ("same", 3.0, 0), ("same", 3.0, 0), (None, 1.0, 0), (None, 4.0, 0)]
    df = spark.createDataFrame(data, "k string, v double, i int")
    got = {r.k: (r.median, r.mad) for r in prefix.exact_median_mad(df, ["k"], "v").collect()}
    for k, values in grouped(data).items():
        med = statistics.median(values)
        dev = sorted(abs(v - med) for v in values)
        assert got[k] == (med, dev[len(dev) // 2])
    assert bool(cut) == (deep == 0)
