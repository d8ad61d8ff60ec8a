"""Sketched ranks and quantiles beside exact ones, merged from days and batches."""

import random

from pyspark.sql import functions as F

from hexvigil.operators import score_sketches as sk


def rows(spark, n=40_000):
    rnd = random.Random(9)
    data = [("hot" if rnd.random() < 0.8 else rnd.choice("ab"), i % 7, rnd.gauss(5, 2)) for i in range(n)] + [("a", 1, None), ("none", 2, None), ("a", 3, float("nan"))]
    return data, spark.createDataFrame(data, "k string, day int, v double")


def test_ranks_and_quantiles_are_near(spark):
    data, df = rows(spark)
    days = sk.sketched(df, ["k", "day"], "v")
    found = sk.merged(days, ["k"]).select("k", "n", "total", *[sk.quantile(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9))], sk.rank(5.0).alias("r")).collect()
    groups = {}
    for k, _, v in data:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    assert {r.k for r in found} == set(groups)
    for r in found:
        values = groups[r.k]
        assert r.n == len(values) and abs(r.total - sum(values)) < 1e-6
        for q, guess in ((0.1, r.q0), (0.5, r.q1), (0.9, r.q2)):
            assert abs(sum(v <= guess for v in values) / len(values) - q) < 0.015
        assert abs(sum(v <= 5.0 for v in values) / len(values) - r.r) < 0.015


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("x", float(i)) for i in range(101)] + [("y", 3.0)], "k string, v double")
    found = {r.k: (r.m, r.r) for r in sk.sketched(df, ["k"], "v").select("k", sk.quantile(0.5).alias("m"), sk.rank(49.0).alias("r")).collect()}
    assert found["x"][0] in (50.0, 49.0) and abs(found["x"][1] - 50 / 101) < 1e-9 and found["y"][0] == 3.0


def test_positions_and_batches(spark, tmp_path):
    data, df = rows(spark, 6000)
    for day in range(7):
        sk.store_batch(df.where(F.col("day") == day), ["k"], "v", str(tmp_path / "s"), day)
    sk.store_batch(df.where(F.col("day") == 3), ["k"], "v", str(tmp_path / "s"), 3)
    asked = spark.createDataFrame([("hot", 5.0, 1), ("a", 2.0, 2), ("absent", 1.0, 3), ("b", None, 4)], "k string, v double, id int")
    found = {r.id: r.position for r in sk.positions_from(spark.read.parquet(str(tmp_path / "s")), asked, ["k"], "v").collect()}
    assert found[3] is None and found[4] is None
    for i, (k, x) in ((1, ("hot", 5.0)), (2, ("a", 2.0))):
        values = [v for g, _, v in data if g == k and v is not None and v == v]
        assert abs(found[i] - sum(v <= x for v in values) / len(values)) < 0.02
