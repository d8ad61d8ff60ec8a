"""Centroid clustering against plain Python integers, on ordinary and awkward vectors."""

import hashlib
import math

import numpy as np
import pytest

from hexvigil.llm import centroids as op
from tests_llm_data import read

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"


def brute(rows, clusters=op.CLUSTERS, rounds=op.ROUNDS, dims=op.DIMENSIONS):
    """Sorted (vec_id, cluster, distance) and the centroids of (vec_id, vector) rows."""
    kept = [
        (i, tuple(math.floor(256 * c) if abs(c) < 1 << 53 else int(c) * 256 for c in v), v) for i, v in rows
        if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    centres = [r[1] for r in order[:clusters]]

    def assign():
        out = []
        for i, v, _ in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(centres))
            out.append((i, c, d, v))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            own = [v for _, k, _, v in found if k == c]
            if own:
                centres[c] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    key = lambda r: (r[0] is None, r)
    return sorted(((i, c, min(d, op.LONGEST)) for i, c, d, _ in assign()), key=key), centres


def collected(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_table_equals_brute_force(spark):
    table = read(spark, "embeddings")
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in table.collect()]
    expected, centres = brute(rows)
    found, moved = op.cluster_vectors(table)
    assert collected(found) == expected and [tuple(int(v) for v in c) for c in moved] == centres
    for r in op.with_inertia(found, moved).collect():
        assert r["inertia"] == sum(d for _, _, d in expected)
        assert r["cluster_inertia"] == sum(d for _, c, d in expected if c == r["cluster"])
        text = ",".join(map(str, centres[r["cluster"]]))
        assert r["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def vector(*head, rest=0.0):
    return [*map(float, head), *[float(rest)] * (64 - len(head))]


def awkward():
    nan, inf = float("nan"), float("inf")
    return [
        (1, None), (2, []), (3, vector(1)[:63]), (4, vector(1) + [1.0]), (5, [None, *vector(1)[1:]]), (6, vector(nan)),
        (7, vector(inf)), (8, vector(0)), (9, vector(-0.001)), (10, vector(0.5, -0.5)), (10, vector(0.5, -0.5)), (10, vector(0.25)),
        (None, vector(0.3)), (None, None), (11, vector(1e300, -1e300)), (12, vector(2.0**50 + 1, rest=-(2.0**45))),
        (13, vector(3e4, rest=1 / 3)), *((20 + i, vector(i / 100, rest=-i / 999)) for i in range(60)),
        *((200 + i, vector(0.125, 0.25)) for i in range(50)),
    ]


@pytest.mark.parametrize("clusters", [1, 3, 40, 500])
def test_awkward_vectors(spark, clusters):
    rows = awkward()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    found, moved = op.cluster_vectors(df, clusters=clusters)
    expected, centres = brute(rows, clusters)
    assert found.columns == ["vec_id", "cluster", "distance"]
    assert collected(found) == expected and [tuple(int(v) for v in c) for c in moved] == centres
    assert op.with_inertia(found, moved).count() == len(expected)


def test_several_segments_per_task(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    try:
        found, _ = op.cluster_vectors(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).coalesce(2), clusters=7)
        assert collected(found) == brute(rows, 7)[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    found, moved = op.cluster_vectors(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and len(moved) == 0 and op.with_inertia(found, moved).count() == 0


def test_dictionaries_are_lossless_and_pick_their_width():
    rng = np.random.default_rng(1)
    copies = np.repeat(rng.normal(0, 1, (3, 64)), 50, 0)
    for x, widest in ((copies, True), (rng.normal(0, 1, (3000, 64)), False), (np.zeros((1, 64)), True), (rng.normal(0, 1, (9, 6)), False)):
        x = op._rounded(x)
        width, codes, firsts = op._dictionaries(x)
        again = np.hstack([x[rows, b * width : (b + 1) * width][codes[:, b]] for b, rows in enumerate(firsts)])
        assert (again == x).all() and (width == 64) == widest
