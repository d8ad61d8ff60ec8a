"""Appended commitments against the tree built at once."""

import pytest
from pyspark.sql import functions as F

from hexvigil.operators import commitments as cm
from hexvigil.operators import digest


def leaves(spark, a, b):
    return spark.range(a, b).select((F.col("id") - a).alias("place"), F.sha2(F.col("id").cast("string"), 256).alias("leaf_hash"))


def built(spark, n):
    return digest.merkle_root(leaves(spark, 0, n).withColumnRenamed("place", "leaf_index")).first()["root"]


@pytest.mark.parametrize("sizes", [[1], [2, 1], [5, 3, 9, 1], [16, 16, 1], [0, 7, 0, 30], [37, 100, 3]])
def test_roots_proofs_and_consistency(spark, sizes):
    frontier, nodes, seen = cm.Frontier(), None, []
    assert frontier.root() == digest.EMPTY_ROOT
    for m in sizes:
        before = frontier
        fresh, frontier = cm.append_leaves(before, leaves(spark, before.count, before.count + m), block_bits=3)
        nodes = fresh if nodes is None else nodes.unionByName(fresh)
        assert frontier.count == before.count + m
        assert frontier.root() == built(spark, frontier.count)
        assert sorted(frontier.peaks) == [t for t in range(12) if frontier.count >> t & 1]
        assert fresh.count() <= 2 * m + before.count.bit_length()
        seen.append(frontier)
    assert nodes.groupBy("height", "idx").count().where("count > 1").isEmpty()
    for old in seen:
        if not old.count:
            continue
        proofs = digest.verify_proofs(cm.inclusion(old, nodes)).collect()
        assert len(proofs) == old.count and all(r["valid"] and r["root"] == old.root() for r in proofs)
        proof = cm.consistency(old, frontier, nodes)
        assert cm.is_consistent(proof, old.count, old.root(), frontier.root())
        assert not cm.is_consistent(proof, old.count, old.root(), built(spark, frontier.count + 1))
        assert not cm.is_consistent(proof.withColumn("hash", F.sha2("hash", 256)), old.count, old.root(), frontier.root())


def test_paths_equal_those_of_the_whole_tree(spark):
    a, frontier = cm.append_leaves(cm.Frontier(), leaves(spark, 0, 21), 2)
    b, frontier = cm.append_leaves(frontier, leaves(spark, 21, 45), 2)
    whole = digest.inclusion_proofs(leaves(spark, 0, 45).withColumnRenamed("place", "leaf_index"))
    expected = {r["leaf_index"]: list(r["path"]) for r in whole.collect()}
    assert {r["leaf_index"]: list(r["path"]) for r in cm.inclusion(frontier, a.unionByName(b)).collect()} == expected


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
def test_proofs_by_block_are_those_by_node(spark, bits):
    a, old = cm.append_leaves(cm.Frontier(), leaves(spark, 0, 21), 2)
    b, new = cm.append_leaves(old, leaves(spark, 21, 64), 2)
    nodes = a.unionByName(b)
    for frontier in (old, new):
        own = nodes.where((F.col("height") == 0) & (F.col("idx") < frontier.count))
        want = own.join(cm.paths(frontier, nodes, own), ["height", "idx"])
        got = cm.inclusion(frontier, nodes, bits)
        assert {(r.leaf_index, r.leaf_hash, *r.path) for r in got.collect()} == {(r.idx, r.hash, *r.path) for r in want.collect()}
        assert got.count() == frontier.count and {r.root for r in got.collect()} == {frontier.root()}
