"""H2, H3 for commitments that are appended: the tree is kept as a table of complete nodes and a frontier.

The frontier holds the roots of the complete subtrees that make up the first n leaves, one for each bit of n, so it has
at most 64 hashes.  An append folds its own leaves and touches the frontier, nothing that was committed before is read.
Roots are those of ``digest.merkle_root`` over all leaves: padded to a power of two.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexvigil.operators.digest import EMPTY_ROOT, _depth, _pad_hash, _parents
from hexvigil.session import cut_lineage

NODE = "height int, idx long, hash string"


def _pair(left: str, right: str) -> str:
    return hashlib.sha256((left + right).encode()).hexdigest()


@dataclass(frozen=True)
class Frontier:
    """How many leaves are committed and, by height, the root of the complete subtree that ends the leaves there."""

    count: int = 0
    peaks: dict[int, str] = field(default_factory=dict)

    def partial(self) -> dict[int, str]:
        """By height the node right of the complete ones, where it holds leaves; pads fill the rest."""
        out, now = {}, None
        for t in range(_depth(self.count)):
            if self.count >> t & 1:
                now = _pair(self.peaks[t], now or _pad_hash(t))
            elif now is not None:
                now = _pair(now, _pad_hash(t))
            if now is not None:
                out[t + 1] = now
        return out

    def root(self) -> str:
        if not self.count:
            return EMPTY_ROOT
        depth = _depth(self.count)
        return self.peaks[depth] if self.count == 1 << depth else self.partial()[depth]


def append_leaves(frontier: Frontier, leaves: DataFrame, block_bits: int = 10) -> tuple[DataFrame, Frontier]:
    """The nodes (height, idx, hash) that ``leaves(place, leaf_hash)`` complete, leaves included, and the frontier after them.

    ``place`` numbers the new leaves from 0.  Blocks of 2^block_bits nodes fold in parallel, as many as the new leaves
    fill; where the first block begins before them, the frontier's subtrees stand for what is already committed.  The
    driver gets the new frontier only.
    """
    start = frontier.count
    level = cut_lineage(leaves.select((F.col("place").cast("long") + start).alias("idx"), F.col("leaf_hash").alias("hash")))
    added = level.count()
    total, bits, height = start + added, block_bits, 0
    nodes = level.select(F.lit(0).alias("height"), "idx", "hash")
    size = 1 << bits
    while (total >> height) > (start >> height) or height == 0:
        first, known = start >> (height + bits), start >> height
        blocks = (
            level.groupBy(F.shiftright("idx", bits).alias("block"))
            .agg(F.min("idx").alias("least"), F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("x"))
            .select("block", (F.col("least") - F.shiftleft("block", bits)).cast("int").alias("skip"), F.transform("x", lambda e: e.getField("hash")).alias("x"))
        )
        none = F.lit(None).cast("string")
        padded = F.concat(F.array_repeat(none, F.col("skip")), F.col("x"), F.array_repeat(none, F.lit(size) - F.col("skip") - F.size("x")))
        blocks = blocks.select("block", padded.alias("l0"))
        for k in range(bits + 1):
            here = F.col("l0") if k == 0 else _parents(F.col(f"l{k - 1}"), size >> k)
            at = (known >> k) - 1 - (first << (bits - k))  # the place of this height's peak in the first block
            if height + k in frontier.peaks and k < bits and 0 <= at:
                here = _with(here, F.col("block") == first, at, frontier.peaks[height + k])
            blocks = blocks.withColumn(f"l{k}", here)
        blocks = cut_lineage(blocks)
        for k in range(1, bits + 1):
            found = blocks.select("block", F.posexplode(f"l{k}").alias("i", "hash")).where("hash is not null")
            found = found.select(F.lit(height + k).alias("height"), (F.shiftleft("block", bits - k) + F.col("i")).alias("idx"), "hash")
            old = (start >> (height + k)) - 1
            nodes = nodes.unionByName(found.where(F.col("idx") > old))
        level = blocks.select(F.col("block").alias("idx"), F.get(f"l{bits}", F.lit(0)).alias("hash")).where("hash is not null")
        height += bits
        if level.isEmpty():
            break
    nodes = cut_lineage(nodes)
    wanted = {t: (total >> t) - 1 for t in range(total.bit_length()) if total >> t & 1}
    kept = {t: h for t, h in frontier.peaks.items() if wanted.get(t) == (start >> t) - 1}
    fresh = [t for t in wanted if t not in kept]
    if fresh:
        test = F.lit(False)
        for t in fresh:
            test = test | ((F.col("height") == t) & (F.col("idx") == wanted[t]))
        kept |= {r["height"]: r["hash"] for r in nodes.where(test).collect()}
    return nodes, Frontier(total, kept)


def _with(hashes: Column, where: Column, at: int, peak: str) -> Column:
    """The array with ``peak`` at place ``at`` in the row that ``where`` names."""
    return F.when(where, F.transform(hashes, lambda h, i: F.when(i == at, F.lit(peak)).otherwise(h))).otherwise(hashes)


def paths(frontier: Frontier, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(height, idx)`` with ``path``: the siblings from the node up to the root of the first ``frontier.count`` leaves.

    A sibling is a complete node of the table, the one node of its height that is partly filled, or padding; a path takes
    one lookup per height in the table.
    """
    depth, partial = _depth(frontier.count), frontier.partial()
    spark = nodes.sparkSession
    edge = [(t, frontier.count >> t, partial[t]) for t in range(depth) if t in partial]
    pads = spark.createDataFrame([(t, _pad_hash(t)) for t in range(max(depth, 1))], "t int, pad string")
    partly = spark.createDataFrame(edge, "t int, sibling long, partly string")
    asked = (
        wanted.select("height", "idx").distinct()
        .withColumn("t", F.explode(F.expr(f"CASE WHEN height < {depth} THEN sequence(height, {depth - 1}) ELSE array() END").cast("array<int>")))
        .withColumn("sibling", F.expr("shiftright(idx, t - height)").bitwiseXOR(F.lit(1).cast("long")))
    )
    # A later frontier may have completed more; nodes that end beyond the count aren't complete at it.
    complete = nodes.where(F.expr(f"shiftleft(idx + 1, height) <= {frontier.count}")).select(F.col("height").alias("t"), F.col("idx").alias("sibling"), "hash")
    found = asked.join(complete, ["t", "sibling"], "left").join(partly, ["t", "sibling"], "left").join(pads, "t")
    steps = found.groupBy("height", "idx").agg(F.array_sort(F.collect_list(F.struct("t", F.coalesce("hash", "partly", "pad").alias("h")))).alias("x"))
    path = F.coalesce(F.transform("x", lambda e: e.getField("h")), F.array().cast("array<string>"))
    return wanted.select("height", "idx").distinct().join(steps, ["height", "idx"], "left").select("height", "idx", path.alias("path"))


def folded(frame: DataFrame) -> Column:
    """The root that ``hash`` of node ``idx`` leads to by ``path``."""
    step = F.transform("path", lambda h, k: F.struct(h.alias("h"), F.expr("0").cast("int").alias("z"), k.alias("k")))
    return F.aggregate(
        step,
        F.struct(F.col("hash").alias("h"), F.col("idx").alias("i")),
        lambda acc, x: F.struct(
            F.when(acc.getField("i") % 2 == 1, F.sha2(F.concat(x.getField("h"), acc.getField("h")), 256))
            .otherwise(F.sha2(F.concat(acc.getField("h"), x.getField("h")), 256)).alias("h"),
            F.shiftright(acc.getField("i"), 1).alias("i"),
        ),
    ).getField("h")


def inclusion(frontier: Frontier, nodes: DataFrame, block_bits: int = 10) -> DataFrame:
    """(leaf_index, leaf_hash, path, root) of every committed leaf against the frontier's root.

    The nodes below ``block_bits`` meet once, in blocks of 2^block_bits leaves, where every leaf finds its siblings at their
    places; only the blocks' own paths are looked up height by height.  No leaf is moved once a height.
    """
    depth, partial, count = _depth(frontier.count), frontier.partial(), frontier.count
    low, root = min(block_bits, depth), F.lit(frontier.root()).alias("root")
    complete = nodes.where(F.expr(f"shiftleft(idx + 1, height) <= {count}"))
    if low == 0:
        return complete.where("height = 0").select(
            F.col("idx").alias("leaf_index"), F.col("hash").alias("leaf_hash"), F.array().cast("array<string>").alias("path"), root
        )
    inner = complete.where(F.col("height") < low).select(F.expr(f"shiftright(idx, {low} - height)").alias("block"), "height", "idx", "hash")
    blocks = inner.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("height", "idx", "hash"))).alias("x"))
    blocks = blocks.select("block", F.transform("x", lambda e: e.getField("hash")).alias("x"))
    wanted = blocks.select(F.lit(low).alias("height"), F.col("block").alias("idx"))
    above = paths(frontier, nodes.where(F.col("height") >= low), wanted).select(F.col("idx").alias("block"), F.col("path").alias("up"))

    def first(k: int) -> Column:
        return F.shiftleft("block", low - k)

    def held(k: int) -> Column:
        """How many complete nodes of height ``k`` the block has: they fill it from the left."""
        return F.greatest(F.lit(0), F.least(F.lit(1 << (low - k)), F.lit(count >> k) - first(k))).cast("int")

    begins = [F.lit(0)]
    for k in range(low):
        begins.append(begins[-1] + held(k))
    each = blocks.join(above, "block").select(
        "block", "x", "up", F.array(*begins).alias("at"), F.explode(F.sequence(F.lit(0), held(0) - 1)).alias("i")
    )

    def sibling(k: int) -> Column:
        place = F.shiftright("i", k).bitwiseXOR(F.lit(1))
        begin, end = F.get("at", F.lit(k)), F.get("at", F.lit(k + 1))
        edge = F.when(first(k) + place == count >> k, F.lit(partial[k])) if k in partial else F.lit(None).cast("string")
        return F.when(begin + place < end, F.get("x", begin + place)).otherwise(F.coalesce(edge, F.lit(_pad_hash(k))))

    return each.select(
        (first(0) + F.col("i")).alias("leaf_index"),
        F.get("x", F.col("i")).alias("leaf_hash"),
        F.concat(F.array(*[sibling(k) for k in range(low)]), "up").alias("path"),
        root,
    )


def consistency(old: Frontier, new: Frontier, nodes: DataFrame) -> DataFrame:
    """The proof that the tree of ``new`` begins with that of ``old``: the old subtrees, each with its path to the new root."""
    spark = nodes.sparkSession
    peaks = spark.createDataFrame([(t, (old.count >> t) - 1, h) for t, h in sorted(old.peaks.items())], NODE)
    return peaks.join(paths(new, nodes, peaks.select("height", "idx")), ["height", "idx"])


def is_consistent(proof: DataFrame, old_count: int, old_root: str, new_root: str) -> bool:
    """Whether the proof's subtrees make the old root and each leads to the new one; needs no table of nodes."""
    rows = proof.select("height", "idx", "hash", (folded(proof) == new_root).alias("leads")).collect()  # one a bit of the count
    peaks = {r["height"]: r["hash"] for r in rows}
    if sorted(peaks) != [t for t in range(old_count.bit_length()) if old_count >> t & 1] or not all(r["leads"] for r in rows):
        return False
    return all(r["idx"] == (old_count >> r["height"]) - 1 for r in rows) and Frontier(old_count, peaks).root() == old_root
