"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors of a label lexicographically by the sign bits of random projections, a pass's bits being
new ones, and there are as many as the labels need (``_enough``).  The order is cut into even slices, each with the slice before it, and a window slides over the sorted rows:
a row is compared with the rows of its own and the previous window, in matrix products.  Verified pairs of all passes
unite to components, and within each component all members are compared in blocks, so that links are counted in full
whether or not a window met them.  Equal vectors are one point.
"""

from __future__ import annotations

from math import ceil, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexvigil.llm.common import components, mix, thinned
from hexvigil.llm.vectors import common_length, cuts, local_roots, stacked, usable
from hexvigil.session import cut_lineage

#: Parts that the members of a large component are spread over to meet its size.
SALTS = 32
COSINE = 0.93
#: Passes at least, and the share of pairs at the threshold that all passes together may miss.
PASSES, MISSED = 16, 0.001
#: Key of a row in a pass: label hash, sign bits, and a hash of the id that tells rows with equal bits apart.
LABEL_BITS, SIGN_BITS, TIE_BITS = 18, 30, 15
WINDOW = 512
#: Rows of a slice, and slices at most; with more rows slices grow, the window does not.
SLICE, SLICES = 4096, 4096
#: Members that are compared in one matrix product, and members of small components that go to one task.
BLOCK, BUNDLE = 1024, 8192
SEED = 5


def _units(vectors, length: int) -> np.ndarray:
    vectors = np.array(vectors.tolist(), np.float64).reshape(len(vectors), length)
    vectors = vectors / np.abs(vectors).max(1, initial=0, keepdims=True)  # no overflow in the norm
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _totals(length: int):
    """For each label of a batch the sum of its unit vectors, and how many they are as one more component."""

    def run(batches):
        for batch in batches:
            codes, labels = pd.factorize(batch["label"])
            sums = np.zeros((len(labels), length + 1))
            np.add.at(sums, codes, np.c_[_units(batch["vector"], length), np.ones(len(batch))])
            yield pd.DataFrame({"label": np.asarray(labels, np.int64), "sums": list(sums)})

    return run


def _enough(points: DataFrame, length: int, cosine: float, passes: int, window: int) -> int:
    """``passes``, or as many as miss at most ``MISSED`` of the pairs at the threshold in any label.

    Around a mean of squared length c, vectors at ``cosine`` are at (cosine - c) / (1 - c), and a sign bit tells them
    apart with their angle over pi.  They share a window if the bits agree that cut the label down to a window.  Labels
    of one window are met whole, and where even c reaches the threshold, nearly all vectors link.
    """
    sums = points.select("label", "vector").mapInPandas(_totals(length), "label long, sums array<double>")
    sums = sums.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    size = F.max(F.when(F.col("at") == length, F.col("v")))
    square = F.sum(F.when(F.col("at") < length, F.col("v") * F.col("v")))
    found = sums.groupBy("label").agg(size.alias("n"), square.alias("s")).filter(F.col("n") > window)
    found = found.withColumn("c", F.col("s") / (F.col("n") * F.col("n"))).filter(F.col("c") < cosine)
    agree = 1 - F.acos((F.lit(cosine) - F.col("c")) / (1 - F.col("c"))) / pi
    shared = F.pow(agree, F.log2(F.col("n") / window))
    most = found.agg(F.max(F.ceil(log(MISSED) / F.log1p(-shared)))).first()[0]
    return max(passes, int(most or 0))


def _keyer(length: int, passes: int):
    def run(batches):
        turns = np.random.default_rng(SEED).standard_normal((passes, length, SIGN_BITS))
        weights = 1 << np.arange(SIGN_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            vectors = _units(batch["vector"], length)
            tie = (mix(batch["rep"].to_numpy().astype(np.uint64)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
            label = (mix(batch["label"].to_numpy().astype(np.uint64)) >> np.uint64(64 - LABEL_BITS)).astype(np.int64)
            keys = [
                (((label << SIGN_BITS) | ((vectors @ turn > 0) @ weights)) << TIE_BITS) | tie for turn in turns
            ]
            yield batch.assign(vector=[v.tobytes() for v in vectors], keys=list(np.stack(keys, 1)) if len(batch) else [])

    return run


def _slicer(edges: np.ndarray):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack(batch["keys"].to_list())
            rows = batch[["rep", "label", "vector"]]
            for p in range(len(edges)):
                piece = np.searchsorted(edges[p], keys[:, p], "right")
                own = rows.assign(nth_pass=p, piece=piece, key=keys[:, p])
                yield own
                yield own.assign(piece=piece + 1)

    return run


def _window(cosine: float, window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "rep"])
        ids, labels, vectors = rows["rep"].to_numpy(), rows["label"].to_numpy(), stacked(rows["vector"])
        out = []
        for lo in range(0, len(ids), window):
            at = slice(max(0, lo - window), lo + window)
            linked = (vectors[at] @ vectors[at].T >= cosine) & (labels[at][:, None] == labels[at])
            if linked.sum() > len(linked):
                root = local_roots(linked)
                more = np.flatnonzero(root != np.arange(len(root)))
                out.append(pd.DataFrame({"a": ids[at][more], "b": ids[at][root[more]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}).astype("int64")

    return run


def _counter(cosine: float):
    """Links of each member with members of other points; each is weighed by how many rows its point has."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.groupby("root"):
            ids, n, vectors, left = group["rep"].to_numpy(), group["n"].to_numpy(), stacked(group["vector"]), group["left"].to_numpy()
            right = group["right"].to_numpy()
            a, b = np.flatnonzero(left), np.flatnonzero(right)
            for lo in range(0, len(a), BLOCK):
                part = a[lo : lo + BLOCK]
                linked = (vectors[part] @ vectors[b].T >= cosine) & (ids[part][:, None] != ids[b])
                out.append(pd.DataFrame({"rep": ids[part], "links": linked @ n[b]}))
        return pd.concat(out)

    return run


def link_vectors(rows: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """One row per row of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their vectors' cosine, in double precision, is at least
    ``cosine``.  ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id that links
    reach, ``kept`` tells whether it is the row's own.  Rows with a null id or label, or a vector that is null, zero,
    holds null or non-finite components, or has another than the commonest length link with nothing; a null id has a
    null component and is kept.  Rows that repeat an id and a vector count as other rows and are all kept if its
    component is theirs.  Large labels get more than ``passes`` passes.
    """
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label")
    )
    part = rows.filter(usable("vector", "vec_id") & F.col("label").isNotNull())
    length = common_length(part, "vector")
    part = part.filter(F.size("vector") == length)
    points = cut_lineage(part.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    passes = _enough(points, length, cosine, passes, window)
    keyed = cut_lineage(
        points.mapInPandas(_keyer(length, passes), "label long, vector binary, rep long, n long, keys array<long>")
    )
    pieces = min(SLICES, ceil(keyed.count() / SLICE) or 1)
    sliced = keyed.mapInPandas(
        _slicer(cuts(keyed, "keys", passes, pieces)), "nth_pass int, piece int, key long, rep long, label long, vector binary"
    )
    edges = sliced.groupBy("nth_pass", "piece").applyInPandas(_window(cosine, window), "a long, b long")
    roots = cut_lineage(components(thinned(edges)).withColumnRenamed("node", "rep"))

    # All members of a component meet, block by block; small components share a task.
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("blocks > 1")
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = roots.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(spread, ["root", "salt"], "left")
    members = members.select("rep", "root", F.coalesce("blocks", F.lit(1)).cast("long").alias("blocks")).join(keyed.select("rep", "label", "n", "vector"), "rep")
    bundles = max(1, ceil(roots.count() / BUNDLE))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = members.withColumn("block", block).withColumn("other", each)
    both = F.struct(F.col("block").alias("i"), F.col("other").alias("j"), F.lit(True).alias("left"), (F.col("block") == F.col("other")).alias("right"))
    away = F.struct(F.col("other").alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    dealt = dealt.withColumn("way", F.explode(F.when(F.col("block") == F.col("other"), F.array(both)).otherwise(F.array(both, away))))
    dealt = dealt.select("root", "rep", "n", "vector", "way.*", F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bundles))).alias("task"), (F.col("blocks") > 1).alias("large"))
    links = (
        dealt.groupBy("large", "task", "i", "j").applyInPandas(_counter(cosine), "rep long, links long")
        .groupBy("rep").agg(F.sum("links").alias("links"))
    )
    known = points.join(roots, "rep", "left").join(links, "rep", "left").select(
        "label", "vector",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "rep").alias("component_id"),
    )
    linked = part.join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    taking = usable("vector", "vec_id") & F.col("label").isNotNull() & (F.size("vector") == length)
    alone = rows.filter(~F.coalesce(taking, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
