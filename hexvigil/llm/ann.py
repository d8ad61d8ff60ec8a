"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, each time by another random rotation and shift, and ordered by their place
on a Hilbert curve.  Each ordering is range-partitioned into blocks of about BLOCK_ROWS rows; a query meets the rows of
its own and the neighbouring blocks, blocked matrix products score them exactly, and the best of all orderings merge.

How many orderings and how many blocks on either side is measured, not set: a few queries are answered by brute force,
and of all choices that would have met the wanted share of their neighbours the one with the fewest products is taken.
Where vectors lie in clusters that is a few blocks whatever the table's size, so a row is shuffled once an ordering and a
query a few times.  Where nothing tells near from far (isotropic vectors) no window is narrow, and the choice ends at one
ordering whose window is the table: never more products than an exhaustive search.

Largest inner products become nearest neighbours on a sphere by one more component that fills every vector up to the
largest norm.  Equal vectors are one point of the curve, with the few smallest ids that a result can name.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexvigil.llm.common import mix
from hexvigil.llm.vectors import common_length, cuts, stacked, usable
from hexvigil.session import cut_lineage

ORDERINGS = 24
DIMENSIONS, CURVE_BITS, TIE_BITS = 6, 8, 15
#: Rows of a block, and blocks of an ordering at most: the driver holds their bounds.
BLOCK_ROWS, MOST_BLOCKS = 2048, 4096
#: Queries that are answered by brute force to choose the windows, and the share of their neighbours that must be met.
SAMPLE, TARGET = 64, 0.96
#: Numbers of orderings that are tried.
CHOICES = (1, 2, 3, 4, 6, 8, 12, 16, 24)
#: Rows and queries that meet in one matrix product.
ROWS, ASKED = 20_000, 5_000
SEED = 20


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (rows of coordinates below 2**bits), by Skilling's transform."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    for q in range(bits - 1, 0, -1):
        low = np.uint64((1 << q) - 1)
        for i in range(n):
            high = (x[i] >> np.uint64(q)) & np.uint64(1) == 1
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(q)) & np.uint64(1) == 1, np.uint64((1 << q) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for q in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(q)) & np.uint64(1))
    return key


def _keyer(length: int, top: float, orderings: int):
    def keys(vectors: np.ndarray, tie: np.ndarray) -> np.ndarray:
        fill = np.sqrt(np.maximum(top * top - (vectors**2).sum(1), 0))
        points = np.c_[vectors, fill] / max(top, 1e-300)
        rng, out = np.random.default_rng(SEED), []
        for _ in range(orderings):
            turn = np.linalg.qr(rng.standard_normal((length + 1, min(DIMENSIONS, length + 1))))[0]
            shift = rng.random(turn.shape[1])
            spread = points @ turn * sqrt(length + 1)
            even = 1 / (1 + np.exp(-1.702 * spread))  # near the normal distribution function
            cells = np.minimum((even + shift) / 2 * (1 << CURVE_BITS), (1 << CURVE_BITS) - 1)
            out.append((hilbert(cells, CURVE_BITS).astype(np.int64) << TIE_BITS) | tie)
        return np.stack(out, 1)

    def run(batches):
        for batch in batches:
            vectors = np.array(batch["vector"].tolist(), np.float64).reshape(len(batch), length)
            tie = (mix(batch["rep"].to_numpy().astype(np.uint64)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
            found = list(keys(vectors, tie)) if len(batch) else []
            yield batch.assign(vector=[v.tobytes() for v in vectors], keys=found)

    return run


def _dealer(edges: np.ndarray, subs: int, chunks: int, reach: int):
    """Rows to their block of each ordering, queries to the blocks around theirs."""
    blocks = edges.shape[1] + 1

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack(batch["keys"].to_list())
            spread = mix(batch["rep"].to_numpy().astype(np.uint64) + np.uint64(SEED))
            sub, chunk = (spread % np.uint64(subs)).astype(int), (spread >> np.uint64(32)) % np.uint64(chunks)
            rows = batch[["rep", "vector"]]
            asked = np.flatnonzero(batch["asked"].to_numpy(bool))
            for o in range(len(edges)):
                block = np.searchsorted(edges[o], keys[:, o], "right")
                for c in range(chunks):
                    yield rows.assign(ordering=o, block=block, sub=sub, chunk=c, query=False)
                for step in range(-min(reach, blocks), min(reach, blocks) + 1):
                    to = block[asked] + step
                    there = (to >= 0) & (to < blocks)
                    if not there.any():
                        continue
                    at = asked[there]
                    for s in range(subs):
                        yield rows.iloc[at].assign(ordering=o, block=to[there], sub=s, chunk=chunk[at].astype(int), query=True)

    return run


def _matcher(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        queries, rows = group[group["query"]], group[~group["query"]].sort_values("rep")
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query": [], "found": [], "score": []}).astype({"query": "int64", "found": "int64"})
        ids, asked = rows["rep"].to_numpy(), queries["rep"].to_numpy()
        matrix, out = stacked(rows["vector"]).T, []
        ours = stacked(queries["vector"])
        for lo in range(0, len(asked), 256):
            scores = ours[lo : lo + 256] @ matrix
            least = -np.partition(-scores, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            q, r = np.nonzero(scores >= least[:, None])
            value = scores[q, r]
            order = np.lexsort((ids[r], -value, q))
            q, r, value = q[order], r[order], value[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            out.append(pd.DataFrame({"query": asked[lo + q], "found": ids[r], "score": value})[nth < k])
        return pd.concat(out)

    return run


def _brute(ids: np.ndarray, queries: np.ndarray, k: int):
    """For each batch its nearest rows to the sampled queries, with their keys."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            rep, scores = batch["rep"].to_numpy(), queries @ stacked(batch["vector"]).T
            scores[ids[:, None] == rep] = -np.inf
            n = min(k, len(rep))
            top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            q = np.repeat(np.arange(len(ids)), n)
            out = pd.DataFrame({"q": q, "rep": rep[top.ravel()], "score": scores[q, top.ravel()], "keys": list(batch["keys"].iloc[top.ravel()])})
            yield out[np.isfinite(out["score"])]

    return run


def windows(keyed: DataFrame, edges: np.ndarray, k: int, sample: int = SAMPLE, target: float = TARGET) -> tuple[int, int, float]:
    """(orderings, reach, share met): the choice with the fewest products that meets ``target`` of the sample's neighbours.

    The sample is ``sample`` queries by a hash of their id, the neighbours their ``k`` nearest of all rows, so the driver
    gets sample x k keys.
    """
    asked = keyed.filter("asked").orderBy(F.xxhash64("rep"), "rep").limit(sample).select("rep", "vector", "keys").collect()
    if not asked:
        return 1, 0, 1.0
    ids, queries = np.array([r["rep"] for r in asked], np.int64), stacked([r["vector"] for r in asked])
    best = W.partitionBy("q").orderBy(F.desc("score"), "rep")
    near = keyed.mapInPandas(_brute(ids, queries, k), "q int, rep long, score double, keys array<long>")
    near = near.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).select("q", "keys").collect()
    if not near:
        return 1, 0, 1.0
    place = lambda keys: np.stack([np.searchsorted(e, keys[:, o], "right") for o, e in enumerate(edges)], 1)
    own, found = place(np.array([r["keys"] for r in asked])), place(np.array([r["keys"] for r in near]))
    apart, blocks = np.abs(found - own[[r["q"] for r in near]]), edges.shape[1] + 1
    tried = []
    for o in sorted({min(c, len(edges)) for c in CHOICES}):
        least = np.sort(apart[:, :o].min(1))
        reach = int(least[min(len(least) - 1, ceil(target * len(least)) - 1)])
        tried.append((o * min(2 * reach + 1, blocks), o, reach, float((least <= reach).mean())))
    return min(tried)[1:]


def nearest(
    rows: DataFrame, every: int = 20, k: int = 20, orderings: int = ORDERINGS, reach: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """For each row of (vec_id, embedding) whose vec_id ``every`` divides, its ``k`` largest inner products with other rows.

    Returns query_id, rank (from 1), vec_id and score, nearest first, ties to the smaller vec_id; the score is exact,
    in double precision.  Rows whose id is null or whose vector is null, zero, holds null or non-finite components, or
    has another than the commonest length take no part; rows that repeat an id and a vector count once, and a query
    never finds its own id.  More rows than ``k`` may tie; fewer are returned only where fewer exist or are met.

    ``orderings`` is how many are made; how many of them count and how many blocks on either side a query meets comes
    from ``windows``, unless ``reach`` is given.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(usable("vector", "vec_id"))
    length = common_length(rows, "vector")
    rows = rows.filter(F.size("vector") == length).withColumn("asked", F.col("vec_id") % every == 0)
    # Of equal vectors the k + 1 smallest ids suffice, asked or not; the limit is applied before the shuffle.
    own = W.partitionBy("vector", "asked").orderBy("vec_id")
    few = rows.withColumn("nth", F.dense_rank().over(own)).filter(F.col("nth") <= k + 1).drop("nth")
    points = few.groupBy("vector").agg(
        F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked")
    )
    points = points.withColumn("rep", F.element_at("ids", 1))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c)
    total, asked, top = points.agg(F.count("*"), F.count(F.when(F.col("asked"), 1)), F.max(F.sqrt(norm))).first()
    keyed = cut_lineage(
        points.mapInPandas(_keyer(length, top or 1.0, orderings), "rep long, ids array<long>, asked boolean, vector binary, keys array<long>")
    )
    blocks = min(MOST_BLOCKS, max(1, ceil(total / block_rows)))
    edges = cuts(keyed, "keys", orderings, blocks)
    if reach is None:
        used, reach, _ = windows(keyed, edges, k)
        # Wide windows are few large blocks: what a query gets from each is ``k`` rows, whatever the table's size.
        melt = max(1, reach // 2)
        edges, reach = edges[:used, melt - 1 :: melt], ceil(reach / melt)
        blocks = edges.shape[1] + 1
    subs, chunks = max(1, ceil(total / blocks / ROWS)), max(1, ceil(asked * min(2 * reach + 1, blocks) / blocks / ASKED))
    dealt = keyed.mapInPandas(
        _dealer(edges, subs, chunks, reach),
        "ordering int, block int, sub int, chunk int, query boolean, rep long, vector binary",
    )
    met = dealt.groupBy("ordering", "block", "sub", "chunk").applyInPandas(_matcher(k + 1), "query long, found long, score double")
    best = W.partitionBy("query").orderBy(F.desc("score"), "found")
    near = (
        met.groupBy("query", "found").agg(F.max("score").alias("score"))
        .withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
        .join(keyed.select(F.col("rep").alias("found"), "ids"), "found")
        .select("query", "score", F.explode("ids").alias("vec_id"))
    )
    by_id = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1).drop("nth")
    named = points.filter("asked").select("vector", F.col("rep").alias("query"))
    queries = rows.filter("asked").join(named, "vector").select(F.col("vec_id").alias("query_id"), "query").distinct()
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(near, "query").filter("vec_id <> query_id")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
