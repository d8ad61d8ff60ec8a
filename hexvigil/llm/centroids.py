"""Centroid clustering over subvector dictionaries, in exact integer arithmetic.

Vectors are encoded once: each Arrow batch of rows becomes a segment that cuts the dimensions into blocks and keeps, for
every block, the distinct subvectors that occur (its dictionary) and one code per row.  Nothing is lost, so a round
computes the squared distance of each dictionary entry to each centroid's block once and adds up the partial distances
by code.  A segment picks the block width that makes this cheapest: equal vectors end in one entry of full width,
unrelated ones in entries of one or two dimensions.  Its dictionaries hold no more entries than it has rows, so memory
is bounded whatever the table holds, and no dictionary is broadcast.  New centroids come from counts of codes per
cluster; a round shuffles only the sums of each task (clusters x dimensions) and its lineage starts at the checkpointed
segments.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexvigil.session import cut_lineage

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Below this size of components, squared distances fit 64 bits; segments and centroids beyond it use Python's integers.
SMALL = 1 << 27
#: Sums travel in parts of so many bits, which decimals of 38 digits add without overflow.
LIMB = 96
LONGEST = (1 << 63) - 1
#: What one dimension of a dictionary entry costs (subtract, square, add) beside looking up one code.
STEP = 3

_SEGMENT = "ids array<long>, width int, sizes array<int>, entries binary, codes binary"


def eligible(vector: str, dimensions: int) -> Column:
    """Vectors with exactly so many components, none of them null, NaN or infinite."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(x) == dimensions) & finite, F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) exactly: 64-bit integers, or Python's where they don't fit."""
    if not x.size or np.abs(x).max() < 1 << 44:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([math.floor(v * SCALE) if abs(v) < 1 << 53 else int(v) * SCALE for v in x.ravel().tolist()], object).reshape(x.shape)


def _rounded(x: np.ndarray) -> np.ndarray:
    """The doubles that stand for the integers, so that components of one integer are one dictionary entry."""
    return np.where(np.abs(x) < 1 << 44, np.floor(x * SCALE) / SCALE, x)


def _dictionaries(x: np.ndarray):
    """(width, codes by row and block, row of the first occurrence of each entry by block), the cheapest width of all.

    A wider block's codes come from pairs of narrower ones; blocks that don't pair up stay as they are.
    """
    n, dims = x.shape
    found = [np.unique(x[:, d], return_index=True, return_inverse=True)[1:] for d in range(dims)]
    width, best = 1, None
    while True:
        firsts, codes = [f for f, _ in found], np.stack([c.ravel() for _, c in found], 1)
        cost = STEP * sum(len(f) for f in firsts) * width + n * len(found)
        if best is None or cost < best[0]:
            best = cost, width, codes, firsts
        if len(found) % 2 or len(found) == 1:
            return best[1:]
        found = [
            np.unique(a * np.int64(len(g)) + b, return_index=True, return_inverse=True)[1:]
            for (_, a), (g, b) in zip(found[0::2], found[1::2], strict=True)
        ]
        width *= 2


def _encode(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _rounded(pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        width, codes, firsts = _dictionaries(x)
        entries = b"".join(x[rows, b * width : (b + 1) * width].tobytes() for b, rows in enumerate(firsts))
        ids = pa.ListArray.from_arrays([0, batch.num_rows], batch.column("id"))
        yield pa.RecordBatch.from_arrays(
            [
                ids, pa.array([width], pa.int32()), pa.array([[len(f) for f in firsts]], pa.list_(pa.int32())),
                pa.array([entries], pa.binary()), pa.array([codes.astype(np.uint32).tobytes()], pa.binary()),
            ],
            ["ids", "width", "sizes", "entries", "codes"],
        )


def _segments(batches):
    """(ids, block width, dictionaries as integers, codes) of each segment."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            values = integers(np.frombuffer(row.entries, np.float64))
            cuts = np.cumsum(np.asarray(row.sizes) * row.width)[:-1]
            tables = [t.reshape(-1, row.width) for t in np.split(values, cuts)]
            yield row.ids, row.width, tables, np.frombuffer(row.codes, np.uint32).reshape(-1, len(tables)).astype(np.int64)


def _nearest(width: int, tables: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray):
    """Each row's nearest centroid and squared distance, from the partial distances of its codes."""
    small = centroids.dtype != object and all(t.dtype != object and np.abs(t).max(initial=0) < SMALL for t in tables)
    kind = np.int64 if small else object
    total = np.zeros((len(codes), len(centroids)), kind)
    for b, entries in enumerate(tables):
        partial = np.zeros((len(entries), len(centroids)), kind)
        for d in range(width):
            away = entries[:, d, None].astype(kind) - centroids[None, :, b * width + d].astype(kind)
            partial += away * away
        total += partial[codes[:, b]]
    cluster = total.argmin(1).astype(np.int64)
    return cluster, total[np.arange(len(codes)), cluster]


def _summer(centroids: np.ndarray):
    """Per task the count of each cluster (dim -1) and its sum in each dimension, in parts of LIMB bits."""
    k, dims = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for _, width, tables, codes in _segments(batches):
            cluster, _ = _nearest(width, tables, codes, centroids)
            counts += np.bincount(cluster, minlength=k)
            for b, entries in enumerate(tables):
                often = np.bincount(cluster * len(entries) + codes[:, b], minlength=k * len(entries)).reshape(k, -1)
                kind = entries.dtype if np.abs(entries).max(initial=0) < SMALL else object
                sums[:, b * width : (b + 1) * width] += (often.astype(kind) @ entries.astype(kind)).astype(object)
        out = [(c, -1, 0, str(counts[c])) for c in np.flatnonzero(counts)]
        for c in np.flatnonzero(counts):
            for d, value in enumerate(sums[c]):
                sign, value, limb = (-1 if value < 0 else 1), abs(int(value)), 0
                while value or not limb:
                    out.append((c, d, limb, str(sign * (value & ((1 << LIMB) - 1)))))
                    value, limb = value >> LIMB, limb + 1
        yield pd.DataFrame(out, columns=["cluster", "dim", "limb", "part"])

    return run


def _assigner(centroids: np.ndarray):
    def run(batches):
        for ids, width, tables, codes in _segments(batches):
            cluster, distance = _nearest(width, tables, codes, centroids)
            distance = np.minimum(distance, LONGEST).astype(np.int64)
            yield pd.DataFrame({"vec_id": pd.array(ids, "Int64"), "cluster": cluster, "distance": distance})

    return run


def _exact(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < SMALL for row in rows for v in row)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), -1)


def _moved(segments: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of each non-empty cluster's mean.  The driver gets clusters x dimensions sums."""
    parts = segments.mapInPandas(_summer(centroids), "cluster int, dim int, limb int, part string")
    sums: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():
        key = r["cluster"], r["dim"]
        sums[key] = sums.get(key, 0) + (int(r["part"]) << (LIMB * r["limb"]))
    return _exact([
        [sums[c, d] // sums[c, -1] if (c, -1) in sums else int(v) for d, v in enumerate(row)] for c, row in enumerate(centroids)
    ])


def cluster_vectors(
    rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector with exactly ``dimensions`` finite components, and the centroids.

    Components count as floor(256 * x).  Centroids start as the vectors with the smallest sha256 of ``seed:id``; ids
    that repeat go by their vectors.  Each of ``rounds`` rounds assigns every vector to the nearest centroid (squared
    distance, ties to the smaller number) and moves every non-empty centroid to the componentwise floor of the mean;
    then vectors are assigned once more.  Other vectors (null, shorter, longer, not finite) give no row.  Repeated rows
    count each time; a null id takes part, hashed as empty text.  With fewer vectors than ``clusters`` each is a
    centroid; an empty table gives no rows and no centroids.  Distances beyond a long are given as the largest long.
    Other columns are ignored.
    """
    kept = rows.filter(eligible(vector, dimensions)).select(
        F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    )
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(place.alias("place"), "v").orderBy("place", "v").limit(clusters).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dimensions), np.int64)
    centroids = _exact([[int(c) for c in integers(np.array(r["v"]))] for r in first])
    segments = cut_lineage(kept.mapInArrow(_encode, _SEGMENT))
    for _ in range(rounds):
        centroids = _moved(segments, centroids)
    return segments.mapInPandas(_assigner(centroids), "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (sums of distance) and centroid_sha256; one row per cluster is sent to the tasks."""
    assigned = cut_lineage(assigned)
    spark = assigned.sparkSession
    sums = {
        r["cluster"]: int(r["total"])
        for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    }
    whole = min(sum(sums.values()), LONGEST)
    facts = [
        (c, min(sums.get(c, 0), LONGEST), whole, hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest())
        for c, row in enumerate(centroids)
    ]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r,
 list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM k
 QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) <= {CLUSTERS})""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS m FROM
 (SELECT k.r, k.vec_id, k.v, c.c, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM k, c{i} c) GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (SELECT m.c AS c, i, sum(v[i]) AS s, count(*) AS n
 FROM a{i}, range(1, {DIMENSIONS + 1}) g(i) GROUP BY 1, 2) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.m.c"""


ORACLE = _oracle()
