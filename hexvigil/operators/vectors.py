"""Robust aggregation of vectors per group, and exact similarity joins.

Updates come as ``(group, client, vector[, weight])``.  A group may hold a third of
all vectors, so everything is summed or counted per (group, coordinate) with
map-side combining; no group is gathered in one task and no pair is emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexvigil import dims
from hexvigil.functions.noise import laplace, uniform
from hexvigil.functions.prefix import cumulative_counts, positions
from hexvigil.functions.vectors import as_double, cosine, norm, squared_distance
from hexvigil.session import cut_lineage


def matching_shapes(updates: DataFrame) -> DataFrame:
    """V1: drop vectors whose length differs from that of the group's first client."""
    sizes = updates.groupBy("group").agg(F.min_by(F.size("vector"), "client").alias("__len"))
    return updates.join(sizes, "group").where(F.size("vector") == F.col("__len")).drop("__len")


def coordinates(updates: DataFrame) -> DataFrame:
    return updates.select("*", F.posexplode(as_double("vector")).alias("idx", "value")).drop("vector")


def assemble(values: DataFrame, name: str = "vector") -> DataFrame:
    """(group, idx, value) back to one vector per group; its length is the dimension."""
    return values.groupBy("group").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x.getField("value")).alias(name)
    )


def weighted_mean(updates: DataFrame) -> DataFrame:
    """V1: (group, idx, value) of the mean weighted by ``weight`` (equal weights without it)."""
    w = F.col("weight").cast("double") if "weight" in updates.columns else F.lit(1.0)
    flat = coordinates(updates.withColumn("weight", w))
    return flat.groupBy("group", "idx").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def trimmed_mean(updates: DataFrame, ratio: float = 0.1) -> DataFrame:
    """V2: per coordinate, drop max(1, floor(n * ratio)) values at each end and average the rest.

    Works on counted distinct values with the number of smaller ones, so each kept
    value knows its share of the kept ranks without sorting the group.
    """
    cum = cumulative_counts(coordinates(updates), ["group", "idx"], "value")
    n = F.col("total")
    wanted = F.greatest(F.lit(1), F.floor(n * ratio))
    trim = F.when(2 * wanted >= n, F.greatest(F.lit(0), F.floor((n - 1) / 2))).otherwise(wanted)
    upper = F.least(F.col("below") + F.col("n"), n - trim)
    kept = F.greatest(F.lit(0), upper - F.greatest(F.col("below"), trim))
    return cum.groupBy("group", "idx").agg((F.sum(F.col("value") * kept) / F.sum(kept)).alias("value"))


#: Vectors of a group in one block of the farthest-neighbour search; parts that the blocks of a group are spread over.
FAR_BLOCK, FAR_SALTS = 256, 16


def _farthest(far: int):
    """For each row, a block of rivals beside a block of its group: each rival's ``far`` largest squared distances there."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own, others = np.asarray(row.vectors).reshape(len(row.clients), -1), np.asarray(row.o_vectors).reshape(len(row.o_clients), -1)
                for i, x in enumerate(own):
                    d2 = ((others - x) ** 2).sum(1)
                    d2[np.asarray(row.o_clients) == row.clients[i]] = -1.0
                    top = np.sort(d2)[::-1][:far]
                    out.append((row.group, row.clients[i], [float(v) for v in top if v >= 0]))
            yield pd.DataFrame(out, columns=["group", "client", "d2"])

    return run


def farthest_sums(placed: DataFrame, rivals: DataFrame, far: int, block: int = FAR_BLOCK) -> DataFrame:
    """(group, client, far_sum): the sum of the ``far`` largest squared distances from each rival to others of its group.

    ``placed(group, client, vector, r)`` with the distance r to the group's centre, ``rivals`` rows of it.  The vectors of
    a group lie in blocks by falling r.  Every rival meets the first block; the ``far``-th distance found there is a
    threshold, and a further block is left out once r of none of its vectors plus that of a rival exceeds it.  Blocks meet
    as rows, never vectors, and of a pair of blocks only ``far`` distances a rival come out.
    """
    top = placed.groupBy("group").agg(F.max("r").alias("__top"))
    step = F.floor((1 - F.col("r") / F.greatest(F.col("__top"), F.lit(1e-300))) * 1023)
    numbered = positions(placed.join(top, "group").withColumn("__step", step), ["group"], F.col("__step"), [F.col("r").desc(), "client"])
    numbered = cut_lineage(numbered.select("group", "client", "vector", "r", F.floor(F.col("position") / block).alias("block")))

    def blocks(rows: DataFrame) -> DataFrame:
        each = rows.groupBy("group", "block").agg(F.collect_list(F.struct("client", "vector", "r")).alias("x"), F.max("r").alias("reach"))
        part = lambda name: F.transform("x", lambda e: e.getField(name))
        return each.select("group", "block", "reach", part("client").alias("clients"), F.flatten(part("vector")).alias("vectors"), part("r").alias("radii"))

    all_blocks = cut_lineage(blocks(numbered))
    asked = cut_lineage(blocks(numbered.join(rivals.select("group", "client"), ["group", "client"], "left_semi")))
    others = all_blocks.select(
        "group", F.col("block").alias("o_block"), F.col("reach").alias("o_reach"), F.col("clients").alias("o_clients"), F.col("vectors").alias("o_vectors"),
        F.pmod(F.xxhash64("block"), F.lit(FAR_SALTS)).cast("int").alias("salt"),
    )
    kinds = dict(placed.dtypes)
    schema = f"group {kinds['group']}, client {kinds['client']}, d2 array<double>"
    columns = ["group", "clients", "vectors", "o_clients", "o_vectors"]
    first = cut_lineage(asked.join(others.where("o_block = 0"), "group").select(*columns).mapInPandas(_farthest(far), schema))
    # What a block must exceed for any of its rivals: the least of threshold minus r.
    found = numbered.select("group", "client", "r", "block").join(first, ["group", "client"])
    enough = F.when(F.size("d2") >= far, F.sqrt(F.element_at("d2", -1))).otherwise(F.lit(-1e300))
    needed = found.groupBy("group", "block").agg(F.min(enough - F.col("r")).alias("beyond"))
    salted = asked.join(needed, ["group", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(FAR_SALTS - 1))))
    rest = salted.join(others.where("o_block > 0"), ["group", "salt"]).where(F.col("o_reach") >= F.col("beyond") * (1 - 1e-12))
    every = first.unionByName(rest.select(*columns).mapInPandas(_farthest(far), schema))
    best = Window.partitionBy("group", "client").orderBy(F.col("v").desc())
    return (
        every.select("group", "client", F.explode("d2").alias("v"))
        .withColumn("__p", F.row_number().over(best))
        .where(F.col("__p") <= far)
        .groupBy("group", "client")
        .agg(F.sum("v").alias("far_sum"))
    )


def krum(updates: DataFrame, n_byzantine: int = 1) -> DataFrame:
    """V3: the client whose n - f - 2 nearest squared distances sum to least, per group, exactly.

    The sum over *all* others has the closed form n * r^2 + sum(r_j^2), with r the distance
    to the group mean, so only the f + 1 farthest have to be taken off.  Triangle bounds
    with the f + 1 largest r rule out every client that cannot win; for n clients the gap
    they leave shrinks like 1/n.  The remaining ones look for their farthest others block by
    block (``farthest_sums``).  Groups of at most 2f + 2 fall back to the mean.
    """
    far = n_byzantine + 1
    base = updates.select("group", "client", as_double("vector").alias("vector"))
    sizes = base.groupBy("group").agg(F.count("*").alias("n"))
    centre = assemble(weighted_mean(base), "centre")
    placed = cut_lineage(
        base.join(centre, "group")
        .join(sizes, "group")
        .withColumn("r2", squared_distance(F.col("vector"), F.col("centre")))
        .withColumn("r", F.sqrt("r2"))
        .drop("centre")
    )
    by_r = Window.partitionBy("group").orderBy(F.col("r").desc(), "client")
    top = (
        placed.select("group", "r", "client")
        .withColumn("__p", F.row_number().over(by_r))
        .where(F.col("__p") <= far)
        .groupBy("group")
        .agg(F.collect_list("r").alias("far_r"))
    )
    totals = placed.groupBy("group").agg(F.sum("r2").alias("sum_r2"))
    sums = placed.drop("vector").join(top, "group").join(totals, "group")
    grow = F.aggregate(
        "far_r", F.lit(0.0), lambda acc, big: acc + (F.col("r") + big) * (F.col("r") + big)
    )
    shrink = F.aggregate(
        "far_r", F.lit(0.0), lambda acc, big: acc + (F.col("r") - big) * (F.col("r") - big)
    )
    closed = F.col("n") * F.col("r2") + F.col("sum_r2")
    bounded = sums.withColumns({"closed": closed, "low": closed - grow, "high": closed - shrink})
    best = bounded.groupBy("group").agg(F.min("high").alias("__best"))
    rivals = cut_lineage(
        bounded.where(F.col("n") > 2 * n_byzantine + 2)
        .join(best, "group")
        .where(F.col("low") <= F.col("__best") * (1 + 1e-9) + 1e-9)
        .select("group", "client", "closed")
    )
    apart = farthest_sums(placed.select("group", "client", "vector", "r"), rivals, far)
    scores = rivals.join(apart, ["group", "client"]).withColumn("score", F.col("closed") - F.col("far_sum"))
    winner = scores.groupBy("group").agg(F.min(F.struct("score", "client")).alias("b"))
    picked = winner.select("group", F.col("b.client").alias("client"), F.col("b.score").alias("score")).join(
        base, ["group", "client"]
    )
    few = sizes.where(F.col("n") <= 2 * n_byzantine + 2).select("group")
    fallback = (
        assemble(weighted_mean(base.join(few, "group", "left_semi")))
        .withColumns({"client": F.lit(None).cast(dict(base.dtypes)["client"]), "score": F.lit(None).cast("double")})
        .select("group", "client", "score", "vector")
    )
    return picked.select("group", "client", "score", "vector").unionByName(fallback)


def geometric_median(updates: DataFrame, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """V4: Weiszfeld per group; the driver only sees the largest remaining shift.

    Each step is one weighted mean over the vectors with the current estimates joined
    on; groups that moved less than ``tol`` keep their estimate.  Estimates are
    checkpointed, so the plan does not grow and a lost executor costs one step.
    """
    base = updates.select("group", "client", as_double("vector").alias("vector")).persist(StorageLevel.MEMORY_AND_DISK)
    estimate = cut_lineage(assemble(weighted_mean(base), "estimate").withColumn("shift", F.lit(float("inf"))))
    for _ in range(max_iter):
        moving = estimate.where(F.col("shift") >= tol)
        pulled = base.join(moving.select("group", "estimate"), "group").withColumn(
            "weight", 1.0 / F.greatest(F.sqrt(squared_distance(F.col("vector"), F.col("estimate"))), F.lit(1e-10))
        )
        fresh = assemble(weighted_mean(pulled.select("group", "client", "vector", "weight")), "__new")
        estimate = cut_lineage(
            estimate.join(fresh, "group", "left").select(
                "group",
                F.coalesce("__new", "estimate").alias("estimate"),
                F.when(
                    F.col("__new").isNotNull(), F.sqrt(squared_distance(F.col("__new"), F.col("estimate")))
                )
                .otherwise(F.col("shift"))
                .alias("shift"),
            )
        )
        if estimate.where(F.col("shift") >= tol).isEmpty():
            break
    base.unpersist()
    return estimate.select("group", F.col("estimate").alias("vector"))


def outliers(updates: DataFrame, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """V5: score of every update against its group, by norm (population z-score) or by direction."""
    base = updates.select("group", "client", as_double("vector").alias("vector"))
    if method == "zscore":
        sized = base.withColumn("norm", norm(F.col("vector")))
        stats = sized.groupBy("group").agg(F.avg("norm").alias("__m"), F.stddev_pop("norm").alias("__s"))
        scored = sized.join(stats, "group").withColumn(
            "score", F.abs(F.col("norm") - F.col("__m")) / (F.col("__s") + 1e-10)
        )
    elif method == "cosine":
        centre = assemble(weighted_mean(base), "__c")
        scored = base.join(centre, "group").withColumn("score", 1.0 - cosine(F.col("vector"), F.col("__c")))
    else:
        raise ValueError(f"unknown method {method!r}")
    return scored.select("group", "client", "score", (F.col("score") > threshold).alias("flagged"))


def noised_vectors(updates: DataFrame, epsilon: float, secret: str, keys_per_update: int = 1) -> DataFrame:
    """V6: Laplace noise of scale max|v| * keys / epsilon on every coordinate."""
    v = as_double("vector")
    biggest = F.array_max(F.transform(v, lambda x: F.abs(x))) + 1e-10

    def noisy(x: Column, i: Column) -> Column:
        return laplace(
            x, F.col("__s"), epsilon / keys_per_update, uniform(secret, F.col("client").cast("string"), i.cast("string"))
        )

    return updates.withColumn("__s", biggest).withColumn("vector", F.transform(v, noisy)).drop("__s")


AGGREGATORS = {
    "fedavg": weighted_mean,
    "trimmed_mean": lambda u: trimmed_mean(u.drop("weight")),
}


def aggregate_round(
    updates: DataFrame, current: DataFrame, metrics: DataFrame, method: str = "fedavg", threshold: float = 3.0
) -> DataFrame:
    """V7: every session of a round at once: new parameters, mean metrics, number of flagged updates.

    ``current(group, vector)`` are the global parameters the aggregate is added to,
    ``metrics(group, client, loss)`` the clients' own figures.
    """
    if method == "krum":
        step = krum(updates).select("group", F.posexplode("vector").alias("idx", "value"))
    elif method == "geometric_median":
        step = geometric_median(updates).select("group", F.posexplode("vector").alias("idx", "value"))
    else:
        step = AGGREGATORS[method](updates)
    now = current.select("group", F.posexplode(as_double("vector")).alias("idx", "__now"))
    moved = now.join(step, ["group", "idx"]).select("group", "idx", (F.col("__now") + F.col("value")).alias("value"))
    flagged = outliers(updates, "zscore", threshold).groupBy("group").agg(
        F.count("*").alias("n_contributors"), F.count(F.when(F.col("flagged"), 1)).alias("n_flagged")
    )
    averaged = metrics.groupBy("group").agg(F.avg("loss").alias("loss"))
    return assemble(moved, "global").join(flagged, "group").join(averaged, "group", "left")


def prediction_metrics(rows: DataFrame, by: tuple[str, ...] = ("group",), epsilon: float = 1e-8) -> DataFrame:
    """V8: accuracy and log-loss of probabilities ``p`` against 0/1 labels ``y``; squared and absolute errors."""
    y, p = F.col("y").cast("double"), F.col("p")
    error = F.abs(p - y)
    return rows.groupBy(*by).agg(
        F.avg(F.when((p > 0.5) == (y > 0.5), 1.0).otherwise(0.0)).alias("accuracy"),
        (-F.avg(y * F.log(p + epsilon) + (1 - y) * F.log(1 - p + epsilon))).alias("log_loss"),
        F.avg(error * error).alias("mse"),
        F.avg(error).alias("mae"),
        F.max(error).alias("max_error"),
        F.count("*").alias("n"),
    )


#: Vectors of ours that a task of the similarity join holds at most, and about how many of theirs pass by.
BLOCK = 16384
#: Numbers of one product, and rows of one batch that is given on.
NUMBERS, SENT = 1 << 22, 1 << 15
#: Pivots of the similarity join at most: what the driver holds and every task compares with.
MOST_CELLS = 4096


def similar_nodes(
    ours: DataFrame, theirs: DataFrame, threshold: float = 0.8, cells: int | None = None, block: int = BLOCK
) -> DataFrame:
    """All pairs (our id, their id) with cosine >= ``threshold``, exactly.

    Each of our vectors goes to the nearest of ``cells`` pivots, as many as the square root
    of our vectors (at least 64, at most MOST_CELLS); a cell's reach is its largest angle to the pivot.  One of their vectors can only match inside a cell if its
    angle to the pivot is at most reach + acos(threshold), so it is sent to those cells
    only, once for all that lie in one group.  A group holds up to ``block`` of our vectors and
    a task meets it with about as many of theirs, which pass by in batches: products and
    matches are bounded, and a vector is copied once per group it can match in.

    Pivots (``cells`` vectors) and reaches (``cells`` numbers) are all the driver holds.
    Zero vectors match nothing.
    """
    spark = ours.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        return df.select("id", as_double("vector").alias("vector")).where(norm(F.col("vector")) > 0)

    a, b = prepared(ours), prepared(theirs)
    schema_id = dict(ours.dtypes)["id"]
    cells = cells or int(min(MOST_CELLS, max(64, np.sqrt(a.count()))))
    seeds = a.orderBy(F.xxhash64("id"), "id").limit(cells).select("vector").collect()
    if not seeds:
        return spark.createDataFrame([], f"our_node {schema_id}, their_node {schema_id}, similarity double")
    pivots = np.array([r.vector for r in seeds])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    limit = float(np.arccos(np.clip(threshold, -1.0, 1.0)))

    step = max(1, NUMBERS // (4 * cells))

    def unit(vectors) -> np.ndarray:
        x = np.stack(vectors).astype(float)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def angles(x: np.ndarray, to: np.ndarray = pivots) -> np.ndarray:
        return np.arccos(np.clip(x @ to.T, -1.0, 1.0))

    def slices(batches):
        for pdf in batches:
            for i in range(0, len(pdf), step):
                yield pdf["id"].to_numpy()[i : i + step], unit(pdf["vector"].to_numpy()[i : i + step])

    def home(batches):
        for ids, x in slices(batches):
            ang = angles(x)
            cell = ang.argmin(axis=1)
            yield pd.DataFrame({"id": ids, "vector": list(x), "cell": cell, "angle": ang[np.arange(len(x)), cell]})

    located = cut_lineage(a.mapInPandas(home, f"id {schema_id}, vector array<double>, cell int, angle double"))
    reach = np.full(len(pivots), -1.0)
    counts = np.zeros(len(pivots), dtype=np.int64)
    for r in located.groupBy("cell").agg(F.max("angle").alias("m"), F.count("*").alias("n")).collect():
        reach[r.cell], counts[r.cell] = r.m, r.n

    # Neighbouring cells share a group until it is full; a cell that is larger than a group has several of its own.
    ranges: list[tuple[int, int]] = []
    placed = []
    room = 0
    for cell in range(len(pivots)):
        parts = max(1, -(-int(counts[cell]) // block))
        if parts > 1 or counts[cell] > room or not ranges:
            ranges += [(cell, cell + 1)] * parts
            room = block if parts == 1 else 0
        ranges[-1] = (ranges[-1][0], cell + 1)
        room -= int(counts[cell])
        placed.append((cell, len(ranges) - parts, parts))
    starts = sorted({low for low, _ in ranges})
    column = np.array([starts.index(low) for low, _ in ranges])

    def groups_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = (reach >= 0) & (angles(x) <= reach + limit + 1e-9)
        return np.nonzero(np.logical_or.reduceat(near, starts, axis=1)[:, column])

    def arriving(batches):
        for _, x in slices(batches):
            found, n = np.unique(groups_of(x)[1], return_counts=True)
            yield pd.DataFrame({"group": found.astype(np.int32), "n": n})

    def send(batches):
        for ids, x in slices(batches):
            row, group = groups_of(x)
            for i in range(0, len(row), SENT):
                at = row[i : i + SENT]
                yield pd.DataFrame({"id": ids[at], "vector": list(x[at]), "group": group[i : i + SENT].astype(np.int32)})

    arrivals = b.mapInPandas(arriving, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()
    if not arrivals:
        return spark.createDataFrame([], f"our_node {schema_id}, their_node {schema_id}, similarity double")
    shares = dims.frame(spark, [(r.group, -(-int(r.n) // block)) for r in arrivals], ["group", "theirs"])
    homes = dims.frame(spark, placed, ["cell", "first", "parts"])
    key = F.concat_ws(":", "group", "share").alias("task")
    left = (
        located.join(homes, "cell")
        .withColumn("group", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
        .join(shares, "group")
        .withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("theirs").cast("long") - 1)))
        .select(key, F.col("cell").cast("int").alias("cell"), "id", "vector")
    )
    sent = b.mapInPandas(send, f"id {schema_id}, vector array<double>, group int")
    right = (
        sent.join(shares, "group")
        .withColumn("share", F.pmod(F.xxhash64("id"), F.col("theirs")).cast("long"))
        .select(key, F.lit(None).cast("int").alias("cell"), "id", "vector")
    )
    product = max(1, min(block, int(NUMBERS**0.5)))

    def compared(held, ids: np.ndarray, x: np.ndarray):
        """The matches of a batch of theirs with what a task holds of ours, cell by cell."""
        our, own, bounds = held
        for cell, low, high in bounds:
            near = np.flatnonzero(angles(x, pivots[cell : cell + 1])[:, 0] <= reach[cell] + limit + 1e-9)
            for p in range(low, high, product):
                for q in range(0, len(near), product):
                    at = near[q : q + product]
                    sim = own[p : min(p + product, high)] @ x[at].T
                    i, j = np.nonzero(sim >= threshold)
                    if len(i):
                        yield our[p + i], ids[at[j]], sim[i, j]

    def meet(batches):
        """Rows come by task, ours first and by cell: ours are kept, theirs pass by batch after batch."""
        task, ours_ids, ours_vectors, ours_cells, held = None, [], [], [], None
        out, waiting = [], 0
        for pdf in batches:
            if not len(pdf):
                continue
            mine = pdf["cell"].notna().to_numpy()
            tasks = pdf["task"].to_numpy()
            turns = np.flatnonzero((tasks[1:] != tasks[:-1]) | (mine[1:] != mine[:-1])) + 1
            for low, high in zip([0, *turns], [*turns, len(pdf)]):
                if tasks[low] != task:
                    task, ours_ids, ours_vectors, ours_cells, held = tasks[low], [], [], [], None
                ids, x = pdf["id"].to_numpy()[low:high], np.stack(pdf["vector"].to_numpy()[low:high])
                if mine[low]:
                    ours_ids.append(ids)
                    ours_vectors.append(x)
                    ours_cells.append(pdf["cell"].to_numpy()[low:high].astype(int))
                    continue
                if not ours_ids:
                    continue
                if held is None:
                    cell = np.concatenate(ours_cells)
                    ends = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
                    bounds = [(int(cell[p]), p, q) for p, q in zip(ends[:-1], ends[1:])]
                    held = np.concatenate(ours_ids), np.concatenate(ours_vectors), bounds
                for found in compared(held, ids, x):
                    out.append(found)
                    waiting += len(found[0])
                    if waiting >= SENT:
                        yield from pairs_of(out)
                        out, waiting = [], 0
        if out:
            yield from pairs_of(out)

    def pairs_of(found: list):
        our, their, similarity = (np.concatenate(x) for x in zip(*found))
        for i in range(0, len(our), SENT):
            cut = slice(i, i + SENT)
            yield pd.DataFrame({"our_node": our[cut], "their_node": their[cut], "similarity": similarity[cut]})

    tasks = sum(-(-int(r.n) // block) for r in arrivals)
    return (
        left.unionByName(right)
        .repartition(max(tasks, spark.sparkContext.defaultParallelism), "task")
        .sortWithinPartitions("task", F.col("cell").asc_nulls_last())
        .mapInPandas(meet, f"our_node {schema_id}, their_node {schema_id}, similarity double")
    )


def banding(rows: int, threshold: float, missed: float = 0.02) -> tuple[int, int]:
    """(bands, bits): bits follow the rows, so that a code holds about as many vectors however many there are, and bands
    keep the share of pairs at the threshold that are missed below ``missed``."""
    bits = max(10, int(np.ceil(np.log2(max(rows, 1) / 16))))
    agree = (1 - np.arccos(np.clip(threshold, -1.0, 1.0)) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(missed) / np.log1p(-min(agree, 1 - 1e-12))))), bits


def banded_pairs(ours: DataFrame, theirs: DataFrame, bands: int = 40, bits: int = 10, seed: int = 12) -> DataFrame:
    """Pairs (our id, their id) that agree in all sign bits of a band, the candidates of ``similar_nodes_banded``."""

    def coded(df: DataFrame, name: str) -> DataFrame:
        def run(batches):
            weights = 1 << np.arange(bits)
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["vector"].to_numpy()).astype(float)
                    planes = np.random.default_rng(seed).normal(size=(x.shape[1], bands * bits))
                    code = ((x @ planes > 0).reshape(len(x), bands, bits) * weights).sum(axis=2)
                    yield pd.DataFrame({"id": pdf["id"], "code": list(code.astype(np.int64))})

        found = df.select("id", as_double("vector").alias("vector")).where(norm(F.col("vector")) > 0)
        found = found.mapInPandas(run, f"id {dict(df.dtypes)['id']}, code array<long>")
        return found.select(F.col("id").alias(name), F.posexplode("code").alias("band", "code"))

    return coded(ours, "our_node").join(coded(theirs, "their_node"), ["band", "code"]).select("our_node", "their_node").distinct()


def similar_nodes_banded(
    ours: DataFrame, theirs: DataFrame, threshold: float = 0.8, bands: int | None = None, bits: int | None = None
) -> DataFrame:
    """Pairs with cosine >= ``threshold`` found through bands of signed random projections, each checked exactly.

    Compares only pairs that share a band, so it misses some: a pair at cosine c is found with
    probability 1 - (1 - (1 - acos(c) / pi) ** bits) ** bands, 98 % at the threshold and more above, with the bands and
    bits that the number of vectors calls for (``banding``).
    ``similar_nodes`` misses none, but compares all blocks where vectors don't cluster.
    """
    if bands is None or bits is None:
        bands, bits = banding(max(ours.count(), theirs.count()), threshold)
    pairs = banded_pairs(ours, theirs, bands, bits)
    left = ours.select(F.col("id").alias("our_node"), as_double("vector").alias("__a"))
    right = theirs.select(F.col("id").alias("their_node"), as_double("vector").alias("__b"))
    met = pairs.join(left, "our_node").join(right, "their_node")
    return met.select("our_node", "their_node", cosine(F.col("__a"), F.col("__b")).alias("similarity")).where(
        F.col("similarity") >= threshold
    )


def shared_campaigns(similar: DataFrame, nodes: DataFrame, top: int = 10) -> DataFrame:
    """What the matched nodes have in common, in one row; empty without a technique or indicator."""
    typed = similar.join(nodes.select(F.col("id").alias("our_node"), "node_type", "label"), "our_node")
    is_technique, is_ioc = F.col("node_type") == "technique", F.col("node_type") == "ioc"
    best = (
        typed.where(is_technique)
        .orderBy(F.col("similarity").desc(), "our_node", "their_node")
        .limit(top)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "label"))).alias("t"))
        .select(F.transform("t", lambda x: x.getField("label")))
        .scalar()
    )
    return (
        typed.agg(
            F.count(F.when(is_technique, 1)).alias("shared_technique_count"),
            F.count(F.when(is_ioc, 1)).alias("shared_ioc_count"),
            F.count_distinct(F.when(F.col("node_type") == "tool", F.col("label"))).alias("shared_tools"),
            F.avg("similarity").alias("confidence"),
            F.count("*").alias("total_matches"),
        )
        .where("shared_technique_count > 0 OR shared_ioc_count > 0")
        .withColumn("techniques", best)
    )
