"""MinHash near-duplicates: bottom-k sketches from one hash function, inverted lists of the retained values.

A document's sketch is the k smallest of its shingle hashes, so it takes one hash function, and the sketch of a union
is the k smallest of two sketches.  Steps, all on DataFrames:

1. One pass over the texts gives size, a 128-bit signature of the full set and the sketch.  Equal sets form a class at
   once; only the class's smallest document goes on, so copies never meet in a list.
2. Inverted lists over the retained values.  Values that one class alone has can't give an overlap and are left out.
   Two sketches with at least c common values share one among the rarest ``size - c + 1`` of either, so each class
   enters only those lists, rarest first; a class with fewer than c shared values enters none.  c is exact for sets
   that fit their sketch and lies six standard deviations below the expected overlap for larger ones.
3. The members of a list are compared by the union-sketch estimate, again with six deviations of room.  What is
   similar there forms candidate components.  Long lists are cut into chunks at random; a list whose members are not
   all in one component after that has its chunks compared pairwise too.
4. Within a candidate component full sets are compared, exactly and block by block: a matrix of documents and the
   shingles that several of them have, times its transpose, holds all intersections.

Only spanning edges leave a task, never all pairs of a group, and nothing is capped.
"""

from __future__ import annotations

from math import ceil, floor, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexvigil.llm.common import components, mix, shingle_sets, thinned
from hexvigil.llm.vectors import local_roots
from hexvigil.session import cut_lineage

SKETCH = 64
#: Entries of a list that one task compares; entries of short lists that share a task.
CHUNK, BUNDLE = 512, 4096
#: Shingles of a component that one task compares with as many others, and of small components that share a task.
BLOCK = 400_000
#: Documents of a component in one block; a task's matrices grow with the square of two blocks.
DOCS = 800
#: Parts that the members of a large component are spread over to meet its size.
SALTS = 32
NONE = np.iinfo(np.int32).max


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    spread = mix(s.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return int(np.add.reduce(s)), int(np.add.reduce(spread).view(np.int64))


def _sketcher(shingle: int, k: int):
    def run(batches):
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            out = [(len(s), *_signature(s), s[:k]) for s in shingle_sets(texts, shingle)]
            yield pd.DataFrame(out, columns=["n_shingles", "sig_a", "sig_b", "sketch"]).assign(doc_id=batch["doc_id"].array, digest=batch["digest"].array)

    return run


def _packed(batches):
    for batch in batches:
        yield batch.assign(sketch=[np.asarray(s, np.int32).tobytes() for s in batch["sketch"]])


def _setter(shingle: int):
    """Full sets of the rows whose text is the wanted one; texts with equal digests could be others."""

    def run(batches):
        for batch in batches:
            texts, wanted = batch["text"].fillna("").tolist(), list(zip(batch["sig_a"], batch["sig_b"], strict=True))
            rest = batch.drop(columns=["text", "sig_a", "sig_b"])
            for at in range(0, len(texts), 1000):
                sets = list(shingle_sets(texts[at : at + 1000], shingle))
                own = [_signature(s) == w for s, w in zip(sets, wanted[at : at + 1000], strict=True)]
                yield rest.iloc[at : at + 1000].assign(full=[s.tobytes() for s in sets])[own]

    return run


def estimates(one: np.ndarray, many: np.ndarray, k: int) -> np.ndarray:
    """Jaccard estimates of a sketch with each of many, from the k smallest of the union; NONE fills short sketches."""
    both = np.sort(np.concatenate([np.broadcast_to(one, many.shape), many], axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    there = (both != NONE) & (np.cumsum(~again, axis=1) <= k)
    return (again & there).sum(1) / np.maximum((~again & there).sum(1), 1)


def _lister(percent: int, k: int):
    least = percent / 100 - 6 * sqrt(percent / 100 * (1 - percent / 100) / k)

    def spanning(sketches: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Joins the roots of members whose sketches are similar; pairs that are joined already are passed over."""
        for i in range(len(root) - 1):
            other = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            if len(other):
                near = other[estimates(sketches[i], sketches[other], k) >= least]
                joined = np.unique(np.append(root[near], root[i]))
                if len(joined) > 1:
                    root[np.isin(root, joined)] = joined[0]
        return root

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["value", "doc"])
        docs, values = rows["doc"].to_numpy(), rows["value"].to_numpy()
        sketches = np.full((len(docs), k), NONE, np.int32)
        for i, s in enumerate(rows["sketch"]):
            own = np.frombuffer(s, np.int32)
            sketches[i, : len(own)] = own
        known = rows["root"].to_numpy()
        out = []
        cut = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a > 1:
                first = np.unique(known[a:b], return_index=True)[1][np.unique(known[a:b], return_inverse=True)[1]]
                root = spanning(sketches[a:b], first.copy())
                more = np.flatnonzero(root != first)
                out.append(pd.DataFrame({"a": docs[a:b][more], "b": docs[a:b][root[more]]}))
        return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"a": [], "b": []}).astype("int64")

    return run


def similar_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets (sorted distinct hashes) have 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    column, counts = np.unique(values, return_inverse=True, return_counts=True)[1:]
    several = counts > 1
    number = np.cumsum(several) - 1
    owner, column = owner[several[column]], number[column[several[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common, width = np.zeros((len(sets), len(sets)), np.float32), 4096  # whole numbers, exact below 2 ** 24
    for lo in range(0, int(several.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        there = np.zeros((len(sets), width), np.float32)
        there[owner[a:b], column[a:b] - lo] = 1
        common += there @ there.T
    np.fill_diagonal(common, sizes)
    return ((100 + percent) * common.astype(np.int64) >= percent * (sizes[:, None] + sizes)) & (sizes > 0)


def _verifier(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in rows.groupby("root"):
            ids = group["doc"].to_numpy()
            root = local_roots(similar_sets([np.frombuffer(s, np.int64) for s in group["full"]], percent))
            more = np.flatnonzero(root != np.arange(len(root)))
            out.append(pd.DataFrame({"a": ids[more], "b": ids[root[more]]}))
        return pd.concat(out)

    return run


def _pairs_of(blocks: Column, own: Column) -> Column:
    """The pairs of different blocks (i < j) that a row of block ``own`` belongs to; of a single block, itself."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: x != own)
    pairs = F.transform(others, lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    return F.when(blocks > 1, pairs).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, digest, grp.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A document's set holds its distinct shingles; with fewer
    words, the whole sequence as one.  Documents link when 100 * intersection >= percent * union.  ``component_id`` is
    the smallest doc_id that links reach.  Null or wordless texts have an empty set and link with nothing.  Rows with
    a null doc_id link with nothing, have a null component_id and are kept.  Rows that repeat a doc_id are judged each
    by its own text; rows with equal texts share a component and are kept if its id is theirs.  Other columns are
    ignored.

    ``digest`` (of the text) tells rows of one id apart, and ``grp`` numbers what links reach, so that two components
    with the same smallest id stay two; it is null for rows that link with nothing by definition.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    # Each row gets a number, which the checkpoint fixes; a class goes on under the smallest number of its rows.
    schema = "n_shingles long, sig_a long, sig_b long, sketch array<long>, doc_id long, digest long"
    signed = docs.mapInPandas(_sketcher(shingle, k), schema).withColumn("doc", F.monotonically_increasing_id())
    signed = cut_lineage(signed)
    key = ["sig_a", "sig_b", "n_shingles"]
    classes = cut_lineage(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc").alias("doc"), F.min("doc_id").alias("first"))
    )
    sketches = cut_lineage(
        signed.join(classes.select("doc"), "doc").select("doc", "doc_id", "digest", "sig_a", "sig_b", F.col("n_shingles").alias("n"), "sketch")
    )

    t = percent / 100
    expected = floor(t * k - 6 * sqrt(t * (1 - t) * k))
    need = F.when(F.col("n") <= floor(t * k), F.ceil(F.col("n") * percent / 100)).otherwise(max(1, expected))
    values = sketches.select("doc", need.alias("need"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    of_doc = W.partitionBy("doc", "need")
    entries = (
        values.join(shared, "value")
        .withColumn("mine", F.count("*").over(of_doc))
        .withColumn("nth", F.row_number().over(of_doc.orderBy("df", "value")))
        .filter(F.col("nth") <= F.col("mine") - F.col("need") + 1)
        .select("value", "doc")
    )
    entries = cut_lineage(entries)
    lists = cut_lineage(entries.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1"))
    short = sketches.select("doc", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("sketch"))
    listed = entries.join(lists, "value").join(short, "doc")
    listed = listed.mapInPandas(_packed, "value long, doc long, members long, sketch binary")
    in_lists = lists.agg(F.sum("members")).first()[0] or 0
    bundles, chunks = max(1, ceil(in_lists / BUNDLE)), F.ceil(F.col("members") / CHUNK)
    long = F.col("members") > CHUNK
    task = F.when(long, F.col("value")).otherwise(F.pmod(F.xxhash64("value"), F.lit(bundles)))
    chunk = F.when(long, F.pmod(F.xxhash64("doc", "value"), chunks)).otherwise(0)
    compare = _lister(percent, k)
    found = (
        listed.withColumns({"task": task, "long": long, "chunk": chunk, "root": F.col("doc")})
        .groupBy("task", "long", "chunk").applyInPandas(compare, "a long, b long")
    )
    found = cut_lineage(thinned(found))
    candidates = components(found)

    # Long lists that are not within one component yet: what is outside a list's largest component meets all of it.
    rooted = listed.filter(long).join(candidates.withColumnRenamed("node", "doc"), "doc", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "doc"))
    per_root = cut_lineage(rooted.groupBy("value", "root").agg(F.count("*").alias("n")))
    main = per_root.groupBy("value").agg(F.max("n").alias("n"), (F.sum("n") - F.max("n")).alias("outside")).filter("outside > 0")
    main = per_root.join(main, ["value", "n"]).groupBy("value", "outside").agg(F.min("root").alias("main"))
    open_lists = cut_lineage(main)
    if not open_lists.isEmpty():
        across = F.ceil(F.col("outside") / CHUNK)
        inside, apart = F.pmod(F.xxhash64("doc", "value"), chunks), F.pmod(F.xxhash64("doc"), across)
        met = F.transform(F.sequence(F.lit(0).cast("long"), across - 1), lambda j: F.struct(inside.alias("i"), j.alias("j")))
        meets = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda i: F.struct(i.alias("i"), apart.alias("j")))
        more = (
            rooted.join(open_lists, "value")
            .withColumn("pair", F.explode(F.when(F.col("root") == F.col("main"), met).otherwise(F.array_union(met, meets))))
            .groupBy("value", "pair").applyInPandas(compare, "a long, b long")
        )
        candidates = components(found.unionByName(thinned(more)))

    # Exact comparison of the full sets of each candidate component.
    candidates = cut_lineage(candidates.withColumnRenamed("node", "doc"))
    sized = candidates.join(sketches.select("doc", "n"), "doc")
    blocks = sized.groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))
    blocks = blocks.select("root", "total", F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(F.col("docs") / DOCS)).alias("blocks"))
    blocks = cut_lineage(blocks)
    # Only large components need their number of blocks; their members are spread over salts to get it.
    spread = blocks.filter("blocks > 1").select("root", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = candidates.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(spread, ["root", "salt"], "left")
    members = members.select("doc", "root", F.coalesce("blocks", F.lit(1)).cast("long").alias("blocks"))
    members = cut_lineage(members.join(sketches.select("doc", "doc_id", "digest", "sig_a", "sig_b"), "doc"))
    bundles = max(1, ceil((blocks.filter("blocks = 1").agg(F.sum("total")).first()[0] or 0) / BLOCK))
    # A row is found by its id and its text's digest; of rows that repeat both, one is read.
    wanted = docs.join(members, ["doc_id", "digest"])
    again = signed.join(members.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi")
    if not again.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        same = ["doc", "root", "blocks", "sig_a", "sig_b"]
        wanted = wanted.groupBy(*same).agg(F.first("text").alias("text"))
    sets = wanted.select("text", "sig_a", "sig_b", "doc", "root", "blocks").mapInPandas(
        _setter(shingle), "doc long, root long, blocks long, full binary"
    )
    own = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    task = F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bundles)))
    edges = (
        sets.withColumn("pair", F.explode(_pairs_of(F.col("blocks"), own)))
        .select("doc", "root", "full", "pair", (F.col("blocks") > 1).alias("large"), task.alias("task"))
        .groupBy("task", "large", "pair").applyInPandas(_verifier(percent), "a long, b long")
    )
    roots = components(thinned(edges))

    # Components of classes under the smallest id of any of their rows.
    classes = classes.join(roots.withColumnRenamed("node", "doc"), "doc", "left")
    least = classes.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    grp = F.coalesce("root", "doc").alias("grp")
    classes = classes.join(least, "root", "left").select(*key, F.coalesce("least", "first").alias("least"), grp)
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return (
        signed.join(classes, key, "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "n_shingles", "component_id", "kept", "digest", F.when(F.col("doc_id").isNotNull(), F.col("grp")).alias("grp"))
    )
