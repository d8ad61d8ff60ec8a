"""What the operators of this subpackage share: table access, the learn/hold-out split, word hashing, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hexvigil.session import cut_lineage

#: Characters that one numpy pass works on; bounds a worker's memory whatever the batch holds.
PASS_CHARS = 300_000
#: Edges that one partition holds while components are found.
EDGES = 50_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def with_fields(schema: StructType, ddl: str) -> StructType:
    """The fields of ``schema``, then those of ``ddl``."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def held_out(doc_id: Column | str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text divides by 5.  A null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def passes(texts, limit: int = PASS_CHARS):
    """(from, to) slices of a batch of texts, each of about ``limit`` characters and one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x5851F42D4C957F2D)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, and at which word each text begins.

    With ``lower``, A-Z count as a-z.  Works on UTF-8 bytes, for all texts in one pass.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([1] + [len(r) + 1 for r in raw])
    firsts = np.searchsorted(starts, begins)
    if not len(starts):
        return np.empty(0, np.uint64), firsts
    letters = np.flatnonzero(~space)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    values = _BYTES[data[letters]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, at) ^ lengths.astype(np.uint64)), firsts


def shingle_sets(texts, size: int):
    """For each text its sorted distinct shingle hashes (int64), the whole word sequence as one if shorter, empty without words."""
    for lo, hi in passes(texts):
        words, firsts = word_hashes(texts[lo:hi])
        n = len(words) - size + 1
        grams = np.zeros(max(n, 0), np.uint64)
        if n > 0:
            for k in range(size):
                grams = mix(grams * _STEP + words[k : k + n])
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1].view(np.int64))
            elif b > a:
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = mix(np.array([whole]) * _STEP + w)[0]
                yield np.array([whole]).view(np.int64)
            else:
                yield np.empty(0, np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges; root is the smallest node that links reach.

    Alternating large-star and small-star contraction: each round is two aggregations and two joins, the lineage
    is cut by a reliable checkpoint, and the driver only sees counts and a sum.  Hubs are pre-aggregated, and the
    join that gives a hub's minimum back is one that adaptive execution splits.  Few edges are worked on in few
    partitions, as a round writes files for each.
    """
    flat = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    flat = cut_lineage(flat.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = 1 + flat.count() // EDGES
    seen = None
    while True:
        flat = flat.coalesce(parts)
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).coalesce(parts)
        flat = cut_lineage(small.filter("u <> v").distinct().coalesce(parts))
        state = flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        flat.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def thinned(edges: DataFrame) -> DataFrame:
    """The links (a, b), where a node ``a`` names few nodes ``b``, as fewer links of the same components.

    Each ``a`` is tied to the smallest node that it names and the others are tied to that one too, so what many tasks
    found about the same nodes shrinks to about one link a node, without a join.
    """
    named = edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("b"))
    least = F.get("b", F.lit(0))
    ties = F.transform("b", lambda b: F.struct(F.when(b == least, F.col("a")).otherwise(b).alias("a"), least.alias("b")))
    return named.select(F.explode(ties).alias("x")).select("x.*").distinct()
