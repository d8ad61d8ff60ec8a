"""Source divergence audit: how far the sources of a language lie from each other and which terms set one apart.

Documents are written once, parted by language, and cut into terms batch by batch.  For each language a CountVectorizer keeps the terms of
enough documents, without a cap on their number, and gives every document an exact sparse vector; vectors are summed
by source inside the tasks and the sums added up by Spark.  Pairs of sources are then evaluated sparsely, terms dealt
out by hash: a shard of terms meets each pair only where one of the two has the term, the rest of the vocabulary adds
one constant times its number.

A vocabulary is held whole by the driver and the tasks, so its size is bounded first: a language of more distinct terms
than SHARD_TERMS is fitted in several parts, each over the terms of one hash range.  A hot source is summed in all tasks
and its terms lie in many shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexvigil.session import cut_lineage, scratch_path

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
#: Distinct terms, kept or not, of one vocabulary.
SHARD_TERMS = 2_000_000
#: Rows (source, term) of one task of the evaluation, and sources that one task compares with all others.
SHARD_ROWS, BLOCK = 100_000, 256
#: Sums by source and term that a task holds before it hands them on.
BUFFER = 1_500_000
#: Sums travel packed, so many bits of the places of a vocabulary at a time.
RANGE = 14
#: Bytes of text that a task cuts into terms at a time.
SLICE = 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term that no text holds, so that a vocabulary is never empty.
_NONE = "\0"


#: By byte: A-Z as a-z, all that no term holds as a space, the rest as it is.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _slices(text: pa.Array):
    """(from, to) rows of about SLICE bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, to
        at = to


def _split(batches):
    """(source, terms, fresh) of (source, text): some MB of bytes are translated at once, then cut at spaces.

    ``fresh`` lists the distinct terms of such a slice at its first row, all that counting distinct ones needs.
    """
    for batch in batches:
        whole = batch.column("text").cast(pa.string())
        for at, to in _slices(whole):
            text = pa.concat_arrays([whole.slice(at, to - at)])
            _, offsets, data = text.buffers()
            clean = pa.StringArray.from_buffers(len(text), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_TABLE)))
            words = pc.ascii_split_whitespace(clean)
            values, owner = pc.list_flatten(words), pc.list_parent_indices(words)
            real = pc.greater(pc.binary_length(values), 0)
            each = np.bincount(owner.filter(real).to_numpy(), minlength=len(text))
            ends = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
            values = values.filter(real)
            once = values.unique()
            fresh = pa.ListArray.from_arrays(pa.array([0, *[len(once)] * len(text)], pa.int32()), once)
            parts = [batch.column("source").slice(at, to - at), pa.ListArray.from_arrays(ends, values), fresh]
            yield pa.RecordBatch.from_arrays(parts, ["source", "terms", "fresh"])


def terms(docs: DataFrame) -> DataFrame:
    """(source, terms, fresh) of (source, text) without nulls: all terms of each text, A-Z lower-cased."""
    return docs.select("source", "text").mapInArrow(_split, "source string, terms array<string>, fresh array<string>")


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    number, place, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, number))
    number, place = number[order], place[order]
    first = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
    return number[first], place[first], np.add.reduceat(count[order], first) if len(first) else count


def _summing(limit: int):
    """Sums of the sparse vectors of each source, merged as they come and handed on beyond ``limit`` entries."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sources: dict[str, int] = {}
        size = least = 0

        def flush(number, place, n):
            names, key = list(sources), number.astype(np.int64) << 32 | place >> RANGE
            first = np.flatnonzero(np.diff(key, prepend=-1))
            for at, to in zip(first, [*first[1:], len(key)], strict=True):
                part = place[at:to].astype(np.uint32).tobytes(), n[at:to].astype(np.int64).tobytes()
                yield names[number[at]], int(place[at] >> RANGE), *part

        def rows(found):
            columns = list(zip(*found, strict=True))
            if columns:
                types = pa.string(), pa.int64(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["source", "part", "places", "counts"])

        for batch in batches:
            vector = batch.column("vector")
            vector = getattr(vector, "storage", vector)
            index, value = vector.field("indices"), vector.field("values")
            each = pc.list_value_length(index).to_numpy(zero_copy_only=False)
            coded = batch.column("source").dictionary_encode()
            numbers = np.array([sources.setdefault(x, len(sources)) for x in coded.dictionary.to_pylist()], np.int32)
            number = np.repeat(numbers[coded.indices.to_numpy()], each)
            place = pc.list_flatten(index).to_numpy()
            count = pc.list_flatten(value).to_numpy().astype(np.int64)
            for at in range(0, len(number), limit):
                held.append((number[at : at + limit], place[at : at + limit], count[at : at + limit]))
                size += len(held[-1][0])
                if size >= least + limit:
                    held = [_merged(held)]
                    size = least = len(held[0][0])
                    if size >= limit:
                        yield from rows(flush(*held[0]))
                        held, size, least = [], 0, 0
        if held:
            yield from rows(flush(*_merged(held)))

    return run


def _total(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of a source's terms of one range of places, from those of all tasks, which are read one after another."""
    total = np.zeros(1 << RANGE, np.int64)
    for batch in parts:
        for places, counts in zip(batch["places"], batch["counts"], strict=True):
            total[np.frombuffer(places, np.uint32) & ((1 << RANGE) - 1)] += np.frombuffer(counts, np.int64)
    found = np.flatnonzero(total)
    yield pd.DataFrame({"source": key[0], "place": (int(key[1]) << RANGE) + found, "n": total[found]})


def _vectorized(docs: DataFrame, lang: str, min_docs: int, shard_terms: int, distinct: int, path: str) -> int:
    """Writes (lang, source, term, n) of the kept terms of one language's (source, terms) and returns their number."""
    spark, parts, kept = docs.sparkSession, 1 + distinct // shard_terms, 0
    never = spark.createDataFrame([("", [_NONE])] * min_docs, "source string, terms array<string>")
    for part in range(parts):
        some = docs
        if parts > 1:
            this = F.lit(part)
            some = docs.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(parts)) == this))  # noqa: B023
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=2**31 - 1).fit(some.unionByName(never))
        kept += len(model.vocabulary) - 1
        vocabulary = spark.createDataFrame(
            pd.DataFrame({"place": np.arange(len(model.vocabulary)), "term": model.vocabulary}), "place long, term string"
        )
        sums = model.transform(some).select("source", "vector").mapInArrow(
            _summing(BUFFER), "source string, part long, places binary, counts binary"
        )
        sums = sums.groupBy("source", "part").applyInPandas(_total, "source string, place long, n long")
        named = sums.join(vocabulary, "place").select(F.lit(lang).alias("lang"), "source", "term", "n")
        named.write.mode("append").parquet(path)
    return kept


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, source, term, n > 0) of the terms in at least ``min_docs`` documents of their language, and
    the groups (lang, source, total, kept): every occurring one, with its count over kept terms and their number.

    A null text, lang or source counts as ''.  Repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    path, out = scratch_path(spark, "languages"), scratch_path(spark, "term-counts")
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    named = named.withColumn("folder", F.concat(F.lit("l"), F.sha1(F.col("lang").cast("binary"))))
    named.write.partitionBy("folder").option("compression", "zstd").parquet(path)
    written = spark.read.schema("lang string, source string, text string, folder string").parquet(path)
    sizes = {}
    for lang, folder in written.select("lang", "folder").distinct().collect():
        cut = f"{path}-terms/{folder}"
        terms(spark.read.parquet(f"{path}/folder={folder}")).write.option("compression", "zstd").parquet(cut)
        own = spark.read.parquet(cut)
        n = own.select(F.explode("fresh").alias("term")).agg(F.approx_count_distinct("term")).first()[0]
        sizes[lang] = _vectorized(own.select("source", "terms"), lang, min_docs, shard_terms, n, out)
    schema = "lang string, source string, term string, n long"
    counts = spark.read.schema(schema).parquet(out) if sizes else spark.createDataFrame([], schema)
    kept = spark.createDataFrame(list(sizes.items()), "lang string, kept long")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang")
    return counts, cut_lineage(groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), "kept"))


def _share(count, total):
    """1 + floor(SCALE * (count + 1) / total), exactly; ``total`` is the count of all plus the vocabulary."""
    if np.max(count, initial=0) > 9_000_000_000:
        count, total = count.astype(object), total.astype(object) if isinstance(total, np.ndarray) else total
    return (1 + SCALE * (count + 1) // total).astype(np.int64)


def _away(p, q):
    return (p - q) * (p - q) // q


def _evaluator(top: int, size: int):
    """One shard of a language's terms: for a block of sources the partial sums against all others, and the top terms.

    Rows without a term name the language's sources in order; ``number`` is a source's place.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, block = key
        sources = rows[rows["term"].isna()].sort_values("number")
        names, whole = sources["source"].to_numpy(), (sources["total"] + sources["kept"]).to_numpy()
        absent = _share(np.zeros(len(names), np.int64), whole) if whole.all() else np.ones(len(names), np.int64)
        rows = rows[rows["term"].notna()].sort_values("number", kind="stable")
        number, n = rows["number"].to_numpy(), rows["n"].to_numpy()
        code, words = pd.factorize(rows["term"], sort=True)
        p = _share(n, whole[number])
        firsts = np.searchsorted(number, np.arange(len(names) + 1))
        shared = np.zeros(len(words), n.dtype)
        np.add.at(shared, code, n)
        q = _share(shared, sources["total"].sum() + sources["kept"].iloc[0])[code]
        out, own = [], range(block * size, min((block + 1) * size, len(names)))
        levels, level = np.unique(absent, return_inverse=True)

        def by_source(values):
            upto = np.concatenate([[0], np.cumsum(values)])
            return upto[firsts[1:]] - upto[firsts[:-1]]

        for i in own:
            a, b = firsts[i], firsts[i + 1]
            mine, mine_p = code[a:b], p[a:b]
            line = np.full(len(words), absent[i])
            line[mine] = mine_p
            both = np.zeros(len(words), bool)
            both[mine] = True
            both = both[code]
            # Terms of the other source, then own terms that it doesn't have.
            lone = np.array([_away(mine_p, x).sum() for x in levels], np.int64)[level] - by_source(np.where(both, _away(line[code], absent[number]), 0))
            sums = by_source(_away(line[code], p)) + lone
            union = by_source(np.ones(len(code), np.int64)) + len(mine) - by_source(both.astype(np.int64))
            out += [("pair", names[i], names[j], int(sums[j]), int(union[j])) for j in np.flatnonzero(union) if j != i]
            f = _away(mine_p, q[a:b])
            above = np.flatnonzero(mine_p > q[a:b])
            for t in above[np.lexsort((mine[above], -f[above]))][:top]:
                out.append(("term", names[i], words[mine[t]], int(f[t]), 1))
        found = pd.DataFrame(out, columns=["part", "source", "item", "value", "terms"])
        return found.assign(lang=lang)[["lang", "part", "source", "item", "value", "terms"]]

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source; other columns are ignored).

    With p = 1 + floor(10^9 (count + 1) / (N + V)) of each kept term and f = floor((p - q)^2 / q), part ``pair`` gives
    each other source of the language as item and the sum of f over all kept terms, part ``term`` the ``top`` terms
    that are likelier in the group than in its language.  Ranks go by value, descending, then by item.  A group without
    terms takes part; a language without kept terms has pairs of value 0 and no terms; a language's only source has no
    pairs; an empty table gives no rows.
    """
    counts, groups = term_counts(docs, min_docs, shard_terms)
    order = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    sizes = counts.groupBy("lang").agg((1 + F.floor(F.count("*") / SHARD_ROWS)).alias("shards"))
    groups = groups.join(sizes, "lang", "left").withColumn("number", order)
    groups = cut_lineage(groups.withColumn("blocks", 1 + F.floor((F.count("*").over(W.partitionBy("lang")) - 1) / BLOCK)))
    # Every shard gets all sources of its language; counts get their source's number over salts, as a source can be hot.
    salts = F.sequence(F.lit(0), F.lit(15))
    known = groups.filter("shards is not null").withColumn("salt", F.explode(salts))
    dealt = (
        counts.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(16)).cast("int"))
        .join(known.select("lang", "source", "salt", "number", "shards", "blocks"), ["lang", "source", "salt"])
        .withColumn("shard", F.pmod(F.hash("term"), F.col("shards")))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("lang", "shard", "block", "source", "number", "term", "n", F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("kept"))
    )
    heads = (
        groups.filter("shards is not null")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("lang", "shard", "block", "source", "number", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), "total", "kept")
    )
    found = cut_lineage(
        dealt.unionByName(heads).groupBy("lang", "shard", "block")
        .applyInPandas(_evaluator(top, BLOCK), "lang string, part string, source string, item string, value long, terms long")
    )
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    zero = F.expr(f"1 + {SCALE} div nullif(total + kept, 0)")
    ours = groups.select("lang", "source", "kept", zero.alias("p"))
    theirs = groups.select("lang", F.col("source").alias("item"), zero.alias("q"))
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    rest = (F.col("kept") - F.coalesce("terms", F.lit(0))) * F.expr("((p - q) * (p - q)) div q")
    pairs = (
        ours.join(theirs, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
        .withColumn("value", F.coalesce(F.coalesce("value", F.lit(0)) + rest, F.lit(0)))
        .withColumn("rank", F.row_number().over(ranked))
    )
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return reduce(DataFrame.unionByName, [pairs.withColumn("part", F.lit("pair")).select(*columns), best.select(*columns)])


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS w FROM documents),
o AS (SELECT lang, source, r, unnest(w) AS t FROM d),
k AS (SELECT lang, t FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM o SEMI JOIN k USING (lang, t) GROUP BY 1, 2, 3),
p AS (SELECT g.lang, g.source, k.t, coalesce(n, 0) AS n,
  1 + {SCALE} * (coalesce(n, 0) + 1) // (CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS BIGINT) + v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, t)),
l AS (SELECT lang, t, 1 + {SCALE} * (CAST(sum(n) AS BIGINT) + 1) // (CAST(sum(sum(n)) OVER (PARTITION BY lang) AS BIGINT) + any_value(v)) AS q
  FROM p JOIN v USING (lang) GROUP BY 1, 2),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS s FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t
  AND a.source <> b.source GROUP BY 1, 2, 3),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang
  AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', t, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN l USING (lang, t) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e
QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
"""
