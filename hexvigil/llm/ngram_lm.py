"""Language-model scores by deleted interpolation of n-grams.

The corpus is encoded once: tasks write blocks of token sequences as places in the block's own sorted word hashes.  Then
each block sends its distinct n-grams of every order with its training counts to buckets by hash; a bucket adds them up
over all blocks and answers each with the corpus counts of just what it asked for, in the order asked.  So a gram travels
once a block, hot or not, nothing of the corpus is broadcast, and no table of counts passes through the driver.

A token's probability mixes the maximum-likelihood estimates of all orders and a uniform one.  The weights depend on the
longest context that training knows and on how often it occurs (buckets by powers of two).  They are learned by
expectation-maximisation on held-out counts: a fifth of the training documents, each held out in turn, as its own counts
are deleted before its tokens are looked up.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexvigil.llm.common import _STEP, PASS_CHARS, mix, passes, word_hashes
from hexvigil.session import scratch_path

ORDER = 3
#: Tokens of a block, and n-grams of a bucket: what one task holds at a time.  A block sends one row to each bucket that
#: it has grams for, never more rows than grams; far beyond 10^12 tokens larger blocks keep these rows long.
BLOCK_TOKENS, BUCKET_GRAMS = 1 << 20, 1 << 20
#: Hashes of two words and more have so many bits beyond those that count the corpus: a gram meets another by chance
#: once in 2^20.  Single words keep 64 bits.
SPARE_BITS = 20
#: Steps of a probability's logarithm (base 2) on the grid that the weights are learned on, and its last place.
STEPS, GRID = 2, 100
ROUNDS = 60

_END, _BEGIN = (mix(np.array([n], np.uint64))[0] for n in (0x656E64, 0x626567696E))
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_BLOCK = "block long, tune boolean, rows array<long>, ids array<long>, train array<boolean>, lengths array<int>, words binary, places binary"


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers byte by byte, the same bytes of all together, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64).ravel()


def _tokens(texts: list[str]):
    """The word hashes of each text; long texts are cut at white space, which bounds what one pass holds."""
    for lo, hi in passes(texts):
        if hi - lo > 1 or len(texts[lo]) <= PASS_CHARS:
            words, firsts = word_hashes(texts[lo:hi])
            yield from (words[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True))
            continue
        text, at, parts = texts[lo], 0, []
        while at < len(text):
            cut = _SPACE.search(text, at + PASS_CHARS)
            end = cut.start() if cut else len(text)
            parts.append(word_hashes([text[at:end]])[0])
            at = end
        yield np.concatenate(parts)


class _Builder:
    """Collects pieces of documents (context, then tokens to score) until they make a block."""

    def __init__(self, tune: bool, order: int, limit: int):
        self.tune, self.context, self.limit, self.pieces, self.size = tune, order - 1, limit, [], 0

    def add(self, row: int, ident, train: bool, words: np.ndarray):
        line = np.concatenate([np.full(self.context, _BEGIN), words, [_END]])
        at, tokens = 0, len(words) + 1
        while at < tokens:
            n = min(tokens - at, self.limit)
            self.pieces.append((row, ident, train, n, line[at : at + n + self.context]))
            self.size, at = self.size + n, at + n
            if self.size >= self.limit:
                yield self

    def block(self, number: int) -> pa.RecordBatch:
        rows, ids, train, lengths, lines = zip(*self.pieces, strict=True)
        words, places = np.unique(np.concatenate(lines), return_inverse=True)
        self.pieces, self.size = [], 0
        columns = [
            pa.array([number], pa.int64()), pa.array([self.tune]), pa.array([rows], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())),
            pa.array([train], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
            pa.array([packed(np.diff(words, prepend=np.uint64(0)))], pa.binary()), pa.array([packed(places)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "tune", "rows", "ids", "train", "lengths", "words", "places"])


def _encoder(order: int, limit: int):
    def run(batches):
        # Numbers of rows and blocks are unique, as only one attempt of a task writes its files.
        row = number = TaskContext.get().partitionId() << 33
        builders = [_Builder(tune, order, limit) for tune in (False, True)]
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            facts = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "train", "tune")), strict=True)
            for (ident, train, tune), words in zip(facts, _tokens(texts), strict=True):
                for full in builders[tune].add(row, ident, train, words):
                    yield full.block(number)
                    number += 1
                row += 1
        for builder in builders:
            if builder.pieces:
                yield builder.block(number)
                number += 1

    return run


class _Grams:
    """The n-grams of a block: for each order the sorted distinct ones and, for each token, its place among them."""

    def __init__(self, block, order: int, bits: int):
        context, lengths = order - 1, np.asarray(block.lengths, np.int64)
        words = np.cumsum(unpacked(block.words), dtype=np.uint64)
        line = words[unpacked(block.places).astype(np.int64)]
        starts = np.cumsum(lengths + context) - lengths - context
        scored = np.ones(len(line), bool)
        for k in range(context):
            scored[starts + k] = False
        self.piece = np.repeat(np.arange(len(lengths)), lengths)
        self.train = np.repeat(np.asarray(block.train, bool), lengths)
        self.firsts = np.cumsum(lengths) - lengths
        self.distinct, self.place, self.known, self.line = [], [], [], line
        hashes = line
        for k in range(1, order + 1):
            if k > 1:
                hashes = mix(np.concatenate([[np.uint64(0)], hashes[:-1]]) * _STEP + line)
            # The last token of a cut document's context is looked up, so that it can be a context's count, not counted.
            asked = scored.copy()
            if context and k < order:
                asked[starts + context - 1] = True
            grams = hashes[asked] if k == 1 else hashes[asked] >> np.uint64(64 - bits)
            distinct, place = np.unique(grams, return_inverse=True)
            spread = np.zeros(len(line), np.int64)
            spread[asked] = place
            self.distinct.append(distinct)
            self.place.append(spread)
            self.known.append(np.bincount(spread[scored], self.train, len(distinct)).astype(np.uint64))
        self.scored = np.flatnonzero(scored)
        self.opens = line[self.scored - 1] == _BEGIN if context else np.zeros(len(self.scored), bool)


def _sender(order: int, bits: int, parts: int):
    """Rows (order, bucket, block) with a block's distinct grams of that bucket and how often its training part has them."""

    def run(batches):
        for batch in batches:
            for block in batch.itertuples(index=False):
                grams, out = _Grams(block, order, bits), []
                for k in range(order):
                    distinct, known = grams.distinct[k], grams.known[k]
                    bucket = (distinct >> np.uint64((64 if k == 0 else bits) - parts)).astype(np.int64) if parts else np.zeros(len(distinct), np.int64)
                    first = np.flatnonzero(np.diff(bucket, prepend=-1))
                    for a, b in zip(first, [*first[1:], len(bucket)], strict=True):
                        out.append((k + 1, bucket[a], block.block, block.tune, packed(np.diff(distinct[a:b], prepend=np.uint64(0))), packed(known[a:b])))
                yield pd.DataFrame(out, columns=["order", "bucket", "block", "tune", "grams", "known"])

    return run


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The corpus counts of a bucket's grams, given back to each block in its order; ``fresh`` counts those in training."""
    parts = [np.cumsum(unpacked(g), dtype=np.uint64) for g in rows["grams"]]
    distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
    known = np.concatenate([unpacked(n) for n in rows["known"]])
    total = np.zeros(len(distinct), np.uint64)
    np.add.at(total, place, known)
    ends = np.cumsum([len(p) for p in parts])
    fresh = np.zeros(len(rows), np.int64)
    fresh[0] = np.count_nonzero(total)
    counts = [packed(total[place[e - len(p) : e]]) for e, p in zip(ends, parts, strict=True)]
    return pd.DataFrame({"order": key[0], "bucket": key[1], "block": rows["block"], "tune": rows["tune"], "counts": counts, "fresh": fresh})


def _estimates(block, replies: pd.DataFrame, order: int, bits: int, totals: tuple[int, int], deleted: bool):
    """Per scored token: its level and context bucket, the estimates by order, its word's count; and the grams.

    With ``deleted`` the counts of the token's own piece of a document are taken out first.
    """
    grams = _Grams(block, order, bits)
    tokens, docs = totals
    replies = replies.sort_values(["order", "bucket"])
    at, counts = grams.scored, []
    own_length = np.bincount(grams.piece)[grams.piece] if deleted else 0
    before = np.full(len(at), tokens) - own_length
    level, context, estimate = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), []
    for k in range(order):
        answers = replies.loc[replies["order"] == k + 1, "counts"]
        count = np.concatenate([unpacked(a) for a in answers]).astype(np.int64)[grams.place[k]]
        if deleted:
            key = grams.piece * np.int64(len(grams.distinct[k])) + grams.place[k][at]
            _, place, often = np.unique(key, return_inverse=True, return_counts=True)
            count[at] -= often[place]
        here = count[at]
        counts.append(here)
        seen = before > 0
        estimate.append(np.where(seen, here / np.maximum(before, 1), 0.0))
        level[seen], context[seen] = k + 1, before[seen]
        before = np.where(grams.opens, docs - deleted, count[at - 1])
    bucket = level * 64 + np.where(level > 0, np.log2(np.maximum(context, 1)).astype(np.int64), 0)
    return grams, bucket, estimate, counts[0]


def _surveyor(order: int, bits: int, totals: tuple[int, int]):
    """How many held-out tokens have which context bucket and estimates, on a grid."""

    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", *(f"e{k}" for k in range(order))]
        if not len(blocks):
            return pd.DataFrame({n: [] for n in [*names, "n"]})
        _, bucket, estimate, _ = _estimates(blocks.iloc[0], replies, order, bits, totals, True)
        with np.errstate(divide="ignore"):
            grid = [np.where(e > 0, np.minimum(1 + np.rint(-STEPS * np.log2(e)), GRID), 0).astype(np.int64) for e in estimate]
        key = bucket
        for g in grid:
            key = key * (GRID + 1) + g
        key, n = np.unique(key, return_counts=True)
        out = {"n": n}
        for name in reversed(names[1:]):
            key, out[name] = np.divmod(key, GRID + 1)
        return pd.DataFrame({"bucket": key} | out)[[*names, "n"]]

    return run


def _maximiser(order: int, types: int):
    """Expectation-maximisation of one bucket's weights; a pseudo-count of one keeps each above 0."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        level, n = int(key[0]) // 64, rows["n"].to_numpy(float)
        grid = rows[[f"e{k}" for k in range(level)]].to_numpy()
        likely = np.hstack([np.full((len(rows), 1), 1 / (types + 1)), np.where(grid > 0, 2.0 ** (-(grid - 1.0) / STEPS), 0.0)])
        weights = np.full(level + 1, 1 / (level + 1))
        for _ in range(ROUNDS):
            share = likely * weights
            got = 1 + n @ (share / share.sum(1, keepdims=True))
            weights = got / got.sum()
        return pd.DataFrame({"bucket": [key[0]], "weights": [weights.tolist()], "n": [int(n.sum())]})

    return run


def _scorer(order: int, bits: int, totals: tuple[int, int], types: int, weights: np.ndarray):
    tokens = totals[0]

    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["row", "doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
        if not len(blocks):
            return pd.DataFrame({c: [] for c in columns})
        block = blocks.iloc[0]
        grams, bucket, estimate, count = _estimates(block, replies, order, bits, totals, False)
        mixed = weights[bucket]
        likely = mixed[:, 0] / (types + 1)
        for k, e in enumerate(estimate, 1):
            likely = likely + mixed[:, k] * e
        base = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))
        sums = [np.add.reduceat(x, grams.firsts) for x in ((count > 0).astype(np.int64), base, np.log10(likely))]
        out = [block.rows, pd.array(block.ids, "Int64"), np.asarray(block.train, bool), np.asarray(block.lengths, np.int64), *sums]
        return pd.DataFrame(dict(zip(columns, out, strict=True)))

    return run


def _table_of_weights(found: list, order: int) -> np.ndarray:
    """Weights by bucket; one that no held-out token met takes those of the nearest lower context of its level, or equal ones."""
    known = {r["bucket"]: r["weights"] for r in found}
    table = np.zeros(((order + 1) * 64, order + 1))
    for level in range(order + 1):
        now = [1 / (level + 1)] * (level + 1)
        for b in range(level * 64, level * 64 + 64):
            now = known.get(b, now)
            table[b, : level + 1] = now
    return table


def score_texts(
    docs: DataFrame, order: int = ORDER, folds: int = 5, held_fold: int = 1, block_tokens: int = BLOCK_TOKENS,
    bucket_grams: int = BUCKET_GRAMS,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, then one end.  Documents whose crc32(doc_id as text)
    mod ``folds`` is ``held_fold`` are held out, the others are learned from; a null id counts as empty text.
    ``base_score`` is the log10 probability under words smoothed by a half, ``score`` the interpolated model's.  Null and
    empty texts have the end as their only token.  Rows that repeat an id count and are scored each.  Without training
    documents both scores are 0 for every token; an empty table gives no rows.  Other columns are ignored.

    Counts cover every training document; words are told apart by 64-bit hashes (a chance of 3 in 100 that two of 10^9
    are taken for one).  Texts are read once, everything later works on the encoded blocks, which are written below the
    checkpoint folder.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    train = crc % folds != held_fold
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"), (train & (F.floor(crc / folds) % 5 == 0)).alias("tune")
    )
    path, answers = scratch_path(spark, "lm-blocks"), scratch_path(spark, "lm-counts")
    given.mapInArrow(_encoder(order, block_tokens), _BLOCK).write.parquet(path)
    blocks = spark.read.schema(_BLOCK).parquet(path)
    each = blocks.select(F.explode(F.arrays_zip("lengths", "train")).alias("x")).select("x.*")
    total, tokens = each.agg(F.sum("lengths"), F.sum(F.when(F.col("train"), F.col("lengths")))).first()
    total, tokens = total or 0, tokens or 0
    bits = min(64, total.bit_length() + SPARE_BITS)
    parts = min(bits, (total // bucket_grams).bit_length())
    sent = blocks.select("block", "tune", "lengths", "train", "words", "places").mapInPandas(
        _sender(order, bits, parts), "order int, bucket long, block long, tune boolean, grams binary, known binary"
    )
    schema = "order int, bucket long, block long, tune boolean, counts binary, fresh long"
    sent.groupBy("order", "bucket").applyInPandas(_merge, schema).write.parquet(answers)
    replies = spark.read.schema(schema).parquet(answers)
    types = replies.filter("order = 1").agg(F.sum("fresh")).first()[0] or 0
    # Each training document has one end: how many there are is how often a document's beginning is a context.
    docs_known = given.filter("train").count()
    totals = tokens, docs_known
    names = ", ".join(f"e{k} int" for k in range(order))
    tuned = (
        blocks.filter("tune").groupBy("block").cogroup(replies.filter("tune").groupBy("block"))
        .applyInPandas(_surveyor(order, bits, totals), f"bucket int, {names}, n long")
    )
    tuned = tuned.groupBy("bucket", *(f"e{k}" for k in range(order))).agg(F.sum("n").alias("n"))
    found = tuned.groupBy("bucket").applyInPandas(_maximiser(order, types), "bucket int, weights array<double>, n long").collect()
    scored = (
        blocks.groupBy("block").cogroup(replies.groupBy("block"))
        .applyInPandas(
            _scorer(order, bits, totals, types, _table_of_weights(found, order)),
            "row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    whole = scored.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), (~F.first("train")).alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")],
    )
    return whole.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
