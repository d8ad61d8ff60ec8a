"""Best-fit packing of token pieces by exact complements of length counts.

What goes into a sequence depends on lengths alone, so the plan is made from the histogram of lengths (at most as
many numbers as the limit, whatever the corpus holds).  For each length, from the longest, the gap it leaves is looked
up among single, pair and triple sums of the lengths still available; a combination that fills it exactly is used as
often as the counts allow.  A gap without such a combination takes the longest piece that fits and is looked up again.
Each step uses a length or a combination up, which bounds the plan's size by the limit too.  Spark numbers the
pieces of a length and looks each number up in the plan.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexvigil.llm.common import passes, with_fields
from hexvigil.session import cut_lineage

LIMIT = 2048
#: Pieces of one length are numbered in groups of so many row ids at most.
GROUP_BITS = 16


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Encoder of texts to ids of the vocabulary at ``path`` (a byte-level BPE file of the tokenizers library).

    tiktoken merges by the same ranks and is several times faster; texts that hold the string of a special token,
    which the library recognises, go through the library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode_ordinary(text), "<u4")

    return encode


def _cutter(path: str, limit: int, with_ids: bool):
    def run(batches):
        encode = _encoder(path)
        for batch in batches:
            texts, ids = batch["text"].fillna("").tolist(), batch["doc_id"]
            for lo, hi in passes(texts):
                rows, at = [], []
                for i in range(lo, hi):
                    tokens = np.append(encode(texts[i]), np.uint32(0)).astype("<u4")
                    first = (len(tokens) - 1) % limit + 1
                    cuts = [0, *range(first, len(tokens) + 1, limit)]
                    for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        own = tokens[a:b]
                        rows.append((piece, a, b - a, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
                        at.append(i)
                out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32", "ids"])
                yield out.assign(doc_id=ids.iloc[at].array) if with_ids else out.assign(doc_id=ids.iloc[at].array).drop(columns="ids")

    return run


def cut_pieces(docs: DataFrame, path: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    A document is its text's ids (null: no text), then id 0.  One that is longer than ``limit`` is cut so that all
    pieces but the first are full.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_cutter(path, limit, with_ids), schema)


class _Lengths:
    """Available pieces by length, with an index of the sums of two different or equal lengths."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.copy()
        self.index = None

    def use(self, content: dict[int, int], times: int) -> None:
        for length, each in content.items():
            self.n[length] -= each * times
            if self.n[length] <= 1:
                self.index = None

    def sums(self) -> np.ndarray:
        if self.index is None:
            there = (self.n > 0).astype(np.float32)
            self.index = np.convolve(there, there)[: len(self.n)] > 0.5
        return self.index

    @staticmethod
    def pair(free: np.ndarray, gap: int) -> tuple[int, int] | None:
        long = np.arange((gap + 1) // 2, gap)
        fits = (free[long] > 0) & (free[gap - long] > 0) & ((2 * long != gap) | (free[long] > 1))
        found = long[fits]
        return (int(found[-1]), gap - int(found[-1])) if len(found) else None

    def exact(self, free: np.ndarray, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that sum to the gap, the fewest and longest first."""
        if free[gap] > 0:
            return (gap,)
        if not self.sums()[: gap + 1].any():
            return None
        if found := self.pair(free, gap):
            return found
        first = np.arange(1, gap)
        for a in first[(free[1:gap] > 0) & self.sums()[gap - first]][::-1].tolist():
            free[a] -= 1
            found = self.pair(free, gap - a)
            free[a] += 1
            if found:
                return (a, *found)
        return None


def pack_lengths(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: pieces in each}) patterns that use up ``counts`` (by length, index 0 unused)."""
    limit, lengths, out = len(counts) - 1, _Lengths(counts), []
    for longest in range(limit, 0, -1):
        while lengths.n[longest] > 0:
            content, gap, free = {longest: 1}, limit - longest, lengths.n.copy()
            free[longest] -= 1
            while gap:
                if found := lengths.exact(free, gap):
                    for x in found:
                        content[x] = content.get(x, 0) + 1
                    break
                fits = np.flatnonzero(free[1 : gap + 1]) + 1
                if not len(fits):
                    break
                best = int(fits[-1])
                each = int(min(free[best], gap // best))
                content[best] = content.get(best, 0) + each
                free[best] -= each
                gap -= best * each
            times = min(int(lengths.n[x]) // each for x, each in content.items())
            lengths.use(content, times)
            out.append((times, content))
    return out


def _placer(counts: np.ndarray):
    """Sequence and offset of the n-th piece of a length, as a function over batches."""
    slots, sequence = [], 0
    for times, content in pack_lengths(counts):
        offset = 0
        for length, each in content.items():
            slots.append((length, sequence, offset, each, times * each))
            offset += length * each
        sequence += times
    slots.sort(key=lambda s: s[0])
    length, first, offset, each, size = (np.array(x, np.int64) for x in zip(*slots, strict=True)) if slots else [np.zeros(0, np.int64)] * 5
    start = np.cumsum(size) - size
    base = np.cumsum(counts) - counts

    def run(batches):
        for batch in batches:
            at = base[batch["length"].to_numpy()] + batch["_nth"].to_numpy()
            slot = np.searchsorted(start, at, "right") - 1
            nth = at - start[slot]
            yield batch.drop(columns="_nth").assign(
                sequence_id=first[slot] + nth // each[slot], offset=offset[slot] + nth % each[slot] * length[slot]
            )

    return run


def pack_pieces(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (with a column length from 1 to ``limit``) with sequence_id and offset.

    Equal pieces are told apart by their row in a checkpointed copy, so repeated rows and null ids are no special case.
    An empty table gives no rows.  Columns named as results are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    pieces = cut_lineage(pieces.withColumn("_row", F.monotonically_increasing_id()))
    group = F.shiftright("_row", GROUP_BITS).alias("_group")
    tallies = cut_lineage(pieces.groupBy("length", group).agg(F.count("*").alias("_n")))
    counts = np.zeros(limit + 1, np.int64)
    for length, n in tallies.groupBy("length").agg(F.sum("_n")).collect():  # at most ``limit`` rows
        counts[length] = n
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_group")) - F.col("_n")
    nth = F.row_number().over(W.partitionBy("length", "_group").orderBy("_row")) - 1
    numbered = (
        pieces.withColumn("_group", group)
        .withColumn("_in", nth)
        .join(tallies.select("length", "_group", before.alias("_before")), ["length", "_group"])
        .select(*columns, (F.col("_before") + F.col("_in")).alias("_nth"))
    )
    schema = with_fields(numbered.drop("_nth").schema, "sequence_id long, offset long")
    return numbered.mapInPandas(_placer(counts), schema)


def best_fit(docs: DataFrame, path: str | None = None, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """All documents (doc_id, text) as pieces packed into sequences of at most ``limit`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).  ``path`` names the
    vocabulary file, which every worker's Python environment holds.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_pieces(cut_pieces(docs, path, limit, with_ids), limit)
