"""Language identification of whole texts, mixed ones included.

Each word gets a score per language from letter trigrams (word ends included) learned from labelled documents; the
script of its letters narrows which languages take part.  Viterbi over the words of a text with a penalty for each
switch labels spans; the language with most letters is the document's.  The decoder works on all texts of a pass at
once: words are cut into chunks, each chunk's best paths between any two languages are found side by side, the chunks
of a text are then chained, so its steps don't grow with the longest text.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexvigil.llm.common import held_out, passes, with_fields

#: Buckets for trigrams.
FEATURES = 1 << 16
#: Labelled documents to learn a language from, at most about so many, chosen by a hash of the id.
LEARN_ROWS = 5000
#: Cost of a change of language between two words, in nats.
SWITCH = 12.0
#: A language takes part for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
CHUNK = 32

# Blocks of letters by script (first and last code point).
SCRIPTS = {
    "latin": ((0x0041, 0x024F), (0x1E00, 0x1EFF)),
    "greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x0400, 0x052F),),
    "armenian": ((0x0530, 0x058F),),
    "hebrew": ((0x0590, 0x05FF),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F)),
    "indic": ((0x0900, 0x0DFF),),
    "thai": ((0x0E00, 0x0E7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case form, 0 for anything but a letter; the number of its script, 0 for others."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            low = chr(c).lower() if kind in ("Lu", "Lt") else chr(c)
            lower[c] = ord(low) if len(low) == 1 else c
    script = np.zeros(0x110000, np.uint8)
    for n, blocks in enumerate(SCRIPTS.values(), 1):
        for a, b in blocks:
            script[a : b + 1] = n
    return lower, script


@dataclass
class Words:
    """The words (runs of letters) of some texts: their trigrams, places and scripts, and where each text begins."""

    trigrams: np.ndarray
    heads: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    firsts: np.ndarray


def words_of(texts: list[str]) -> Words:
    lower, script = _letters()
    code = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    low = lower[code]
    inside = low > 0
    at = np.flatnonzero(inside)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    firsts = np.searchsorted(starts, begins)
    x = low[at - 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x += low[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x += low[at + 1].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    trigrams = (x >> np.uint64(48)).astype(np.int64)
    lengths = ends - starts
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    return Words(trigrams, np.cumsum(lengths) - lengths, starts - begins[text], ends - begins[text], script[code[starts]], firsts)


def best_totals(scores: np.ndarray, firsts: np.ndarray, switch: float) -> np.ndarray:
    """For each word and language the best total of its text's words up to it, ending in that language."""
    n, k = scores.shape
    counts = np.diff(firsts)
    chunks = -(-counts // CHUNK)
    rank = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = np.repeat(firsts[:-1], chunks) + rank * CHUNK
    place = start[:, None] + np.arange(CHUNK)
    valid = place < np.repeat(firsts[1:], chunks)[:, None]
    step = np.where(valid[..., None], scores[np.minimum(place, max(n - 1, 0))], 0.0)
    enter = np.zeros((len(start), k))
    long = np.flatnonzero(np.repeat(chunks > 1, chunks))
    if len(long):
        through = np.full((len(long), k, k), -1e15)
        through[:, range(k), range(k)] = 0
        for t in range(CHUNK):
            through = np.maximum(through, through.max(-1, keepdims=True) - switch) + step[long, t, None, :]
        order = np.argsort(rank[long], kind="stable")
        for group in np.split(order, np.cumsum(np.bincount(rank[long]))[:-1])[1:]:
            at = long[group]
            enter[at] = (enter[at - 1][:, :, None] + through[group - 1]).max(1)
    out, now = np.empty_like(step), enter
    for t in range(CHUNK):
        now = np.maximum(now, now.max(-1, keepdims=True) - switch) + step[:, t]
        out[:, t] = now
    return out[valid]


def best_labels(scores: np.ndarray, firsts: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word on its text's best path; the first of equals."""
    if not len(scores):
        return np.empty(0, np.int64)
    ahead = best_totals(scores, firsts, switch)
    behind = best_totals(scores[::-1], len(scores) - firsts[::-1], switch)[::-1]
    return (ahead + behind - scores).argmax(1)


def _count(batches):
    for batch in batches:
        batch = batch[batch["text"].notna()]
        for lang, rows in batch.groupby("lang"):
            total = np.zeros(FEATURES + len(SCRIPTS) + 1, np.int64)
            texts = rows["text"].tolist()
            for lo, hi in passes(texts):
                words = words_of(texts[lo:hi])
                total[:FEATURES] += np.bincount(words.trigrams, minlength=FEATURES)
                total[FEATURES:] += np.bincount(words.scripts, words.ends - words.starts, len(SCRIPTS) + 1).astype(np.int64)
            found = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "feature": found, "n": total[found]})


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray


def learn(labelled: DataFrame, learn_rows: int = LEARN_ROWS, smooth: float = 0.5) -> Model:
    """Trigram scores from (doc_id, text, lang) rows; rows without a language are left out.

    The model has one row per trigram bucket and a column per language, whatever the corpus holds.
    """
    labelled = labelled.filter("lang is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((len(SCRIPTS) + 1, 0), bool))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, learn_rows / n)]), F.col("lang"))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    found = (
        sample.select("text", "lang").mapInPandas(_count, "lang string, feature long, n long")
        .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(found["lang"].unique())
    table = np.zeros((FEATURES + len(SCRIPTS) + 1, len(languages)))
    table[found["feature"], found["lang"].map({x: i for i, x in enumerate(languages)})] = found["n"]
    grams, letters = table[:FEATURES] + smooth, table[FEATURES:]
    allowed = letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(languages, np.log(grams / grams.sum(0)).astype(np.float32), allowed)


def _labeller(model: Model, switch: float):
    def label(texts: list[str]):
        words = words_of(texts)
        k = len(model.languages)
        n, docs = len(words.starts), len(texts)
        if not n or not k:
            return [(None, 0.0, [])] * docs
        scores = np.add.reduceat(model.scores[words.trigrams].astype(np.float64), words.heads)
        scores[~model.allowed[words.scripts]] -= 1e4
        scores -= scores.max(1, keepdims=True)
        chosen = best_labels(scores, words.firsts, switch)
        text = np.repeat(np.arange(docs), np.diff(words.firsts))
        letters = np.bincount(text * k + chosen, words.ends - words.starts, docs * k).reshape(docs, k)
        best = letters.argmax(1)
        share = letters[np.arange(docs), best] / np.maximum(letters.sum(1), 1)
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (chosen[1:] != chosen[:-1])])
        last = np.r_[new[1:], n] - 1
        spans: list[list] = [[] for _ in texts]
        for i, a, b, c in zip(text[new].tolist(), words.starts[new].tolist(), words.ends[last].tolist(), chosen[new].tolist(), strict=True):
            spans[i].append({"start": a, "end": b, "lang": model.languages[c]})
        return [(model.languages[b] if s else None, float(p), s) for b, p, s in zip(best, share, spans, strict=True)]

    def run(batches):
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for lo, hi in passes(texts):
                out = pd.DataFrame(label(texts[lo:hi]), columns=["lang_pred", "score", "spans"])
                yield out.assign(**{c: batch[c].iloc[lo:hi].array for c in batch.columns if c not in out})

    return run


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` (text and any others) with lang_pred, score and spans.

    ``spans`` lists (start, end, lang) in code points, end exclusive, from the first to the last letter of each run of
    words in one language; ``lang_pred`` has most letters of the text and ``score`` is its share of them, 0 to 1; of
    equals the first by name.  A text that is null or has no letter gets ``und``, 0 and no span, as does every text
    if nothing could be learned.  Columns of ``docs`` with a result's name are replaced.
    """
    docs = docs.drop("lang_pred", "score", "spans")
    schema = with_fields(docs.schema, "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")
    found = docs.mapInPandas(_labeller(model, switch), schema)
    return found.withColumn("lang_pred", F.coalesce("lang_pred", F.lit("und")))


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang and any others) labelled by what the rows outside the hold-out teach.

    Adds held_out, lang_pred, score and spans.  A null doc_id counts as held out.
    """
    model = learn(docs.filter(~held_out("doc_id")).select("doc_id", "text", "lang"))
    return identify(docs.withColumn("held_out", held_out("doc_id")), model)
