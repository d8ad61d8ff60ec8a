"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text, one on toxic text.  Toxic documents are mostly made of
ordinary words, which would hide what tells them apart, so their dictionary is trained on what is left of each when the
words are taken out that chance explains.  A window is one word of a text, repeated until it is long enough for
zstandard to compress it: the repeats cost next to nothing, so its length tells what the first costs.  Each is compressed
with the ordinary dictionary and with both; how many bytes the toxic one saves is the window's margin.

The features are compression lengths alone: how many windows reach each margin, and the largest margins.  Their effect
on the label is calibrated on the labelled sample by a logistic regression.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from math import lgamma, log, sqrt

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexvigil.llm.common import held_out
from hexvigil.llm.labelled import LEARN_ROWS, labelled_sample, logistic

#: Bytes of a stretch of text that dictionaries are trained on, and of a window at least.
STRETCH, WINDOW = 60, 48
#: Margins that a task keeps, so that a frequent word is compressed once; beyond it starts anew.
KEPT = 200_000
#: Windows are counted by how many bytes the toxic dictionary saves at least.
MARGINS = (2, 3, 4, 5, 6, 8)
#: How many of a text's largest margins count by themselves.
LARGEST = 3
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 4_800
#: Bytes that a training run keeps together, of ordinary and of toxic text.
SEGMENTS = 32, 24
#: Share of the words taken as telling toxic documents apart that may be so by chance.
FALSE_WORDS = 0.05

#: Bytes that a trained dictionary's entropy tables take at most.
TABLES = 400

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray


def stretches(text: str, size: int = STRETCH) -> list[bytes]:
    """All words of the text in lower case, joined by spaces and cut at spaces; longer words are cut as well."""
    text, out, at = " ".join(_WORD.findall(text.lower())), [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            space = text.rfind(" ", at, end + 1)
            end = space if space > at else end
        out.append(f" {text[at:end].strip()} ".encode())
        at = end
    return out


def window(word: str) -> bytes:
    part = f" {word}".encode()
    return part * max(2, -(-WINDOW // len(part))) + b" "


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    reach = max(14, len(dictionary).bit_length())
    settings = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_GREEDY, min_match=6, target_length=32,
        window_log=reach + 1, chain_log=reach, hash_log=reach, search_log=3, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=settings)


def _measure(ordinary: bytes, toxic: bytes):
    """Features of a text: how many windows reach each margin, against the noise in so many and as a logarithm, and the
    largest margins."""
    plain, both = _compressor(ordinary), _compressor(ordinary + toxic)
    known: dict[str, int] = {}

    def margin(word: str) -> int:
        found = known.get(word)
        if found is None:
            if len(known) >= KEPT:
                known.clear()
            x = window(word)
            found = known[word] = len(plain.compress(x)) - len(both.compress(x))
        return found

    def features(text: str) -> list[float]:
        margins = sorted((margin(w) for w in set(_WORD.findall(text.lower()))), reverse=True)
        reached = [sum(m >= k for m in margins) for k in MARGINS]
        return [*(n / sqrt(len(margins) + 20) for n in reached), *(log(1 + n) for n in reached), *(margins + [0] * LARGEST)[:LARGEST]]

    return features


def _chance(k: int, n: int, share: float) -> float:
    """Log of the probability that ``k`` or more of ``n`` documents are toxic by chance; ``k`` is above their mean."""
    first = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(share) + (n - k) * log(1 - share)
    total = term = 1.0
    for i in range(k, n):
        term *= (n - i) / (i + 1) * share / (1 - share)
        total += term
        if term < 1e-12:
            break
    return first + log(total)


def contrast(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words that stand in more toxic documents than chance allows, counted once a document, the surest first.

    Each word is tested on its own count (Benjamini and Hochberg's bound on the share of false ones).
    """
    ours = Counter(w for t in toxic for w in set(_WORD.findall(t.lower())))
    theirs = Counter(w for t in ordinary for w in set(_WORD.findall(t.lower())))
    share, tests, found = len(toxic) / (len(toxic) + len(ordinary)), len(ours | theirs), []
    for word, n in ours.items():
        if len(word) > 2 and n > share * (n + theirs[word]):
            found.append((_chance(n, n + theirs[word], share), word))
    found.sort()
    taken = max((i for i, (p, _) in enumerate(found, 1) if p <= log(FALSE_WORDS * i / tests)), default=0)
    return [word for _, word in found[:taken]]


def _trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """The content of a dictionary trained on the samples, without its entropy tables; the samples' own end where there
    are too few to train on.  Training goes through them by sections, so they are shuffled first."""
    samples = random.Random(0).sample(samples, len(samples))
    try:
        return zstandard.train_dictionary(size + TABLES, samples, k=segment, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def surplus(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """What is left of each toxic text when all words that chance explains are taken out."""
    kept = set(contrast(toxic, ordinary))
    left = ([w for w in _WORD.findall(t.lower()) if w in kept] for t in toxic)
    return [f" {' '.join(words)} ".encode() for words in left if words]


def fit(sample: pd.DataFrame) -> Model | None:
    """The model of (text, label) rows, or None unless both labels occur.

    If ``sample.attrs`` has the rows of each label that the sample stands for (``counts``), scores follow their odds.
    """
    toxic, ordinary = (sample.loc[sample["label"] == v, "text"].tolist() for v in (1, 0))
    if not toxic or not ordinary:
        return None
    plain = _trained(ORDINARY_BYTES, [w for t in ordinary for w in stretches(t)], SEGMENTS[0])
    own = _trained(TOXIC_BYTES, surplus(toxic, ordinary), SEGMENTS[1])
    features = _measure(plain, own)
    found = np.array([features(t) for t in toxic + ordinary])
    weights = logistic(found, np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))])
    if counts := sample.attrs.get("counts"):
        weights[-1] += log(counts[1] / counts[0]) - log(len(toxic) / len(ordinary))
    return Model(plain, own, weights)


def _scorer(model: Model):
    def run(batches):
        features = _measure(model.ordinary, model.toxic)
        for batch in batches:
            found = np.array([features(t) for t in batch["text"].fillna("")]).reshape(len(batch), 2 * len(MARGINS) + LARGEST)
            score = 1 / (1 + np.exp(-(found @ model.weights[:-1] + model.weights[-1])))
            yield batch.drop(columns="text").assign(score=score)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1) and predicted (score >= 0.5).

    Learns from about ``learn_rows`` of the rows of ``labels`` (doc_id, toxic) outside the hold-out, half of them toxic
    if there are so many; scores follow the odds of all.  Null and empty
    texts have no window and get the score of none.  Without labels of both kinds all scores are 0.  A null doc_id
    counts as held out; other columns are ignored.
    """
    model = fit(labelled_sample(docs, labels, "toxic", learn_rows, balance=True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id").alias("held_out"))
    if model is None:
        scored = docs.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        scored = docs.mapInPandas(_scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
