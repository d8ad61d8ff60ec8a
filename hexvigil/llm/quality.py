"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are its character trigrams, case kept, and a few measures of form (share of capitals, of symbols,
of repeated words and lines, length), each as a term of the bin it falls in.  Singular vectors of the labelled
documents' weighted term matrix span the latent space.  The labelled vectors go to every task, whose documents are
compared with all of them in matrix products; the nearest vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexvigil.llm.common import held_out, passes
from hexvigil.llm.labelled import LEARN_ROWS, labelled_sample

GRAMS, BINS = 4096, 16
LATENT, NEIGHBOURS, SHARPNESS = 48, 21, 4
FORM_WEIGHT = 3.0
#: Documents that one matrix product compares with the labelled ones.
ROWS = 512
_FORMS = 6

_KINDS = np.zeros(256, np.uint8)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 symbol
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 1, 2, 3
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4


@dataclass
class Model:
    weight: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _bin(share: float) -> int:
    return min(BINS - 1, int(share * BINS))


def _forms(raw: bytes, kinds: np.ndarray) -> list[int]:
    n = max(len(raw), 1)
    letters = max(int(kinds[1] + kinds[2]), 1)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    return [
        _bin(kinds[2] / letters),
        _bin(kinds[4] / n * 4),
        _bin(kinds[3] / n * 4),
        _bin(1 - len(set(words)) / max(len(words), 1)),
        _bin(1 - len(set(lines)) / max(len(lines), 1)),
        min(BINS - 1, int(np.log2(1 + len(words)))),
    ]


def terms(texts: list[str]) -> np.ndarray:
    """Dampened term counts of texts, one row each: trigrams, then bins of form."""
    out = np.zeros((len(texts), GRAMS + _FORMS * BINS), np.float32)
    for lo, hi in passes(texts):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
        data = np.frombuffer(b"\0\0".join([b"", *raw, b""]), np.uint8)
        code = data.astype(np.uint64)
        code = code[:-2] | (code[1:-1] << np.uint64(8)) | (code[2:] << np.uint64(16))
        gram = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
        lengths = np.array([len(r) + 2 for r in raw])
        owner = np.repeat(np.arange(len(raw)), lengths)
        # From text to text there are two zero bytes; the trigrams that begin in a text or one byte before are its own.
        counts = np.bincount(owner * GRAMS + gram[: len(owner)], minlength=len(raw) * GRAMS).reshape(len(raw), GRAMS)
        out[lo:hi, :GRAMS] = np.log1p(counts)
        for i, r in enumerate(raw):
            kinds = np.bincount(_KINDS[np.frombuffer(r, np.uint8)], minlength=5)
            for f, b in enumerate(_forms(r, kinds)):
                out[lo + i, GRAMS + f * BINS + b] = 1
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(matrix: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Trigrams to unit length, so that a document's length does not weigh, beside the form terms."""
    matrix = matrix * weight
    matrix[:, :GRAMS] = _unit(matrix[:, :GRAMS])
    return matrix


def fit(sample: pd.DataFrame) -> Model | None:
    """The model of (text, label) rows, or None without any."""
    if not len(sample):
        return None
    matrix = terms(sample["text"].tolist())
    weight = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(0))).astype(np.float32) + 0.1
    weight[GRAMS:] = FORM_WEIGHT / np.sqrt(_FORMS)
    matrix = _weighted(matrix, weight)
    # Leading right singular vectors by subspace iteration from a fixed start.
    space = np.random.default_rng(9).standard_normal((matrix.shape[1], min(LATENT, *matrix.shape))).astype(np.float32)
    for _ in range(8):
        space = np.linalg.qr(matrix.T @ (matrix @ space))[0]
    return Model(weight, space, _unit(matrix @ space), sample["label"].to_numpy(np.float32))


def votes(model: Model, texts: list[str]) -> np.ndarray:
    """The share of label 1 among each text's nearest labelled documents, weighed by their cosine."""
    ours = _unit(_weighted(terms(texts), model.weight) @ model.space)
    cosine = ours @ model.vectors.T
    k = min(NEIGHBOURS, len(model.labels))
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    power = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** SHARPNESS
    # Each label has the same weight in all, also where the sample has few rows of one.
    power *= np.where(model.labels == 1, 1 / max(model.labels.sum(), 1), 1 / max((1 - model.labels).sum(), 1))[near]
    return np.clip((power * model.labels[near]).sum(1) / power.sum(1), 0, 1)


def _scorer(model):
    def run(batches):
        known = model.value
        for batch in batches:
            texts, rest = batch["text"].fillna("").tolist(), batch.drop(columns="text")
            for lo in range(0, len(texts), ROWS):
                yield rest.iloc[lo : lo + ROWS].assign(score=votes(known, texts[lo : lo + ROWS]))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS, least: float = 0.3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1) and predicted (score >= ``least``).

    Learns from about ``learn_rows`` rows of ``labels`` (doc_id, quality) outside the hold-out, half of each label; their vectors
    are what is broadcast.  Null and empty texts are scored by their form.  Without labels all scores are 0.  A null
    doc_id counts as held out; other columns are ignored.
    """
    model = fit(labelled_sample(docs, labels, "quality", learn_rows, balance=True))
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id").alias("held_out"))
    if model is None:
        scored = docs.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        scored = docs.mapInPandas(_scorer(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
