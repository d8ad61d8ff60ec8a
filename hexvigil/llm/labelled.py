"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexvigil.llm.common import held_out

LEARN_ROWS = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_rows: int = LEARN_ROWS, balance: bool = False) -> pd.DataFrame:
    """About ``learn_rows`` rows (doc_id, text, label) that may be learned from, chosen by a hash of the id.

    Labels are 0 or 1; others, nulls and held-out ids are left out, and of several labels of an id the larger counts.
    With ``balance`` each label gets half of the rows, else all have the same chance; ``attrs["counts"]`` tells how many
    rows of each label may be learned from.  The number of rows bounds what
    the driver gets and what is broadcast to find the texts.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total, out = sum(counts.values()), None
    for value, n in sorted(counts.items()):
        share = learn_rows / 2 / n if balance else learn_rows / total
        part = known.filter((F.col("label") == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return pd.DataFrame({"doc_id": [], "text": [], "label": []})
    ids = out.toPandas().sort_values("doc_id")
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, label int"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").filter(F.col("text").isNotNull())
    sample = found.toPandas().sort_values(["doc_id", "text"]).drop_duplicates("text").reset_index(drop=True)
    sample.attrs["counts"] = counts
    return sample


def logistic(features, labels, rounds: int = 25, ridge: float = 1e-2):
    """Weights of a logistic regression, intercept last, by Newton's method."""
    import numpy as np

    x = np.c_[features, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (labels - p) - ridge * w)
    return w
