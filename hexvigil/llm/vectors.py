"""What the vector operators share: which rows take part, packed vectors, keys cut into even ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str, ident: str) -> Column:
    """Rows with an id and a vector without null, NaN or infinite components that isn't zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(F.col(ident).isNotNull() & finite & F.exists(x, lambda c: c != 0), F.lit(False))


def common_length(rows: DataFrame, vector: str) -> int:
    """The commonest length of a vector, the larger of equals; 0 without rows.  Others can't be compared with it."""
    found = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def stacked(column) -> np.ndarray:
    """Rows of a batch's packed vectors, in double precision."""
    data = b"".join(column)
    return np.frombuffer(data, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def cuts(keyed: DataFrame, keys: str, orderings: int, parts: int) -> np.ndarray:
    """For each ordering the ``parts - 1`` keys that cut its rows into parts of about equal size."""
    if parts < 2:
        return np.zeros((orderings, 0), np.int64)
    at = [i / parts for i in range(1, parts)]
    accuracy = F.lit(20 * parts)
    found = keyed.agg(*[F.percentile_approx(F.col(keys)[o], at, accuracy).alias(f"o{o}") for o in range(orderings)]).first()
    return np.array([x or [0] * (parts - 1) for x in found], np.int64)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index that links reach, for a symmetric matrix of links."""
    root = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        low = np.where(linked, root[None, :], len(root)).min(1)
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low
