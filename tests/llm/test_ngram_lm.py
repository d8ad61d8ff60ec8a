"""The interpolated language model against dictionaries of whole words in plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hexvigil.llm import ngram_lm as op
from tests_llm_data import SCHEMA, awkward, empty_docs, read


def crc(ident):
    return zlib.crc32(("" if ident is None else str(ident)).encode())


def brute(rows, order=3):
    """Sorted results of (doc_id, text) rows by the same model over tuples of words."""
    docs = []
    for ident, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs.append((ident, ["<"] * (order - 1) + [f"w{w}" for w in words] + [">"]))

    def grams(line, k):
        return [tuple(line[i - k + 1 : i + 1]) for i in range(order - 1, len(line))]

    train = [d for d in docs if crc(d[0]) % 5 != 1]
    counts = [Counter(g for _, line in train for g in grams(line, k)) for k in range(1, order + 1)]
    n, v = sum(counts[0].values()), len(counts[0])

    def features(line, deleted):
        own = [Counter(grams(line, k)) if deleted else Counter() for k in range(1, order + 1)]
        for i in range(order - 1, len(line)):
            level, context, estimates = 0, 0, []
            for k in range(1, order + 1):
                prior = tuple(line[i - k + 1 : i])
                if k == 1:
                    before = n - (len(line) - order + 1) * deleted
                elif prior[-1] == "<":
                    before = len(train) - deleted
                else:
                    before = counts[k - 2][prior] - own[k - 2][prior]
                gram = tuple(line[i - k + 1 : i + 1])
                estimates.append((counts[k - 1][gram] - own[k - 1][gram]) / before if before > 0 else 0.0)
                if before > 0:
                    level, context = k, before
            yield level * 64 + (int(math.log2(context)) if level else 0), estimates

    grid = Counter()
    for ident, line in train:
        if crc(ident) // 5 % 5 == 0:
            for b, estimates in features(line, 1):
                grid[b, tuple(int(min(1 + np.rint(-op.STEPS * np.log2(e)), op.GRID)) if e > 0 else 0 for e in estimates)] += 1
    learned = []
    for b in {b for b, _ in grid}:
        level = b // 64
        weights = [1 / (level + 1)] * (level + 1)
        for _ in range(op.ROUNDS):
            got = [1.0] * (level + 1)
            for (bucket, g), c in grid.items():
                if bucket == b:
                    parts = [weights[0] / (v + 1), *(w * (2.0 ** (-(x - 1) / op.STEPS) if x else 0) for w, x in zip(weights[1:], g, strict=False))]
                    for k, x in enumerate(parts):
                        got[k] += c * x / sum(parts)
            weights = [x / sum(got) for x in got]
        learned.append({"bucket": b, "weights": weights})
    table = op._table_of_weights(learned, order)
    out = []
    for ident, line in docs:
        likely = [table[b][0] / (v + 1) + sum(w * e for w, e in zip(table[b][1:], x, strict=True)) for b, x in features(line, 0)]
        c = [counts[0][w,] for w in line[order - 1 :]]
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c)
        out.append((ident, crc(ident) % 5 == 1, len(c), sum(x > 0 for x in c), n, base, sum(map(math.log10, likely))))
    return ordered(out)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def agree(found, expected):
    found = ordered(tuple(r) for r in found)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def corpus():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, 1 + i % 17, p=rng.dirichlet(np.ones(40) / 5)))) for i in range(150)]
    return rows + [(3, "w1 w2 W1  w2"), (3, "w1 w2 W1  w2"), (900, ""), (901, None), (None, "w1 new"), (902, "Ünï w1\nw2")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_dictionaries(spark, order):
    df = spark.createDataFrame([(i, t, "x", "y", None, 1, "z") for i, t in corpus()], SCHEMA).repartition(3)
    found = op.score_texts(df, order=order)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    agree(found.collect(), brute(corpus(), order))


def test_small_blocks_and_buckets(spark):
    """Documents cut into pieces and grams dealt to many buckets; only the held-out counts of cut documents differ."""
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", "y", None, 1, "z") for i, t in rows], SCHEMA)
    agree(op.score_texts(df, block_tokens=64, bucket_grams=50).collect(), brute(rows))
    cut = ordered(tuple(r) for r in op.score_texts(df, block_tokens=4, bucket_grams=50).collect())
    for a, b in zip(cut, brute(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=0.1)


def test_shared_awkward_rows(spark):
    docs = awkward(spark)
    agree(op.score_texts(docs).collect(), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_without_rows_or_training_documents(spark):
    assert op.score_texts(empty_docs(spark)).count() == 0
    held = [i for i in range(100) if crc(i) % 5 == 1]
    df = spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")
    rows = op.score_texts(df).collect()
    assert len(rows) == len(held) and all(r["score"] == r["base_score"] == 0 and r["n_known"] == r["train_tokens"] == 0 for r in rows)


def test_held_out_documents_get_likelier(spark):
    """On the table each order tells held-out texts apart better than the one below, and all better than the base."""
    docs, totals = read(spark, "documents"), []
    for order in (1, 2, 3):
        held = op.score_texts(docs, order=order).filter("held_out")
        totals.append(held.selectExpr("sum(score) s", "sum(base_score) b").first())
    assert totals[0]["b"] < totals[0]["s"] < totals[1]["s"] < totals[2]["s"]


def test_probabilities_of_a_context_add_up_to_one():
    """The table of weights gives every bucket a distribution over its level's estimates and the uniform one."""
    table = op._table_of_weights([{"bucket": 130, "weights": [0.1, 0.2, 0.7]}], 3)
    assert np.allclose(table.sum(1), 1) and table[130, 2] == 0.7 and table[150, 2] == 0.7 and table[129, 2] == pytest.approx(1 / 3)
    assert all(table[b, b // 64 + 1 :].sum() == 0 for b in range(256))


def test_packing_and_long_texts(monkeypatch):
    for values in ([], [0], [1, 255, 256], [2**63, 5, 2**64 - 1], list(range(1000))):
        x = np.array(values, np.uint64)
        assert (op.unpacked(op.packed(x)) == x).all()
    texts = ["a b", "  Word " * 50 + "x" * 300, "", "one two\tthree " * 9]
    whole = [w.tolist() for w in op._tokens(texts)]
    monkeypatch.setattr(op, "PASS_CHARS", 20)
    assert [w.tolist() for w in op._tokens(texts)] == whole and [len(w) for w in whole] == [2, 51, 0, 27]
