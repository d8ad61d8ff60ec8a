"""The divergence audit against plain Python on awkward rows, small shards and few sources a block."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hexvigil.llm import divergence as op
from tests_llm_data import SCHEMA, awkward, empty_docs


def brute(rows, min_docs=3, top=200):
    """Rows of the audit of (text, lang, source) documents."""
    docs = [
        (lang or "", source or "", re.findall(op.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows
    ]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, w in own for t in set(w))
        kept = [t for t, n in df.items() if n >= min_docs]
        count = defaultdict(Counter)
        for _, source, w in own:
            count[source].update(t for t in w if df[t] >= min_docs)
        whole = sum(count.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in count.items():
            pairs = [
                (-sum((share(c, t) - share(d, t)) ** 2 // share(d, t) for t in kept), o) for o, d in count.items() if o != s
            ]
            own_terms = [(-((share(c, t) - share(whole, t)) ** 2 // share(whole, t)), t) for t in c if share(c, t) > share(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own_terms)[:top])):
                out += [(lang, s, part, item, -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def collected(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def several():
    """Documents of five sources with shared, own, rare and awkward terms."""
    words = "Alpha beta GAMMA delta épée Straße naïve x y zz".split()
    rows = []
    for i in range(120):
        lang, source = ("en", "de", None)[i % 3], (None, "a", "b", "é", "hot")[min(i % 11, 4)]
        picked = [words[(i * k) % len(words)] for k in range(1, 3 + i % 9)] + (["hotword"] * 5 if source == "hot" else [])
        rows.append((" ".join(picked) + f" once{chr(97 + i % 26)}{chr(97 + i // 26)} 42_3", lang, source))
    return rows + [(None, "en", "empty"), ("", "xx", "a"), ("one two", "yy", "a"), ("three", "yy", "b"), ("four", "yy", "c"), ("É é É", "en", "é")]


@pytest.mark.parametrize(("shard_terms", "rows_a_task", "block"), [(2_000_000, 100_000, 256), (20, 10, 2)])
def test_awkward_documents(spark, monkeypatch, shard_terms, rows_a_task, block):
    monkeypatch.setattr(op, "SHARD_ROWS", rows_a_task)
    monkeypatch.setattr(op, "BLOCK", block)
    given = several()
    rows = [(i, t, x, s, None, 7, "x") for i, (t, x, s) in enumerate(given)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert collected(op.audit(df, shard_terms=shard_terms)) == brute(given)


def test_top_terms_and_min_docs(spark):
    given = several()
    df = spark.createDataFrame([(i, t, x, s, None, 7, "x") for i, (t, x, s) in enumerate(given)], SCHEMA)
    assert collected(op.audit(df, min_docs=1, top=3)) == brute(given, 1, 3)


def test_shared_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    given = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert collected(op.audit(docs, min_docs=1)) == brute(given, 1)
    assert op.audit(empty_docs(spark)).count() == 0


def test_a_task_hands_sums_on_before_they_grow():
    """Sums of few entries at a time give the same counts."""
    import pyarrow as pa

    vector = pa.StructArray.from_arrays(
        [pa.array([[0, 3], [], [3, 5, 6]], pa.list_(pa.int32())), pa.array([[1.0, 2.0], [], [4.0, 1.0, 9.0]])], ["indices", "values"]
    )
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "a"]), vector], ["source", "vector"])
    for size in (1, 2, 100):
        total = Counter()
        for part in op._summing(size)([batch, batch]):
            for s, _, places, counts in zip(*(c.to_pylist() for c in part.columns), strict=True):
                total.update({(s, p): n for p, n in zip(np.frombuffer(places, np.uint32).tolist(), np.frombuffer(counts, np.int64).tolist(), strict=True)})
        assert total == {("a", 0): 2, ("a", 3): 12, ("a", 5): 2, ("a", 6): 18}
