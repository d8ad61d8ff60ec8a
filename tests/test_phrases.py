"""Phrases in texts and names in names, against ``in`` over all pairs."""

import random

import pytest

from hexvigil.functions import phrases as ph


def strings(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcé -") for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("many", "longest"), [(150, 4), (150, 12), (40, 30)])
def test_containing_equals_all_pairs(spark, many, longest):
    long, short = strings(120, 40, 1) + ["abcabcabcabc", "abcabcabcabc"], strings(many, longest, 2)
    short += [s[3:12] for s in long[:30]] + ["abcabcab", "never here"]
    found = ph.containing(
        spark.createDataFrame([(x,) for x in [*long, None]], "long string"), spark.createDataFrame([(x,) for x in [*short, None]], "short string")
    ).collect()
    expected = sorted((a, b) for a in set(long) for b in set(short) if b in a)
    assert sorted(tuple(r) for r in found) == expected


def test_containing_empty_tables(spark):
    some, none = spark.createDataFrame([("abc",)], "long string"), spark.createDataFrame([], "short string")
    assert ph.containing(some, none).count() == 0
    assert ph.containing(some.limit(0), some.withColumnRenamed("long", "short")).count() == 0


@pytest.mark.parametrize("block", [1000, 7])
def test_phrases_in_texts(spark, block):
    texts = [(i, t) for i, t in enumerate(strings(60, 200, 3))] + [(3, "ab ab"), (3, "ab ab"), (90, None), (91, "")]
    phrases = strings(40, 5, 4) + ["", "ab", "ab", "z"]
    df = spark.createDataFrame(texts, "id long, body string")
    dictionary = spark.createDataFrame([(p,) for p in [*phrases, None]], "phrase string")
    found = ph.phrases_in(df, ["id"], "body", dictionary, block).collect()
    expected = sorted((i, p) for i, t in texts if t is not None for p in set(phrases) if p in t)
    assert sorted(tuple(r) for r in found) == expected
    assert ph.phrases_in(df, ["id"], "body", dictionary.limit(0)).count() == 0


def test_a_name_in_many_others_gives_one_row_each(spark):
    """A common short name meets each long one once; the plan has no cross join."""
    long = spark.range(5000).selectExpr("concat('tool ', id) as long")
    found = ph.containing(long, spark.createDataFrame([("tool",), ("tool 4999 ",), ("tool 499",)], "short string"))
    assert found.groupBy("short").count().sort("short").collect() == [("tool", 5000), ("tool 499", 11)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
