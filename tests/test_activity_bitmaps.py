"""Day bitmaps against distinct counts, days added one by one."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hexvigil.operators import activity_bitmaps as bits

START = dt.date(2024, 3, 1)


def log(spark, seed=1, users=90_000, n=3000):
    rnd = random.Random(seed)
    rows = [(rnd.choice([rnd.randrange(users), rnd.randrange(40)]), START + dt.timedelta(days=rnd.randrange(12)), rnd.random() < 0.3) for _ in range(n)]
    return rows, spark.createDataFrame([*rows, (None, START, True), (5, None, True)], "user long, day date, queried boolean")


def test_windows_equal_distinct_counts(spark):
    rows, df = log(spark)
    found = bits.day_bitmaps(df, "user", "day", {"queried": F.col("queried")}).cache()
    for lo, hi in ((0, 12), (2, 3), (4, 9), (20, 30)):
        days = [START + dt.timedelta(days=d) for d in range(lo, hi)]
        some = found.where(F.col("day").isin(days))
        for kind, test in (("any", lambda q: True), ("queried", lambda q: q)):
            expected = len({u for u, d, q in rows if d in days and test(q)})
            assert (bits.users_of(some.where(F.col("kind") == kind)).first()["users"] or 0) == expected
        assert (bits.returned_users(some).first()["users"] or 0) == sum(
            len({d for v, d, _ in rows if v == u and d in days}) > 1 for u in {u for u, *_ in rows}
        )


def test_a_day_is_added_without_touching_others(spark, tmp_path):
    rows, df = log(spark, 2, 500, 800)
    path = str(tmp_path / "days")
    for i in range(12):
        day = START + dt.timedelta(days=i)
        bits.store_days(bits.day_bitmaps(df.where(F.col("day") == F.lit(day)), "user", "day"), path)
        if i == 5:
            kept = {f: f.stat().st_mtime_ns for f in tmp_path.glob("days/day=*/part-*.parquet")}
    stored = spark.read.parquet(path)
    assert {f: f.stat().st_mtime_ns for f in kept} == kept
    assert bits.users_of(stored).first()["users"] == len({u for u, *_ in rows})
    again = df.where(F.col("day") == F.lit(START)).limit(3)
    bits.store_days(bits.day_bitmaps(again, "user", "day"), path)
    one = spark.read.parquet(path).where(F.col("day") == F.lit(START))
    assert bits.users_of(one).first()["users"] == again.select("user").distinct().count()


def test_retention_equals_plain_python(spark):
    rows, df = log(spark, 3, 200, 900)
    first = {}
    for u, d, _ in rows:
        first[u] = min(d, first.get(u, d))
    created = bits.day_bitmaps(spark.createDataFrame(list(first.items()), "user long, created date"), "user", "created")
    periods = {"p1": (1, 3), "p2": (3, 8), "p3": (30, 40)}
    found = bits.retention(created, bits.day_bitmaps(df, "user", "day"), periods).collect()
    expected = {}
    for u, born in first.items():
        e = expected.setdefault(born - dt.timedelta(days=born.weekday()), [0, 0, 0, 0])
        e[0] += 1
        for k, (a, b) in enumerate(periods.values(), 1):
            e[k] += any(v == u and a <= (d - born).days < b for v, d, _ in rows)
    assert {r.week: [r["size"], r.p1, r.p2, r.p3] for r in found} == expected
