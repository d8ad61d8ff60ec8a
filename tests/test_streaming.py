"""Streams in several batches end where the batch operators end."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hexvigil.operators import activity, scores, secure
from hexvigil.plans import streams
from hexvigil.streaming import operators as ops
from hexvigil.streaming.processors import PROVIDER, entry_state, live_matches
from hexvigil.streaming.runner import folder_stream, run_append, run_batches, run_update

START = dt.datetime(2024, 1, 1)


def write_parts(df, path, column, parts):
    for i in range(parts):
        df.where(F.col(column) == i).drop(column).coalesce(1).write.mode("append").parquet(path)


def test_running_scores_equal_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), rnd.choice("xy"), rnd.randint(0, 50) / 5, rnd.choice([True, False, None]), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "vendor string, category string, overall_score double, would_buy boolean, part int")
    write_parts(df, str(tmp_path / "in"), "part", 4)
    sums = run_update(ops.running_vendor_scores(folder_stream(spark, str(tmp_path / "in"), 1)), "scores", ["vendor", "category"])
    got = {(r.vendor, r.category): (round(r.avg_score, 9), r.contribution_count, r.would_buy_pct_all) for r in ops.scores_from_sums(sums).collect()}
    batch = scores.vendor_aggregate(df.withColumns({c: F.lit(1.0) for c in ("detection_rate", "fp_rate", "deploy_days")}))
    assert got == {(r.vendor, r.category): (round(r.avg_score, 9), r.contribution_count, r.would_buy_pct_all) for r in batch.collect()}


def test_category_machine_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    names = [f"name{i}" for i in range(30)]
    rows = []
    for i in range(900):
        name = rnd.choice(names[: 3 + i // 30])
        rows.append((name, f"p{rnd.randint(0, 6)}", START + dt.timedelta(minutes=i), rnd.random() < 0.55, rnd.random() < 0.9, i // 150))
    df = spark.createDataFrame(rows, "name string, proposer string, ts timestamp, proposal boolean, honest boolean, part int")
    full = df.select(
        secure.category_hash(F.col("name"), F.lit("s")).alias("category_hash"), F.lit("tool").alias("category_type"),
        F.when(F.col("honest"), F.col("name")).otherwise("no").alias("plaintext"), F.lit("s").alias("salt"), "proposer", "ts", "proposal", "part",
    )
    write_parts(full, str(tmp_path / "in"), "part", 6)

    def split(d):
        return (
            d.where("proposal").select("category_hash", "category_type", "proposer", "ts"),
            d.where("NOT proposal").select("category_hash", "plaintext", "salt", "proposer", "ts"),
        )

    stream = folder_stream(spark, str(tmp_path / "in"), 1)
    with entry_state(spark):
        states = run_update(ops.category_states(ops.category_events(*split(stream))), "categories", ["category_hash"])
    cols = ["category_hash", "category_type", "supporters", "status", "reveal_votes", "revealed_name"]
    got = sorted(tuple(r[c] for c in cols) for r in states.collect())
    batch = sorted(tuple(r[c] for c in cols) for r in secure.blind_categories(*split(full)).collect())
    assert len({g[3] for g in got}) >= 2
    assert [tuple(map(str, g)) for g in got] == [tuple(map(str, b)) for b in batch]


def category_rows(spark, rows):
    """(name, proposer, minute, proposal, part) as category events with their part."""
    df = spark.createDataFrame([(n, p, START + dt.timedelta(minutes=m), k, i) for n, p, m, k, i in rows], "name string, proposer string, ts timestamp, proposal boolean, part int")
    return df.select(
        secure.category_hash(F.col("name"), F.lit("s")).alias("category_hash"), F.when(F.col("proposal"), "tool").alias("category_type"),
        F.when(~F.col("proposal"), F.col("name")).alias("name"), "proposer", "ts", "part",
    )


def test_any_text_names_a_proposer(spark, tmp_path):
    """A proposer with a line feed is one proposer, the empty text is one too."""
    events = category_rows(spark, [("a", "x\ny", 0, True, 0), ("a", "x", 1, True, 1), ("a", "", 2, True, 1), ("a", "x\ny", 3, False, 2), ("a", "y", 4, False, 2)])
    write_parts(events, str(tmp_path / "in"), "part", 3)
    with entry_state(spark):
        (row,) = run_update(ops.category_states(folder_stream(spark, str(tmp_path / "in"), 1)), "categories", ["category_hash"]).collect()
    assert (row.supporters, row.status, row.reveal_votes) == (3, "threshold_met", 1)
    assert spark.conf.get(PROVIDER, None) != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_categories_without_news_expire(spark, tmp_path):
    """Hash a gets no news for an hour of event time and expires, b stays, c is revealed in time and stays revealed."""
    rows = [("a", "p", 0, True, 0), ("b", "p", 0, True, 0), *[("c", f"p{i}", i, True, 0) for i in range(3)], ("c", "p0", 5, False, 0), ("c", "p1", 5, False, 0)]
    rows += [("b", "q", 50, True, 1), ("d", "p", 100, True, 2), ("b", "r", 101, True, 3), ("a", "q", 102, True, 3), ("e", "p", 140, True, 4)]
    write_parts(category_rows(spark, rows), str(tmp_path / "in"), "part", 5)
    stream = folder_stream(spark, str(tmp_path / "in"), 1).withWatermark("ts", "1 minute")
    with entry_state(spark):
        found = run_update(ops.category_states(stream, expire_ms=3_600_000), "categories", ["category_hash"]).collect()
    name = {r.category_hash: n for n in "abcde" for r in spark.range(1).select(secure.category_hash(F.lit(n), F.lit("s")).alias("category_hash")).collect()}
    assert {name[r.category_hash]: (r.status, r.supporters) for r in found} == {
        "a": ("expired", 1), "b": ("threshold_met", 3), "c": ("revealed", 3), "d": ("pending", 1), "e": ("pending", 1),
    }


def test_ledger_looks_up_only_its_batch(spark, tmp_path):
    """Repeats are dropped however late they come, rows of the given ledger too; state rows updated follow the batch."""
    rows = [("a", 0), ("b", 0), ("b", 0), ("known", 1), ("a", 1), ("c", 1), ("d", 2), ("b", 3), ("a", 3), ("known", 3)]
    write_parts(spark.createDataFrame(rows, "text string, part int"), str(tmp_path / "in"), "part", 4)
    ledger = spark.createDataFrame([("known",), ("known",), ("other",)], "text string").select(F.sha2("text", 256).alias("content_hash"))
    items = ops.hashed_items(folder_stream(spark, str(tmp_path / "in"), 1), "text")
    with entry_state(spark):
        query = (
            ops.new_to_ledger(items, ledger).writeStream.format("memory").queryName("ledger_batches").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    assert sorted(r.text for r in spark.table("ledger_batches").collect()) == ["a", "b", "c", "d"]
    updated = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.numInputRows]
    assert updated[1:] == [1, 1, 0]


def test_live_alerts_match_earlier_files(spark, tmp_path):
    """Bundles match those of earlier files and earlier ones of their own file, not themselves."""
    rnd = random.Random(5)
    rows = []
    for c in range(60):
        for _ in range(rnd.randint(1, 6)):
            rows.append((c, rnd.choice(["hot", "hot", *"abcdefgh"]), rnd.choice(["ip", "url", "hash-md5"]), START + dt.timedelta(days=c // 4), c // 15))
    df = spark.createDataFrame(rows, "contribution_id long, value_hash string, ioc_type string, received_at timestamp, part int")
    write_parts(df, str(tmp_path / "in"), "part", 4)
    got = run_append(ops.live_match_alerts(folder_stream(spark, str(tmp_path / "in"), 1)), "alerts")
    expected = sorted((c, h, k, n) for c, h, k, *_ in rows if (n := sum(h2 == h and c2 < c for c2, h2, *_ in rows)))
    assert sorted((r.contribution_id, r.value_hash, r.ioc_type, r.known_rows) for r in got.collect()) == expected
    assert {tuple(r.actions) for r in got.where("ioc_type = 'ip'").select("actions").collect()} == {
        ("critical:block_network_indicators", "high:hunt_related_activity")
    }


def test_daily_counts_and_late_rows(spark, tmp_path):
    days = [(START + dt.timedelta(hours=6 * i), i // 8) for i in range(40)]
    late = [(START + dt.timedelta(hours=1), 5)]
    df = spark.createDataFrame(days + late, "ts timestamp, part int")
    write_parts(df, str(tmp_path / "in"), "part", 6)
    stream = folder_stream(spark, str(tmp_path / "in"), 1)
    got = {r.day: r["count"] for r in run_update(ops.live_daily_counts(stream, "ts", lateness="1 day"), "daily", ["day"]).collect()}
    on_time = spark.createDataFrame(days, "ts timestamp, part int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch = {r.day: r["count"] for r in activity.daily_counts(on_time, "ts", "2024-03-01 00:00:00", 90).collect()}
    assert got == batch


def test_repeats_within_the_horizon_are_dropped(spark, tmp_path):
    rows = [("a", 0, 0), ("b", 1, 0), ("a", 2, 1), ("c", 3, 1), ("b", 4, 2)]
    df = spark.createDataFrame([(t, START + dt.timedelta(hours=h), p) for t, h, p in rows], "text string, ts timestamp, part int")
    write_parts(df, str(tmp_path / "in"), "part", 3)
    out = run_append(ops.fresh_items(folder_stream(spark, str(tmp_path / "in"), 1), "text", "ts").select("text"), "fresh")
    assert sorted(r.text for r in out.collect()) == ["a", "b", "c"]


def test_requests_over_limit(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else "cold", START + dt.timedelta(seconds=rnd.uniform(0, 600)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int")
    got = {r.i: r.recent for r in ops.requests_over_limit(df, "k", "ts", 20, 60).collect()}
    expected = {}
    for k, t, i in rows:
        n = sum(1 for k2, t2, _ in rows if k2 == k and dt.timedelta(0) <= t - t2 < dt.timedelta(seconds=60))
        if n > 20:
            expected[i] = n
    assert got == expected


def test_sessions(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    gap, late = dt.timedelta(hours=6), dt.timedelta(hours=1)
    log = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts").collect():
        log.setdefault(r.user_id, []).append(r.ts)
    newest = max(max(v) for v in log.values())
    expected = set()
    for user, times in log.items():
        times.sort()
        run = [times[0]]
        for t in times[1:] + [None]:
            if t is not None and t < run[-1] + gap:
                run.append(t)
                continue
            expected.add((user, f"{run[0]:%F %T}", f"{run[-1] + gap:%F %T}", len(run), run[-1] + gap > newest - late))
            run = [t]
    rows = entry.queries()["s06_activity_sessions"](spark, sf).collect()
    assert {(r.user_id, r.session_start, r.session_end, r.requests, r.still_open) for r in rows} == expected
    assert len(rows) == len(expected) and any(r.still_open for r in rows)


def test_live_alerts_count_by_hash_inside_a_bucket(spark, tmp_path):
    """Hashes that share a state entry, null among them, are counted apart; rows without a date count but are not judged."""
    day = START
    rows = [(1, "a", "ip", day, 0), (2, "b", "ip", day, 0), (3, None, "ip", day, 0), (4, "a", "ip", None, 0), (5, "a", "ip", day, 1),
            (6, None, "ip", day, 1), (7, "c", "ip", day, 1), (8, "a", "ip", None, 1)]
    df = spark.createDataFrame(rows, "contribution_id long, value_hash string, ioc_type string, received_at timestamp, part int")
    write_parts(df, str(tmp_path / "in"), "part", 2)
    got = run_append(live_matches(folder_stream(spark, str(tmp_path / "in"), 1), buckets=1), "alerts")
    assert sorted((r.contribution_id, r.value_hash, r.known_rows) for r in got.collect()) == [(5, "a", 2), (6, None, 1)]


def test_live_alerts_write_their_files_in_parallel(spark, tmp_path, monkeypatch):
    """No batch passes through one task; what arrives together is one batch however many files it takes."""
    monkeypatch.setattr(streams, "scratch_path", lambda _, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        streams.live_alerts(spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(list(tmp_path.glob("bundle-files/part-*"))) > 4
    assert len(list(tmp_path.glob("live-alerts/state/commits/[0-9]*"))) == 4


def test_batches_are_cut_into_files(spark, tmp_path, monkeypatch):
    """A quarter of a table is no single task's to write; batches stay four."""
    monkeypatch.setattr(streams, "scratch_path", lambda _, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        stream = streams.in_batches(spark, spark.range(1000), "numbers")
        sizes = []
        run_batches(stream, "numbers-out", lambda batch, _: sizes.append(batch.count()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(list((tmp_path / "numbers-files").glob("part-*"))) == 12
    assert len(sizes) == 4 and sum(sizes) == 1000


def test_alerts_on_a_store_with_nulls_and_repeats(spark, tmp_path):
    digest = "ab" * 32
    schema = "contribution_id long, value_hash string, ioc_type string"
    rows = [(1, digest, "ip"), (1, digest, "ip"), (2, "plain", "url"), (None, digest, "email"), (3, None, "ip"), (4, "new", "ip")]
    held = [(1, digest), (1, digest), (2, "plain"), (5, digest), (None, digest), (None, None), (None, "plain")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    store = spark.createDataFrame(held, "contribution_id int, value_hash string")
    got = run_append(ops.match_alerts(folder_stream(spark, str(tmp_path / "in")), store), "alerts")
    assert sorted(((r.contribution_id, r.value_hash, r.known_rows) for r in got.collect()), key=str) == sorted(
        [(1, digest, 2), (1, digest, 2), (2, "plain", 1), (None, digest, 4)], key=str
    )
    kept = [f for f in ops.match_alerts(spark.createDataFrame(rows, schema), store).inputFiles() if "known-own" in f]
    assert kept and {len(r["__pair"]) for r in spark.read.parquet(*kept).collect()} == {16}
