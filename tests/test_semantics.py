"""Documented numbers and rules of the single operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hexvigil import dims
from hexvigil.operators import activity, indicators, intake, scores, techniques, trust


def obs(spark, rows):
    return spark.createDataFrame(rows, "contribution_id string, technique_id string, observed boolean, tool string, outcome string")


def test_detection_rate_two_of_three(spark):
    df = obs(spark, [("1", "T1", True, "Acme EDR", "detected"), ("2", "T1", True, "acme edr", "detected"), ("3", "T2", True, "ACME EDR", "missed")])
    rates = {r.technique_id: r.rate for r in techniques.detection_rates(techniques.detection_matrix(df)).collect()}
    assert rates[None] == pytest.approx(2 / 3)
    assert rates["T1"] == 1.0 and rates["T2"] == 0.0


def test_detection_rate_eight_of_ten(spark):
    df = obs(spark, [(str(i), "T1", True, "x", "detected" if i < 8 else "missed") for i in range(10)])
    rate = [r.rate for r in techniques.detection_rates(techniques.detection_matrix(df)).collect()]
    assert rate == [0.8, 0.8]


def test_stack_coverage_two_of_three_with_one_gap(spark):
    df = obs(
        spark,
        [
            ("1", "T1", True, "mine", "detected"),
            ("1", "T2", True, "mine", "detected"),
            ("2", "T3", True, "other", "detected"),
            ("3", "T3", True, "mine", "missed"),
        ],
    )
    stacks = spark.createDataFrame([("org", "mine")], "stack_id string, tool string")
    matrix, freq = techniques.detection_matrix(df), techniques.technique_frequency(df)
    row = techniques.stack_coverage(stacks, matrix, freq).first()
    assert (row.total_techniques, row.covered, row.gaps) == (3, 2, 1)
    assert row.coverage_pct == pytest.approx(66.6667, abs=1e-3)
    gap = techniques.stack_gaps(stacks, matrix, freq).collect()
    assert [(g.technique_id, g.frequency, g.caught_by) for g in gap] == [("T3", 2, ["other"])]


def test_unobserved_techniques_count_in_the_total_only(spark):
    df = obs(spark, [("1", "T1", True, "mine", "detected"), ("1", "T9", False, "other", "detected")])
    stacks = spark.createDataFrame([("org", "mine")], "stack_id string, tool string")
    row = techniques.stack_coverage(stacks, techniques.detection_matrix(df), techniques.technique_frequency(df)).first()
    assert (row.total_techniques, row.covered, row.gaps) == (2, 1, 0)


def test_observations_of_nested_maps(spark):
    maps = spark.sql(
        """SELECT 'c' AS contribution_id, array(
        named_struct('technique_id', 'T1', 'observed', true, 'detected_by', array('a', 'b'), 'missed_by', array('c')),
        named_struct('technique_id', 'T2', 'observed', cast(null as boolean), 'detected_by', cast(array() as array<string>), 'missed_by', cast(null as array<string>))) AS techniques"""
    )
    got = sorted((r.technique_id, r.tool or "", r.outcome or "", r.observed) for r in techniques.observations(maps).collect())
    assert got == [("T1", "a", "detected", True), ("T1", "b", "detected", True), ("T1", "c", "missed", True), ("T2", "", "", True)]


def test_weighted_average_of_the_documentation(spark):
    df = spark.createDataFrame([(9.2, 0.8), (2.0, 0.1), (8.8, 0.7)], "score double, weight double").withColumn("g", F.lit(1))
    assert trust.weighted_average(df, ["g"], "score").first().weighted_average == pytest.approx(13.72 / 1.6)


def test_poisoner_bound_of_the_documentation(spark):
    df = spark.createDataFrame([("p", 0.05)] + [(str(i), 0.7) for i in range(10)], "who string, weight double").withColumn("g", F.lit(1))
    row = trust.poisoning_bound(df, ["g"], 10.0).where("who = 'p'").first()
    assert row.max_impact_pct == pytest.approx(0.05 * 10 / 7.05 / 10 * 100)
    mad = spark.createDataFrame([(1, 2.5)], "g int, mad double")
    calm = trust.poisoning_bound(df, ["g"], 10.0, mad=mad).where("who = 'p'").first()
    assert calm.effective_impact_pct == pytest.approx(calm.max_impact_pct * math.exp(-2.0))


def test_trusted_outliers_are_kept_and_untrusted_fade(spark):
    df = spark.createDataFrame([(10.0, 0.9), (10.0, 0.1), (5.5, 0.1)], "v double, w double")
    kept = [r[0] for r in df.select(trust.outlier_weight(F.col("v"), F.lit(5.0), F.lit(1.0), F.col("w"))).collect()]
    assert kept == [0.9, pytest.approx(0.1 * math.exp(-2.5)), 0.1]


def test_min_k_hides_small_groups(spark):
    df = spark.createDataFrame([("a", 2), ("b", 3)], "v string, contribution_count int")
    assert [r.v for r in scores.min_k(df, 3).collect()] == ["b"]
    assert {r.v: r.suppressed for r in scores.min_k(df, 3, report=True).collect()} == {"a": True, "b": False}


def test_two_would_buy_percentages(spark):
    df = spark.createDataFrame([("v", "c", True), ("v", "c", False), ("v", "c", None), ("v", "c", None)], "vendor string, category string, would_buy boolean")
    wide = df.withColumns({c: F.lit(1.0) for c in ("overall_score", "detection_rate", "fp_rate", "deploy_days")})
    assert scores.vendor_aggregate(wide).first().would_buy_pct_all == 25.0
    assert scores.field_aggregate(df, ("vendor",), [], ["would_buy"]).first().would_buy_pct_answered == 50.0


def test_score_above_eight_without_confidence_is_no_contender(spark):
    rows = [("a", 8.5, 9, 5), ("b", 8.5, 5, 3), ("c", 7.5, 1, 1), ("d", 8.5, 3, 1)]
    df = spark.createDataFrame(rows, "vendor_id string, avg_score double, eval_count int, source_count int")
    tiers = {r.vendor_id: r.tier for r in scores.market_map(df).collect()}
    assert tiers == {"a": "leader", "b": "emerging", "c": "contender", "d": "watch"}


def test_source_aliases_and_unknown_sources(spark):
    df = spark.createDataFrame([("v", 10.0, "mitre"), ("v", 4.0, "reddit-community"), ("v", 4.0, "nowhere")], "vendor string, overall_score double, source string")
    w = dims.frame(spark, dims.SOURCE_WEIGHTS, ["source", "weight"])
    aliases = dims.frame(spark, dims.SOURCE_ALIASES, ["alias", "source"])
    assert scores.weighted_score(df, w, aliases=aliases).first().weighted_score == pytest.approx(38 / 5)


def test_retention_skips_the_third_week(spark):
    start = dt.datetime(2024, 1, 3, 10)
    users = spark.createDataFrame([(1, start), (2, start)], "user_id int, created_at timestamp_ntz")
    log = spark.createDataFrame([(1, start + dt.timedelta(days=d)) for d in (8, 22, 30)] + [(2, start + dt.timedelta(days=14))], "user_id int, ts timestamp_ntz")
    row = activity.retention_cohorts(users, log, "2024-02-01 00:00:00").first()
    assert str(row.week) == "2024-01-01"
    assert (row["size"], row.retained_1w, row.retained_2w, row.retained_4w) == (2, 1, 1, 1)


def test_own_rows_do_not_match(spark):
    df = spark.createDataFrame(
        [("a", "h1", "ip"), ("a", "h1", "ip"), ("b", "h1", "ip"), ("b", "h2", "url"), ("c", "h3", "url")],
        "contribution_id string, value_hash string, ioc_type string",
    )
    got = {(r.contribution_id, r.ioc_type): r.matches for r in indicators.bundle_matches(df).collect()}
    assert got == {("a", "ip"): 1, ("b", "ip"): 2}
    done = {r.contribution_id: (r.campaign_match, r.actions) for r in indicators.bundle_analysis(df, indicators.bundle_matches(df)).collect()}
    assert done["c"] == (False, [])
    assert done["a"] == (True, ["critical:block_network_indicators", "high:hunt_related_activity"])


def test_bundle_matches_of_several_types_and_nulls(spark):
    schema = "contribution_id string, value_hash string, ioc_type string"
    rows = [(c, h, t) for c in ("a", "b", None) for h in ("h1", "h2", None) for t in ("ip", "url", None) if (c, h, t) != ("b", "h2", "ip")] + [("a", "h1", "ip")]
    other = [("b", "h1", "ip"), ("z", "h2", "url"), ("z", "h2", "url")]

    def brute(bundles, store):
        out = {}
        for c, h in {r[:2] for r in bundles if r[1]}:
            for t in {r[2] for r in store if r[1] == h}:
                n = sum(1 for x in store if x[1] == h and x[2] == t and not (c is not None and t is not None and x[0] == c))
                if n:
                    m, k = out.get((c, t), (0, 0))
                    out[c, t] = (m + n, k + 1)
        return out

    df, store = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    for got, want in ((indicators.bundle_matches(df), brute(rows, rows)), (indicators.bundle_matches(df, store), brute(rows, other))):
        assert {(r.contribution_id, r.ioc_type): (r.matches, r.matched_hashes) for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = indicators.bundle_matches(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [x for x in plan.splitlines() if " Exchange hashpartitioning(contribution_id" in x and "value_hash" in x]
    assert moved and all("REPARTITION_BY_COL" in x for x in moved)  # no join and no grouping moves them by both once more


def test_match_category_works_both_ways(spark):
    df = spark.createDataFrame([("alert fatigue",), ("fatigue",), ("it is the cost of it",), ("",), (None,), ("zzz",)], "t string")
    got = [r[0] for r in df.select(intake.match_category(F.col("t"), dims.FRICTION_CATEGORIES)).collect()]
    assert got == ["alert_fatigue", "alert_fatigue", "cost", "other", "other", "other"]


def test_context_buckets(spark):
    df = spark.createDataFrame([("Global Bank", "about 1,200", "Head of Security"), (None, "none", None)], "org_name string, employees string, job_title string")
    rows = intake.bucket_context(df).collect()
    assert (rows[0].industry, rows[0].org_size, rows[0].role_tier) == ("financial", "1000-5000", "security-director")
    assert (rows[1].industry, rows[1].org_size, rows[1].role_tier) == (None, None, None)
    assert set(df.columns).isdisjoint(rows[0].asDict())


def test_tool_matching_priorities(spark):
    registry = spark.createDataFrame([("ms-defender", "Microsoft Defender"), ("acme-edr", "Acme EDR Suite")], "vendor_id string, display_name string")
    tools = spark.createDataFrame([("ACME-EDR",), ("MDE",), ("acme edr suite",), ("EDR Su",), ("our falcon box",), ("new acme-edr v2",), ("the acme edr tool",), ("nothing",)], "tool string")
    got = {r.tool: (r.vendor_id, r.rule) for r in intake.match_tools(tools, registry).collect()}
    assert got["ACME-EDR"] == ("acme-edr", 1)
    assert got["MDE"] == ("ms-defender", 2)
    assert got["acme edr suite"] == ("acme-edr", 3)
    assert got["EDR Su"] == ("acme-edr", 4)
    assert got["our falcon box"] == ("crowdstrike", 5)
    assert got["new acme-edr v2"] == ("acme-edr", 6)
    assert got["the acme edr tool"] == ("acme-edr", 7)
    assert got["nothing"] == (None, None)


def test_short_keys_and_cuts_of_the_corpus(spark):
    long_a, long_b = "a" * 90 + " one", "a" * 90 + " two"
    posts = spark.createDataFrame([("v", 1, f"<p>{long_a}</p>"), ("v", 2, long_b), ("v", 3, "short &amp; dropped")], "vendor string, rank int, raw string")
    assert intake.community_corpus(posts, min_chars=50).first().posts == 2
    assert intake.community_corpus(posts).first().posts == 3
    cut = intake.community_corpus(posts, min_chars=50, key_chars=80, post_chars=10).first()
    assert (cut.posts, cut.corpus) == (1, "a" * 10)


def test_attack_patterns_agree_with_their_parts(spark):
    import __spark_entry__ as entry

    q, sf = entry.queries(), "/root/testdata/sf0.001"
    whole = {r.vertical: r for r in q["a22_attack_patterns"](spark, sf).collect()}
    assert set(whole) == set(dims.PRIORITY_TECHNIQUES)
    for r in q["a18_remediation_insights"](spark, sf).collect():
        assert ",".join(whole[r.vertical].most_effective) == r.most_effective
        assert whole[r.vertical].incidents_analyzed == r.incidents_analyzed
    for r in q["a20_chain_coverage"](spark, sf).collect():
        found = {c.chain: c.data_coverage_pct for c in whole[r.vertical].chains}
        assert found[r.chain] == pytest.approx(r.data_coverage_pct, abs=1e-5)
    for r in q["a21_minimum_stack"](spark, sf).collect():
        entry_row = [s for s in whole[r.vertical].minimum_stack if s.take_order == r.take_order][0]
        assert entry_row.kind == r.kind and ",".join(entry_row.top_tools or []) == (r.top_tools or "")
    assert all(len(r.top_techniques) <= 15 for r in whole.values())
