"""What is costly is computed once a row, and what is compared travels small."""

from pyspark.sql import functions as F

from hexvigil.operators import indicators, intake, privacy
from hexvigil.sources import events, intel


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stix_bundles_are_parsed_once(spark):
    text = '{"type": "bundle", "id": "b", "objects": [{"type": "attack-pattern", "id": "p"}, {"type": "threat-actor", "name": "A"}]}'
    docs = spark.range(3).select(F.when(F.col("id") < 2, text).otherwise("no JSON").alias("value"))
    found = intel.stix_techniques(intel.parse_stix(docs))
    assert plan(found).count("from_json") == 1
    assert [(r.bundle_id, r.threat_name, r.technique_id) for r in found.collect()] == [("b", "A", "p")] * 2


def test_webhook_bodies_are_parsed_once_a_branch(spark):
    bodies = F.array(F.lit('{"cef": "CEF:0|V|P|1|1|n|5|src=1.2.3.4"}'), F.lit('{"indicators": [{"type": "url", "value": "u"}]}'), F.lit("x"))
    docs = spark.range(3).select(F.get(bodies, F.col("id").cast("int")).alias("value"))
    found = events.webhook_iocs(events.parse_webhooks(docs))
    assert plan(found).count("from_json") <= 2
    assert sorted((r.ioc_type, r.source) for r in found.collect()) == [("ip", "cef:V:P"), ("url", "indicators")]


def test_reported_outcomes_are_drawn_once(spark):
    entry = F.struct(
        F.lit("T1").alias("technique_id"), F.array(F.lit("a")).alias("detected_by"), F.array(F.lit("b")).alias("missed_by"),
        F.lit("mail x@example.org").alias("notes"),
    )
    maps = spark.range(40).select(F.col("id").alias("contribution_id"), F.when(F.col("id") > 0, F.array(entry)).alias("techniques"))
    out = privacy.anonymize_attack_maps(maps, 1.0, "s").select("contribution_id", F.explode("techniques").alias("t")).select("contribution_id", "t.*")
    assert plan(out).count("sha2(") == 1
    rows = out.collect()
    assert len(rows) == 39 and all(sorted(r.detected_by + r.missed_by) == ["a", "b"] and r.notes == "mail [EMAIL]" for r in rows)
    assert privacy.anonymize_attack_maps(maps).where("techniques is null").count() == 1


def test_overlap_compares_short_digests(spark):
    rows = [(1, "x" * 64), (1, "x" * 64), (1, "y" * 64), (1, None), (2, "x" * 64), (2, None), (3, "z")]
    held = spark.createDataFrame(rows, "org int, value_hash string")
    assert {len(r.value_hash) for r in indicators._held(held).dropna().collect()} == {16}
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "org_a int, org_b int")
    got = indicators.pair_overlap(held, pairs, held.where("org = 2").select("value_hash"))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 3, 2, 1, 1), (1, 3, 3, 1, 0, 0)]


def test_tool_names_are_read_once(spark):
    tools = spark.range(70).select(F.concat(F.lit("Tool "), (F.col("id") % 7).cast("string")).alias("tool"))
    registry = spark.createDataFrame([("tool 3", "Tool Three")], "vendor_id string, display_name string")
    out = intake.match_tools(tools, registry)
    assert "Range" not in plan(out)
    assert sorted((r.tool, r.vendor_id) for r in out.where("rule = 1").collect()) == [("Tool 3", "tool 3")]
    assert out.count() == 7
