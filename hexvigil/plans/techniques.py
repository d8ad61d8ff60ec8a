"""Technique intelligence over observed attacks, stacks and remediation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexvigil import bridge, dims
from hexvigil.operators import techniques as tq
from hexvigil.plans.registry import R, query, r6, rounded

MATRIX_SQL = """SELECT technique_id, lower(replace(tool, ' ', '-')) AS vendor, count(*) FILTER (outcome = 'detected') AS detected,
 count(*) FILTER (outcome = 'missed') AS missed FROM technique_obs WHERE outcome IS NOT NULL GROUP BY 1, 2"""
FREQ_SQL = """SELECT technique_id, count(*) AS count, 100.0 * count(*) / (SELECT count(DISTINCT contribution_id) FROM technique_obs) AS pct
 FROM technique_obs WHERE observed GROUP BY technique_id"""


def matrix(spark, sf):
    return tq.detection_matrix(bridge.technique_obs(spark, sf, "technique_id", "tool", "outcome"))


def frequency(spark, sf):
    return tq.technique_frequency(bridge.technique_obs(spark, sf, "contribution_id", "technique_id", "observed"))


def baselines(spark):
    return dims.frame(spark, dims.INDUSTRY_BASELINES, dims.BASELINE_COLUMNS)


def steps(spark):
    return dims.frame(spark, dims.chain_steps(), ["vertical", "chain", "step", "technique_id"])


def priority(spark):
    return dims.frame(spark, dims.priority_rows(), ["vertical", "rank", "technique_id"])


STEPS_SQL = dims.values(dims.chain_steps(), ["vertical", "chain", "step", "technique_id"])
PRIORITY_SQL = dims.values(dims.priority_rows(), ["vertical", "rank", "technique_id"])
BASE_SQL = dims.values(dims.INDUSTRY_BASELINES, dims.BASELINE_COLUMNS)
RATES_SQL = dims.values(dims.tactic_rate_rows(), ["tactic", "category", "rate"])


@query(
    "a10_technique_frequency",
    f"SELECT technique_id, count, {R('pct')} AS pct FROM ({FREQ_SQL}) ORDER BY count DESC, technique_id LIMIT 50",
    ("technique_obs",),
)
def technique_frequency(spark, sf):
    obs = bridge.technique_obs(spark, sf, "contribution_id", "technique_id", "observed")
    return rounded(tq.technique_frequency(obs, 50), "pct")


@query(
    "a11_technique_frequency_named",
    f"""WITH f AS (SELECT technique_id, count(*) AS count, 100.0 * count(*) / (SELECT count(*) FROM technique_obs) AS pct,
 substr(min(concat(strftime(ts, '%Y-%m-%d'), tactic)), 11) AS tactic FROM technique_obs GROUP BY technique_id)
 SELECT f.technique_id, count, {R('pct')} AS pct, coalesce(m.name, f.technique_id) AS name, coalesce(f.tactic, m.tactic, 'unknown') AS tactic
 FROM f LEFT JOIN technique_map m ON m.technique_id = f.technique_id""",
    ("technique_obs", "technique_map"),
)
def technique_frequency_named(spark, sf):
    obs = bridge.technique_obs(spark, sf, "technique_id", "tactic", "ts")
    return rounded(tq.technique_frequency_named(obs, bridge.technique_map(spark)), "pct")


@query("a12_detection_matrix", MATRIX_SQL, ("technique_obs",))
def detection_matrix(spark, sf):
    return matrix(spark, sf)


@query(
    "a13_detection_rates",
    f"""SELECT vendor, technique_id, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(detected + missed) AS BIGINT) AS evaluated,
 {R('sum(detected) / sum(detected + missed)')} AS rate FROM ({MATRIX_SQL}) GROUP BY GROUPING SETS ((vendor, technique_id), (vendor))""",
    ("technique_obs",),
)
def detection_rates(spark, sf):
    return rounded(tq.detection_rates(matrix(spark, sf)), "rate")


@query(
    "a13_compare_detection",
    f"""WITH o AS (SELECT vendor, sum(detected) / sum(detected + missed) AS rate FROM ({MATRIX_SQL}) GROUP BY vendor),
 p AS (SELECT lower(a.s_name) AS vendor_a, lower(b.s_name) AS vendor_b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey = a.s_suppkey + 25)
 SELECT vendor_a, vendor_b, {R('a.rate')} AS rate_a, {R('b.rate')} AS rate_b FROM p LEFT JOIN o a ON a.vendor = vendor_a LEFT JOIN o b ON b.vendor = vendor_b""",
    ("technique_obs",),
)
def compare_detection(spark, sf):
    s = bridge.table(spark, sf, "supplier")
    a = s.select(F.lower("s_name").alias("vendor_a"), "s_nationkey", (F.col("s_suppkey") + 25).alias("k"))
    b = s.select(F.lower("s_name").alias("vendor_b"), "s_nationkey", F.col("s_suppkey").alias("k"))
    pairs = a.join(b, ["s_nationkey", "k"]).select("vendor_a", "vendor_b")
    return rounded(tq.compare_detection(matrix(spark, sf), pairs), "rate_a", "rate_b")


@query("j04_vendor_gaps", f"SELECT vendor, technique_id FROM ({MATRIX_SQL}) WHERE missed > 0", ("technique_obs",))
def vendor_gaps(spark, sf):
    return tq.vendor_gaps(matrix(spark, sf))


@query(
    "j03_missed_by_tools",
    """SELECT technique_id, contribution_id, tool FROM technique_obs WHERE outcome = 'missed'
 AND lower(tool) IN ('supplier#000000001', 'supplier#000000004', 'supplier#000000007')""",
    ("technique_obs",),
)
def missed_by_tools(spark, sf):
    nested = bridge.technique_obs(spark, sf, "contribution_id", "technique_id", "tool", "outcome").withColumn(
        "missed_by", F.when(F.col("outcome") == "missed", F.array("tool")).otherwise(F.array().cast("array<string>"))
    )
    tools = ["SUPPLIER#000000001", "Supplier#000000004", "supplier#000000007"]
    return tq.missed_by_tools(nested, tools).select(
        "technique_id", "contribution_id", F.element_at("missed_by", 1).alias("tool")
    )


@query(
    "j03_missed_by_stack",
    """WITH m AS (SELECT o_custkey AS org, lower(tool) AS tool, technique_id FROM technique_obs JOIN orders ON o_orderkey = contribution_id WHERE outcome = 'missed')
 SELECT stack_id, technique_id, count(*) AS missed, count(DISTINCT m.tool) AS tools_missing FROM stack s JOIN m ON m.tool = lower(s.tool) AND m.org <> s.stack_id
 GROUP BY stack_id, technique_id""",
    ("technique_obs", "stack"),
)
def missed_by_stack(spark, sf):
    obs = bridge.technique_obs(spark, sf, "org", "tool", "technique_id", "outcome")
    return tq.missed_by_stack(bridge.stack(spark, sf), obs)


COVER_SQL = f"""m AS ({MATRIX_SQL}), f AS ({FREQ_SQL}),
 c AS (SELECT DISTINCT stack_id, technique_id FROM stack JOIN m ON m.vendor = lower(tool) WHERE detected > 0),
 k AS (SELECT count(*) AS total FROM (SELECT technique_id FROM m UNION SELECT technique_id FROM f))"""


@query(
    "a14_stack_coverage",
    f"""WITH {COVER_SQL}, p AS (SELECT stack_id, count(*) AS covered, count(*) FILTER (technique_id IN (SELECT technique_id FROM f)) AS covered_observed FROM c GROUP BY stack_id)
 SELECT s.stack_id, total AS total_techniques, coalesce(covered, 0) AS covered, (SELECT count(*) FROM f) - coalesce(covered_observed, 0) AS gaps,
 {R('100.0 * coalesce(covered, 0) / total')} AS coverage_pct FROM (SELECT DISTINCT stack_id FROM stack) s CROSS JOIN k LEFT JOIN p ON p.stack_id = s.stack_id""",
    ("technique_obs", "stack"),
)
def stack_coverage(spark, sf):
    out = tq.stack_coverage(bridge.stack(spark, sf), matrix(spark, sf), frequency(spark, sf))
    return rounded(out, "coverage_pct")


@query(
    "a14_stack_gaps",
    f"""WITH {COVER_SQL}, s AS (SELECT DISTINCT stack_id FROM stack),
 g AS (SELECT stack_id, f.technique_id, f.count AS frequency, row_number() OVER (PARTITION BY stack_id ORDER BY f.count DESC, f.technique_id) AS gap_rank
  FROM s CROSS JOIN f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.stack_id = s.stack_id AND c.technique_id = f.technique_id)),
 t AS (SELECT * FROM g WHERE gap_rank <= 20),
 b AS (SELECT t.stack_id, t.technique_id, string_agg(m.vendor, ',' ORDER BY m.vendor) AS caught_by FROM t JOIN m ON m.technique_id = t.technique_id AND m.detected > 0
  WHERE NOT EXISTS (SELECT 1 FROM stack x WHERE x.stack_id = t.stack_id AND lower(x.tool) = m.vendor) GROUP BY 1, 2)
 SELECT t.stack_id, CAST(gap_rank AS INTEGER) AS gap_rank, t.technique_id, frequency, coalesce(caught_by, '') AS caught_by FROM t LEFT JOIN b ON b.stack_id = t.stack_id AND b.technique_id = t.technique_id""",
    ("technique_obs", "stack"),
)
def stack_gaps(spark, sf):
    out = tq.stack_gaps(bridge.stack(spark, sf), matrix(spark, sf), frequency(spark, sf))
    return out.withColumn("caught_by", F.array_join("caught_by", ","))


EFFECT_SQL = f"""SELECT vendor AS tool, CAST(sum(detected) AS BIGINT) AS detections, CAST(sum(missed) AS BIGINT) AS misses,
 CAST(sum(detected + missed) AS BIGINT) AS total_observations,
 100.0 * sum(detected) / sum(detected + missed) AS detection_pct, string_agg(CASE WHEN missed > 0 THEN technique_id END, ',' ORDER BY technique_id) AS missed_techniques,
 any_value(kind) AS kind, CASE WHEN any_value(kind) IN ('edr', 'ndr') THEN 'minutes-hours' WHEN any_value(kind) IN ('iam', 'email') THEN 'immediate' ELSE 'hours' END AS avg_detect_time
 FROM ({MATRIX_SQL}) JOIN registry ON lower(vendor_id) = vendor GROUP BY vendor"""


def effectiveness(spark, sf):
    return tq.tool_effectiveness(
        bridge.technique_obs(spark, sf, "technique_id", "tool", "outcome"), bridge.registry(spark, sf)
    )


@query(
    "a15_tool_effectiveness",
    f"""SELECT tool, detections, misses, total_observations, {R('detection_pct')} AS detection_pct, coalesce(missed_techniques, '') AS missed_techniques, kind, avg_detect_time FROM ({EFFECT_SQL})""",
    ("technique_obs", "registry"),
)
def tool_effectiveness(spark, sf):
    out = effectiveness(spark, sf).withColumn("missed_techniques", F.array_join("missed_techniques", ","))
    return rounded(out, "detection_pct")


@query(
    "a16_remediation_histogram",
    """SELECT category, effectiveness, count(*) AS n, CAST(GROUPING(category, effectiveness) AS INTEGER) AS level FROM remediation GROUP BY CUBE (category, effectiveness)""",
    ("remediation",),
)
def remediation_histogram(spark, sf):
    return tq.remediation_histogram(bridge.remediation(spark, sf).select("category", "effectiveness"))


@query(
    "a17_remediation_success",
    f"""SELECT r.category, total_actions, stopped, {R('success_rate')} AS success_rate, nist_phase FROM (SELECT category, count(*) AS total_actions, count(*) FILTER (effectiveness = 'stopped_attack') AS stopped,
 count(*) FILTER (effectiveness IN ('stopped_attack', 'slowed_attack')) / count(*) AS success_rate FROM remediation GROUP BY category ORDER BY 4 DESC, 1 LIMIT 5) r
 LEFT JOIN {dims.values(dims.REMEDIATION_PHASES, ['category', 'nist_phase'])} g ON g.category = r.category""",
    ("remediation",),
)
def remediation_success(spark, sf):
    guidance = dims.frame(spark, dims.REMEDIATION_PHASES, ["category", "nist_phase"])
    rem = bridge.remediation(spark, sf).select("category", "effectiveness")
    return rounded(tq.remediation_success(rem, guidance), "success_rate")


@query(
    "j05_remediation_for_threat",
    """SELECT i.contribution_id, i.severity AS threat_name, r.category, r.effectiveness, r.action FROM incidents i JOIN remediation r ON r.contribution_id = i.contribution_id
 WHERE contains(lower(i.severity), 'urgent') OR i.contribution_id IN (SELECT contribution_id FROM technique_obs WHERE technique_id IN ('T1003', 'T1190'))""",
    ("incidents", "remediation", "technique_obs"),
)
def remediation_for_threat(spark, sf):
    inc = bridge.incidents(spark, sf, "contribution_id", "severity").withColumnRenamed("severity", "threat_name")
    entries = bridge.technique_obs(spark, sf, "contribution_id", "technique_id")
    out = tq.remediation_for_threat(inc, entries, bridge.remediation(spark, sf), "Urgent", ["T1003", "T1190"])
    return out.select("contribution_id", "threat_name", "category", "effectiveness", "action")


VERT_INC_SQL = "SELECT i.*, v.vertical FROM incidents i JOIN org_vertical v ON v.org = i.org"


def vertical_incidents(spark, sf):
    return bridge.incidents(spark, sf, "contribution_id", "org", "ransom_paid").join(
        bridge.org_vertical(spark, sf), "org"
    )


@query(
    "a18_remediation_insights",
    f"""WITH i AS ({VERT_INC_SQL}), e AS (SELECT vertical, action, min(ts) AS first_ts FROM remediation r JOIN i ON i.contribution_id = r.contribution_id
  WHERE effectiveness IN ('stopped_attack', 'slowed_attack') GROUP BY 1, 2),
 a AS (SELECT vertical, string_agg(action, ',' ORDER BY rn) AS most_effective FROM (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY first_ts, action) AS rn FROM e) WHERE rn <= 6 GROUP BY 1)
 SELECT p.vertical, n AS incidents_analyzed, {R('CASE WHEN n >= 3 THEN 100.0 * paid / n ELSE coalesce(ransom_paid_pct, 12.0) END')} AS ransom_paid_pct,
 avg_recovery_weeks, data_exfiltrated_pct, most_effective FROM (SELECT vertical, count(*) AS n, count(*) FILTER (ransom_paid) AS paid FROM i GROUP BY 1) p
 LEFT JOIN {BASE_SQL} b ON b.vertical = p.vertical LEFT JOIN a ON a.vertical = p.vertical""",
    ("incidents", "org_vertical", "remediation"),
)
def remediation_insights(spark, sf):
    out = tq.remediation_insights(vertical_incidents(spark, sf), bridge.remediation(spark, sf), baselines(spark))
    return rounded(out.withColumn("most_effective", F.array_join("most_effective", ",")), "ransom_paid_pct")


def vertical_entries(spark, sf, *cols):
    return bridge.technique_obs(spark, sf, "org", *cols).join(bridge.org_vertical(spark, sf), "org")


# Techniques on PROMO parts stand for the initial-access tactic.
IA_SQL = """SELECT v.vertical, technique_id, CASE WHEN tactic = 'PROMO' THEN 'initial-access' ELSE tactic END AS tactic
 FROM technique_obs JOIN orders ON o_orderkey = contribution_id JOIN org_vertical v ON v.org = o_custkey"""


@query(
    "a19_initial_access_mix",
    f"""WITH e AS ({IA_SQL}), c AS (SELECT vertical, count(*) AS t, count(*) FILTER (technique_id LIKE 'T1566%') AS sp, count(*) FILTER (technique_id = 'T1190') AS vp,
  count(*) FILTER (technique_id IN ('T1133', 'T1021.001')) AS rd, count(*) FILTER (technique_id LIKE 'T1195%') AS sc, count(*) FILTER (technique_id LIKE 'T1078%') AS va
  FROM e WHERE tactic = 'initial-access' GROUP BY 1)
 SELECT c.vertical, t AS total_ia, {R('CASE WHEN t >= 5 THEN 100.0 * sp / t ELSE spearphishing_pct END')} AS spearphishing_pct, {R('CASE WHEN t >= 5 THEN 100.0 * vp / t ELSE vpn_exploit_pct END')} AS vpn_exploit_pct,
 {R('CASE WHEN t >= 5 THEN 100.0 * rd / t ELSE rdp_exposed_pct END')} AS rdp_exposed_pct,
 {R("CASE WHEN sc > 0 OR c.vertical = 'government' THEN CASE WHEN t >= 5 THEN 100.0 * sc / t ELSE 23 END END")} AS supply_chain_pct,
 {R("CASE WHEN va > 0 OR c.vertical = 'financial' THEN CASE WHEN t >= 5 THEN 100.0 * va / t ELSE 34 END END")} AS valid_accounts_pct
 FROM c JOIN {BASE_SQL} b ON b.vertical = c.vertical""",
    ("technique_obs", "org_vertical"),
)
def initial_access_mix(spark, sf):
    e = vertical_entries(spark, sf, "technique_id", "tactic").withColumn(
        "tactic", F.when(F.col("tactic") == "PROMO", "initial-access").otherwise(F.col("tactic"))
    )
    out = tq.initial_access_mix(e, baselines(spark))
    return rounded(out, *[c for c in out.columns if c.endswith("_pct")])


@query(
    "a20_chain_coverage",
    f"""WITH s AS (SELECT DISTINCT vertical, technique_id FROM ({IA_SQL})), c AS {STEPS_SQL}
 SELECT c.vertical, chain, count(*) AS steps, count(s.technique_id) AS observed_steps, {R('100.0 * count(s.technique_id) / count(*)')} AS data_coverage_pct
 FROM c LEFT JOIN s ON s.vertical = c.vertical AND s.technique_id = c.technique_id GROUP BY 1, 2""",
    ("technique_obs", "org_vertical"),
)
def chain_coverage(spark, sf):
    out = tq.chain_coverage(steps(spark), vertical_entries(spark, sf, "technique_id"))
    return rounded(out, "data_coverage_pct")


LOOKUP = """LEFT JOIN technique_map e ON e.technique_id = x.technique_id
 LEFT JOIN technique_map pa ON e.technique_id IS NULL AND pa.technique_id = split_part(x.technique_id, '.', 1)"""


@query(
    "j06_technique_lookup",
    f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('T', CAST(1000 + o_custkey % 300 AS VARCHAR), '.001') ELSE concat('T', CAST(1000 + o_custkey % 300 AS VARCHAR)) END AS technique_id FROM orders)
 SELECT o_orderkey, x.technique_id, coalesce(e.name, pa.name) AS name, coalesce(e.tactic, pa.tactic) AS tactic, coalesce(e.technique_id, pa.technique_id) AS matched_id FROM x {LOOKUP}""",
    ("technique_map",),
)
def technique_lookup(spark, sf):
    number = F.concat(F.lit("T"), (1000 + F.col("o_custkey") % 300).cast("string"))
    rows = bridge.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(number, F.lit(".001"))).otherwise(number).alias("technique_id"),
    )
    return tq.technique_lookup(rows, bridge.technique_map(spark), ["name", "tactic"])


@query(
    "a21_minimum_stack",
    f"""WITH p AS {PRIORITY_SQL}, k AS (SELECT DISTINCT vertical, technique_id, unnest(categories) AS kind FROM
  (SELECT x.vertical, x.technique_id, coalesce(e.categories, pa.categories) AS categories FROM p x {LOOKUP})),
 r AS (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY techniques DESC, kind) AS take_order FROM (SELECT vertical, kind, count(*) AS techniques FROM k GROUP BY 1, 2)),
 c AS (SELECT a.vertical, a.take_order, count(DISTINCT k.technique_id) AS covered FROM r a JOIN r b ON b.vertical = a.vertical AND b.take_order <= a.take_order
  JOIN k ON k.vertical = b.vertical AND k.kind = b.kind GROUP BY 1, 2),
 n AS (SELECT r.vertical, CAST(r.take_order AS INTEGER) AS take_order, r.kind, r.techniques, c.covered, coalesce(lag(c.covered) OVER (PARTITION BY r.vertical ORDER BY r.take_order), 0) AS before FROM r JOIN c ON c.vertical = r.vertical AND c.take_order = r.take_order),
 ef AS ({EFFECT_SQL}), bt AS (SELECT kind, string_agg(tool, ',' ORDER BY place) AS top_tools FROM (SELECT kind, tool, row_number() OVER (PARTITION BY kind ORDER BY {R('detection_pct')} DESC, tool) AS place FROM ef) WHERE place <= 3 GROUP BY kind)
 SELECT vertical, take_order, n.kind, techniques, covered, {R('100.0 * covered / 8')} AS covered_pct, top_tools FROM n LEFT JOIN bt ON bt.kind = n.kind WHERE before / 8.0 < 0.8""",
    ("technique_map", "technique_obs", "registry"),
)
def minimum_stack(spark, sf):
    best = (
        tq.best_tools_per_kind(rounded(effectiveness(spark, sf), "detection_pct"))
        .groupBy("kind")
        .agg(F.sort_array(F.collect_list(F.struct("place", "tool"))).alias("t"))
        .select("kind", F.array_join(F.transform("t", lambda x: x.getField("tool")), ",").alias("top_tools"))
    )
    out = tq.minimum_stack(priority(spark), bridge.technique_map(spark)).join(best, "kind", "left")
    return rounded(out, "covered_pct")


@query("a22_attack_patterns")
def attack_patterns(spark, sf):
    e = vertical_entries(spark, sf, "technique_id", "tactic", "ts").withColumn(
        "tactic", F.when(F.col("tactic") == "PROMO", "initial-access").otherwise(F.col("tactic"))
    )
    return tq.attack_patterns(
        e,
        bridge.technique_obs(spark, sf, "technique_id", "tool", "outcome"),
        vertical_incidents(spark, sf),
        bridge.remediation(spark, sf),
        bridge.registry(spark, sf),
        bridge.technique_map(spark),
        baselines(spark),
        steps(spark),
        priority(spark),
    )


def _position_tables(spark, sf):
    t = bridge.technique_map(spark).select(
        "technique_id", (F.substring("technique_id", 2, 4).cast("int") - 1000).alias("t_idx")
    )
    v = bridge.table(spark, sf, "supplier").select(
        F.lower("s_name").alias("vendor"), F.col("s_suppkey").alias("v_idx")
    )
    return t, v


@query(
    "a35_histogram_vector",
    """SELECT CAST((CAST(substr(technique_id, 2) AS INTEGER) - 1000) * (SELECT count(*) FROM supplier) * 2 + s_suppkey * 2 + CASE WHEN outcome = 'detected' THEN 1 ELSE 0 END AS BIGINT) AS position,
 count(DISTINCT contribution_id) AS n FROM technique_obs JOIN supplier ON s_name = tool WHERE outcome IS NOT NULL GROUP BY 1""",
    ("technique_obs",),
)
def histogram_vector(spark, sf):
    t, v = _position_tables(spark, sf)
    obs = bridge.technique_obs(spark, sf, "contribution_id", "technique_id", "tool", "outcome")
    return tq.histogram_sum(tq.histogram_positions(obs, t, v))


@query(
    "a35_histogram_decoded",
    """SELECT technique_id, lower(tool) AS vendor, count(DISTINCT CASE WHEN outcome = 'detected' THEN contribution_id END) AS detected,
 count(DISTINCT CASE WHEN outcome = 'missed' THEN contribution_id END) AS missed FROM technique_obs WHERE outcome IS NOT NULL GROUP BY 1, 2""",
    ("technique_obs",),
)
def histogram_decoded(spark, sf):
    t, v = _position_tables(spark, sf)
    return tq.histogram_decode(histogram_vector(spark, sf), t, v)


GAP_SQL = f"""WITH p AS {PRIORITY_SQL}, lk AS (SELECT x.vertical, x.rank, x.technique_id, coalesce(e.categories, pa.categories, []) AS categories,
  list_transform(coalesce(e.primary_vendors, pa.primary_vendors, []), lambda v: lower(v)) AS pv FROM p x {LOOKUP}),
 ow AS (SELECT stack_id, list(DISTINCT lower(tool)) AS tools FROM stack GROUP BY 1),
 g AS (SELECT ow.stack_id, ov.vertical, lk.rank, lk.technique_id, list_sort(list_filter(pv, lambda v: list_contains(tools, v))) AS ct, categories, list_filter(pv, lambda v: NOT list_contains(tools, v)) AS sv
  FROM ow JOIN org_vertical ov ON ov.org = ow.stack_id JOIN lk ON lk.vertical = ov.vertical),
 gr AS (SELECT stack_id, vertical, rank, technique_id, len(ct) > 0 AS covered, array_to_string(ct, ',') AS covering_tools,
  CASE WHEN len(ct) = 0 THEN array_to_string(categories, ',') END AS suggested_categories, CASE WHEN len(ct) = 0 THEN array_to_string(sv, ',') END AS suggested_vendors,
  CASE WHEN len(ct) = 0 THEN CASE WHEN rank < 2 THEN 'critical' WHEN rank < 5 THEN 'high' ELSE 'medium' END END AS priority FROM g)"""


def gap_rows(spark, sf):
    return tq.market_gap(
        bridge.stack(spark, sf), bridge.org_vertical(spark, sf), priority(spark), bridge.technique_map(spark)
    )


@query(
    "j14_market_gap",
    GAP_SQL + """ SELECT stack_id, vertical, rank, technique_id, covered, coalesce(covering_tools, '') AS covering_tools, suggested_categories, suggested_vendors, priority FROM gr""",
    ("technique_map", "stack", "org_vertical"),
)
def market_gap(spark, sf):
    lists = ["covering_tools", "suggested_categories", "suggested_vendors"]
    return gap_rows(spark, sf).withColumns({c: F.array_join(c, ",") for c in lists})


@query(
    "j14_market_gap_score",
    GAP_SQL + f""" SELECT stack_id, vertical, count(*) AS techniques, count(*) FILTER (covered) AS covered, {R('count(*) FILTER (covered) / count(*)')} AS coverage_score,
 count(*) FILTER (priority = 'critical') AS critical, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium FROM gr GROUP BY 1, 2""",
    ("technique_map", "stack", "org_vertical"),
)
def market_gap_score(spark, sf):
    return rounded(tq.market_gap_score(gap_rows(spark, sf)), "coverage_score")


@query(
    "j14_stack_compliance",
    f"""WITH f AS {dims.values(dims.compliance_rows(), ['vertical', 'framework'])}, cr AS (SELECT vendor_id, unnest(compliance_frameworks) AS framework FROM registry),
 h AS (SELECT stack_id, framework, count(*) AS tools FROM stack JOIN cr ON vendor_id = tool GROUP BY 1, 2)
 SELECT s.stack_id, ov.vertical, f.framework, coalesce(tools, 0) AS tools, tools IS NOT NULL AS covered FROM (SELECT DISTINCT stack_id FROM stack) s JOIN org_vertical ov ON ov.org = s.stack_id
 JOIN f ON f.vertical = ov.vertical LEFT JOIN h ON h.stack_id = s.stack_id AND h.framework = f.framework""",
    ("stack", "org_vertical", "registry"),
)
def stack_compliance(spark, sf):
    return tq.stack_compliance(
        bridge.stack(spark, sf),
        bridge.org_vertical(spark, sf),
        dims.frame(spark, dims.compliance_rows(), ["vertical", "framework"]),
        bridge.registry(spark, sf),
    )


SIM_SQL = f"""WITH cs AS {STEPS_SQL}, ra AS {RATES_SQL},
 lk AS (SELECT DISTINCT x.technique_id, coalesce(e.tactic, pa.tactic, 'unknown') AS tactic, coalesce(e.categories, pa.categories) AS categories, coalesce(e.primary_vendors, pa.primary_vendors) AS pv FROM cs x {LOOKUP}),
 pr AS (SELECT lk.technique_id, lower(g.vendor_id) AS tool, CASE WHEN list_contains(pv, g.vendor_id) THEN least(coalesce(rate, 0.60) + 0.15, 0.98) ELSE coalesce(rate, 0.40) END AS probability,
  CASE WHEN kind IN ('email', 'iam', 'waf') THEN 'immediate' WHEN kind = 'edr' THEN 'minutes' WHEN kind IN ('ndr', 'ztna') THEN 'minutes-hours' ELSE 'hours' END AS detection_time
  FROM lk JOIN registry g ON list_contains(pv, g.vendor_id) OR list_contains(categories, g.kind) LEFT JOIN ra ON ra.tactic = lk.tactic AND ra.category = g.kind),
 b AS (SELECT stack_id, technique_id, pr.tool, probability, detection_time, row_number() OVER (PARTITION BY stack_id, technique_id ORDER BY probability DESC, pr.tool) AS rn FROM stack s JOIN pr ON pr.tool = lower(s.tool)),
 st AS (SELECT s.stack_id, ov.vertical, cs.chain, cs.step, cs.technique_id, b.tool AS covering_tool, coalesce(b.probability, 0) AS probability, b.detection_time,
  CASE WHEN b.tool IS NULL THEN 'PASS_THROUGH' WHEN b.probability >= 0.70 - 1e-9 THEN 'BLOCKED' ELSE 'DETECTED' END AS result
  FROM (SELECT DISTINCT stack_id FROM stack) s JOIN org_vertical ov ON ov.org = s.stack_id JOIN cs ON cs.vertical = ov.vertical LEFT JOIN b ON b.stack_id = s.stack_id AND b.technique_id = cs.technique_id AND rn = 1)"""


def simulated(spark, sf):
    registry = bridge.registry(spark, sf)
    rates = dims.frame(spark, dims.tactic_rate_rows(), ["tactic", "category", "rate"])
    chance = tq.detection_probability(steps(spark), bridge.technique_map(spark), registry, rates)
    return tq.chain_simulation(bridge.stack(spark, sf), bridge.org_vertical(spark, sf), steps(spark), chance)


@query(
    "j15_chain_steps",
    SIM_SQL + f" SELECT stack_id, vertical, chain, step, technique_id, covering_tool, {R('probability')} AS probability, detection_time, result FROM st",
    ("technique_map", "stack", "org_vertical", "registry"),
)
def chain_steps(spark, sf):
    return rounded(simulated(spark, sf), "probability")


@query(
    "j15_chain_summary",
    SIM_SQL + f""" SELECT stack_id, vertical, chain, steps, pass_through, first_block, overall_pass_through, first_detect, coalesce(first_block, first_detect) AS breaks_at, coverage_pct FROM
 (SELECT stack_id, vertical, chain, count(*) AS steps, count(*) FILTER (result = 'PASS_THROUGH') AS pass_through, min(step) FILTER (result = 'BLOCKED') AS first_block,
 {R('product(1 - probability)')} AS overall_pass_through,
 CASE WHEN coalesce(min(step) FILTER (result = 'DETECTED') < min(step) FILTER (result = 'BLOCKED'), true) THEN min(step) FILTER (result = 'DETECTED') END AS first_detect,
 {R("100.0 * count(*) FILTER (result <> 'PASS_THROUGH') / count(*)")} AS coverage_pct FROM st GROUP BY 1, 2, 3)""",
    ("technique_map", "stack", "org_vertical", "registry"),
)
def chain_summary(spark, sf):
    return rounded(tq.chain_summary(simulated(spark, sf)), "overall_pass_through", "coverage_pct")
