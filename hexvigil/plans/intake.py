"""Lookups, validation, translation and enrichment over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexvigil import bridge, dims
from hexvigil.operators import intake
from hexvigil.operators.techniques import slug
from hexvigil.plans.registry import R, query, rounded
from hexvigil.plans.text import _sql_list


def pick(items, pos):
    return F.element_at(F.array(*[F.lit(i) for i in items]), pos.cast("int") + 1)


@query(
    "p02_canonical_vendor",
    """SELECT i.k, i.raw, coalesce(s.s_name, trim(i.raw)) AS vendor FROM (SELECT l_orderkey * 10 + l_linenumber AS k,
 CASE l_linenumber % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN concat('  ', lower(s_name), ' ') WHEN 2 THEN s_name ELSE concat(s_name, 'x ') END AS raw FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) i
 LEFT JOIN supplier s ON lower(s.s_name) = lower(trim(i.raw))""",
)
def canonical_vendor(spark, sf):
    l, s = bridge.table(spark, sf, "lineitem"), bridge.table(spark, sf, "supplier")
    name, n = F.col("s_name"), F.col("l_linenumber") % 4
    raw = (
        F.when(n == 0, F.upper(name))
        .when(n == 1, F.concat(F.lit("  "), F.lower(name), F.lit(" ")))
        .when(n == 2, name)
        .otherwise(F.concat(name, F.lit("x ")))
    )
    rows = l.join(s, l.l_suppkey == s.s_suppkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), raw.alias("raw"), raw.alias("vendor")
    )
    return intake.canonical_vendor(rows, s.select(F.col("s_name").alias("vendor")))


@query("p03_slug", "SELECT DISTINCT lower(replace(p_name, ' ', '-')) AS slug, p_name FROM part")
def slugs(spark, sf):
    return bridge.table(spark, sf, "part").select(slug("p_name").alias("slug"), "p_name").distinct()


@query(
    "p04_autocomplete",
    "SELECT s_name AS vendor FROM supplier WHERE contains(lower(s_name), 'er#00000000') ORDER BY 1 LIMIT 20",
)
def autocomplete(spark, sf):
    names = bridge.table(spark, sf, "supplier").select(F.col("s_name").alias("vendor"))
    return intake.autocomplete(names, "ER#00000000", 20)


@query(
    "p05_competitors",
    """WITH m AS (SELECT category, list(vendor_id ORDER BY vendor_id) AS peers FROM registry GROUP BY category)
 SELECT v.vendor, coalesce(r.category, 'other') AS category, coalesce(array_to_string(list_filter(peers, lambda p: lower(p) <> lower(v.vendor)), ','), '') AS competitors
 FROM (SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN concat(s_name, ' Labs') ELSE s_name END AS vendor FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) v
 LEFT JOIN registry r ON lower(r.vendor_id) = lower(v.vendor) LEFT JOIN m ON m.category = r.category""",
    ("registry",),
)
def competitors(spark, sf):
    """Every vendor name met in the evaluations, known or not."""
    l, s, reg = bridge.table(spark, sf, "lineitem"), bridge.table(spark, sf, "supplier"), bridge.registry(spark, sf)
    labs = F.concat("s_name", F.lit(" Labs"))
    rows = (
        l.join(s, l.l_suppkey == s.s_suppkey)
        .select(F.when(F.col("l_linenumber") == 7, labs).otherwise(F.col("s_name")).alias("vendor"))
        .distinct()
    )
    market = reg.groupBy("category").agg(F.sort_array(F.collect_list("vendor_id")).alias("competitors"))
    out = intake.competitors(rows, reg.select(F.col("vendor_id").alias("vendor"), "category"), market)
    return out.withColumn("competitors", F.array_join("competitors", ","))


@query(
    "p07_validate_evals",
    """SELECT vendor, category, concat_ws(',', CASE WHEN overall_score < 0 OR overall_score > 10 THEN 'overall_score:range' END, CASE WHEN detection_rate < 0 OR detection_rate > 100 THEN 'detection_rate:range' END,
 CASE WHEN fp_rate < 0 OR fp_rate > 100 THEN 'fp_rate:range' END, CASE WHEN deploy_days < 1 OR deploy_days > 365 THEN 'deploy_days:range' END, CASE WHEN length(vendor) > 200 THEN 'vendor:too_long' END,
 CASE WHEN length(category) > 100 THEN 'category:too_long' END, CASE WHEN category NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO') THEN 'category:unknown' END, CASE WHEN coalesce(vendor, '') = '' THEN 'vendor:empty' END) AS violations, count(*) AS n
 FROM (SELECT CASE WHEN deploy_days = 7 THEN '' ELSE vendor END AS vendor, category, overall_score * 1.1 AS overall_score, detection_rate * 1.05 AS detection_rate, fp_rate, deploy_days - 1 AS deploy_days FROM evals) GROUP BY ALL""",
    ("evals",),
)
def validate_evals(spark, sf):
    e = bridge.evals(spark, sf, "vendor", "category", "overall_score", "detection_rate", "fp_rate", "deploy_days")
    e = e.select(
        F.when(F.col("deploy_days") == 7, "").otherwise(F.col("vendor")).alias("vendor"),
        "category",
        (F.col("overall_score") * 1.1).alias("overall_score"),
        (F.col("detection_rate") * 1.05).alias("detection_rate"),
        "fp_rate",
        (F.col("deploy_days") - 1).alias("deploy_days"),
    )
    out = intake.validate_evals(e, ["ECONOMY", "LARGE", "MEDIUM", "PROMO"])
    return (
        out.withColumn("violations", F.array_join("violations", ","))
        .groupBy("vendor", "category", "violations")
        .agg(F.count("*").alias("n"))
    )


@query(
    "p07_validate_attack_maps",
    """WITH m AS (SELECT contribution_id, list(CASE WHEN tactic = 'LARGE' THEN concat(technique_id, '.001') WHEN tactic = 'SMALL' THEN lower(technique_id) ELSE technique_id END) AS ids FROM technique_obs GROUP BY 1)
 SELECT contribution_id, concat_ws(',', CASE WHEN len(ids) = 0 THEN 'techniques:empty' END, CASE WHEN len(ids) > 5 THEN 'techniques:too_many' END,
 CASE WHEN len(list_filter(ids, lambda i: NOT regexp_matches(i, '^T\\d{4}(\\.\\d{3})?$'))) > 0 THEN 'technique_id:malformed' END) AS violations FROM m""",
    ("technique_obs",),
)
def validate_attack_maps(spark, sf):
    tid = (
        F.when(F.col("tactic") == "LARGE", F.concat("technique_id", F.lit(".001")))
        .when(F.col("tactic") == "SMALL", F.lower("technique_id"))
        .otherwise(F.col("technique_id"))
    )
    maps = (
        bridge.technique_obs(spark, sf, "contribution_id", "technique_id", "tactic")
        .groupBy("contribution_id")
        .agg(F.collect_list(F.struct(tid.alias("technique_id"))).alias("techniques"))
    )
    out = intake.validate_attack_maps(maps, 5)
    return out.select("contribution_id", F.array_join("violations", ",").alias("violations"))


@query(
    "p07_validate_ioc_bundles",
    """WITH b AS (SELECT contribution_id, list({'t': ioc_type, 'h': CASE WHEN campaign = 'Brand#3' THEN left(value_hash, 40) ELSE value_hash END}) AS iocs FROM bundle_ioc GROUP BY 1)
 SELECT contribution_id, concat_ws(',', CASE WHEN len(iocs) > 6 THEN 'iocs:too_many' END, CASE WHEN len(list_filter(iocs, lambda i: i.t NOT IN ('domain', 'ip', 'hash-sha256', 'hash-md5', 'url', 'email'))) > 0 THEN 'ioc_type:unknown' END,
 CASE WHEN len(list_filter(iocs, lambda i: length(i.h) <> 64)) > 0 THEN 'value_hash:length' END) AS violations FROM b""",
    ("bundle_ioc",),
)
def validate_ioc_bundles(spark, sf):
    h = F.when(F.col("campaign") == "Brand#3", F.substring("value_hash", 1, 40)).otherwise(F.col("value_hash"))
    bundles = (
        bridge.bundle_ioc(spark, sf)
        .groupBy("contribution_id")
        .agg(F.collect_list(F.struct("ioc_type", h.alias("value_hash"))).alias("iocs"))
    )
    out = intake.validate_ioc_bundles(bundles, 6)
    return out.select("contribution_id", F.array_join("violations", ",").alias("violations"))


PHRASES = ["Great Detection Quality", "response_speed is fine", "COST", "too much alert fatigue here", "reporting", "zzz", "support", "complex", "price", "peer recommendation"]


def match_sql(expr, categories):
    parts = [f"WHEN coalesce({expr}, '') = '' THEN 'other'"]
    for c in categories:
        s = c.replace("_", " ")
        parts.append(
            f"WHEN contains(lower({expr}), '{c}') OR contains(lower({expr}), '{s}') OR contains('{c}', lower({expr})) OR contains('{s}', lower({expr})) THEN '{c}'"
        )
    return "CASE " + " ".join(parts) + " ELSE 'other' END"


@query(
    "p08_translate_evals",
    f"""SELECT vendor, category, TRY_CAST(score AS DOUBLE) AS overall_score, TRY_CAST(yes AS BOOLEAN) AS would_buy, {match_sql('a', dims.STRENGTH_CATEGORIES)} AS top_strength, {match_sql('b', dims.FRICTION_CATEGORIES)} AS top_friction,
 {match_sql('c', dims.DECISION_FACTORS)} AS decision_factor, count(*) AS n FROM (SELECT s_name AS vendor, 'general' AS category, CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS score,
 CASE l_returnflag WHEN 'N' THEN 'true' WHEN 'A' THEN 'false' ELSE 'maybe' END AS yes, {_sql_list(PHRASES)}[CAST(l_partkey % 10 AS INTEGER) + 1] AS a, {_sql_list(PHRASES)}[CAST((l_partkey + 1) % 10 AS INTEGER) + 1] AS b,
 {_sql_list(PHRASES)}[CAST((l_partkey + 3) % 10 AS INTEGER) + 1] AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY ALL""",
)
def translate_evals(spark, sf):
    l, s = bridge.texts(spark, sf, "lineitem", "l_orderkey"), bridge.table(spark, sf, "supplier")
    k = F.col("l_partkey")
    raw = l.join(s, l.l_suppkey == s.s_suppkey).select(
        F.col("s_name").alias("vendor"),
        F.lit(None).cast("string").alias("category"),
        F.when(F.col("l_linenumber") == 3, "n/a")
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("overall_score"),
        F.expr("CASE l_returnflag WHEN 'N' THEN 'true' WHEN 'A' THEN 'false' ELSE 'maybe' END").alias("would_buy"),
        pick(PHRASES, k % 10).alias("top_strength"),
        pick(PHRASES, (k + 1) % 10).alias("top_friction"),
        pick(PHRASES, (k + 3) % 10).alias("decision_factor"),
        F.lit("free text").alias("notes"),
    )
    out = intake.translate_evals(raw)
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query(
    "p08_translate_attack_context",
    f"SELECT contribution_id, {match_sql('severity', dims.SEVERITY_LEVELS)} AS severity, {match_sql('time_to_detect', dims.TIME_BUCKETS)} AS time_to_detect FROM incidents",
    ("incidents",),
)
def translate_attack_context(spark, sf):
    return intake.translate_attack_context(bridge.incidents(spark, sf, "contribution_id", "severity", "time_to_detect"))


@query(
    "p09_clean_web_form",
    """SELECT o_orderkey, CASE WHEN lower(c) IN ('edr', 'siem', 'waf') THEN c ELSE 'general' END AS category, CAST(greatest(1.0, least(10.0, o_orderkey % 14)) AS DOUBLE) AS overall_score,
 CASE WHEN o_orderkey % 3 <> 0 THEN CAST(greatest(1.0, least(10.0, o_custkey % 13)) AS DOUBLE) END AS support_quality, floor(o_totalprice) AS annual_cost, o_orderstatus = 'F' AS would_buy,
 CASE WHEN o_orderkey % 2 = 0 THEN 'price' END AS decision_factor, 'web' AS source FROM (SELECT *, ['edr', 'siem', 'waf', 'toaster'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS c FROM orders)""",
)
def clean_web_form(spark, sf):
    k = F.col("o_orderkey")
    form = bridge.table(spark, sf, "orders").select(
        "o_orderkey",
        pick(["edr", "siem", "waf", "toaster"], k % 4).alias("category"),
        (k % 14).cast("string").alias("overall_score"),
        F.when(k % 3 != 0, (F.col("o_custkey") % 13).cast("string")).otherwise("").alias("support_quality"),
        F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0)).alias("annual_cost"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("would_buy"),
        F.when(k % 2 == 0, "price").otherwise("mood").alias("decision_factor"),
    )
    return intake.clean_web_form(form)


@query(
    "in20_lab_scores",
    f"""SELECT vendor, {R('avg(detection_rate / 10)')} AS detection_share, {R('avg(overall_score / 10 * 10)')} AS points, {R('avg((100.0 - fp_rate) / 10)')} AS accuracy_fp,
 {R('avg(greatest(0.0, least(10.0, (98.0 + overall_score / 5 - 98.0) * 5.0 - deploy_days * 0.1)))')} AS block_rate, {R('avg(detection_rate / 11.5)')} AS attack_evaluation,
 {R('avg((overall_score / 2 + fp_rate / 2 + deploy_days / 2) / 18.0 * 10)')} AS protection_tests, {R('avg(deploy_days * 2)')} AS stars, {R('avg(detection_rate / 10)')} AS accuracy FROM evals GROUP BY vendor""",
    ("evals",),
)
def lab_scores(spark, sf):
    e = bridge.evals(spark, sf, "vendor", "detection_rate", "overall_score", "fp_rate", "deploy_days")
    rate, score, fp, days = (F.col(c) for c in ("detection_rate", "overall_score", "fp_rate", "deploy_days"))
    named = {
        "detection_share": (rate,),
        "points": (score, F.lit(10)),
        "accuracy": (rate,),
        "accuracy_fp": (fp,),
        "block_rate": (F.lit(98.0) + score / 5, days),
        "attack_evaluation": (rate,),
        "protection_tests": (score / 2, fp / 2, days / 2),
        "stars": (days,),
    }
    out = e.groupBy("vendor").agg(*[F.avg(intake.lab_score(k, *a)).alias(k) for k, a in named.items()])
    return rounded(out, *named)


KEYWORDS = [("red", "red-labs"), ("widget", "widget-works"), ("cold", "cold-storage"), ("large", "large-co"), ("ring", "ring-inc"), ("plate", "plate-ltd")]


@query(
    "in21_catalogue_risk",
    f"""WITH v AS (SELECT concat('CVE-', CAST(2000 + p_size AS VARCHAR), '-', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS cve_id, CASE WHEN p_retailprice % 3 < 1 THEN 'Known' ELSE 'Unknown' END AS ransomware, CAST(2000 + p_size AS VARCHAR) AS date_added,
  CASE WHEN contains(lower(p_name), 'red') THEN 'red-labs' WHEN contains(lower(p_name), 'widget') THEN 'widget-works' WHEN contains(lower(p_name), 'large') THEN 'large-co' WHEN contains(lower(p_name), 'ring') THEN 'ring-inc'
   WHEN contains(lower(p_name), 'plate') THEN 'plate-ltd' END AS vendor_id FROM part WHERE p_partkey % 1 = 0),
 s AS (SELECT vendor_id, count(*) AS cve_count, count(*) FILTER (ransomware = 'Known') AS ransomware_count, max(date_added) AS latest FROM v WHERE vendor_id IS NOT NULL GROUP BY 1),
 f AS (SELECT vendor_id, string_agg(cve_id, ',' ORDER BY cve_id) AS first_cves FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY cve_id) AS r FROM v) WHERE r <= 10 GROUP BY 1)
 SELECT s.vendor_id, cve_count, ransomware_count, latest, first_cves, {R('greatest(0.0, least(10.0, 10 - cve_count * 1.5))')} AS risk_score FROM s JOIN f ON f.vendor_id = s.vendor_id""".replace(
        " WHERE p_partkey % 1 = 0", ""
    ),
)
def catalogue_risk(spark, sf):
    p = bridge.table(spark, sf, "part")
    year = (2000 + F.col("p_size")).cast("string")
    vulns = p.select(
        F.concat(F.lit("CVE-"), year, F.lit("-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("cve_id"),
        F.upper("p_name").alias("vendor_project"),
        F.lit("").alias("product"),
        F.when(F.col("p_retailprice") % 3 < 1, "Known").otherwise("Unknown").alias("ransomware"),
        year.alias("date_added"),
    )
    out = intake.catalogue_risk(vulns, KEYWORDS, ["cold"])
    return rounded(out.withColumn("first_cves", F.array_join("first_cves", ",")), "risk_score")


@query(
    "in22_repository_popularity",
    f"""SELECT vendor_id, CAST(sum(stars) AS BIGINT) AS total_stars, CAST(sum(forks) AS BIGINT) AS total_forks, CAST(sum(issues) AS BIGINT) AS total_issues, max(updated_at) AS latest_update, count(*) AS repos, {R('least(10.0, sum(stars) / 1000.0)')} AS score FROM
 (SELECT o_custkey AS vendor_id, o_orderkey AS repo, CAST(floor(o_totalprice / 100) AS BIGINT) AS stars, o_orderkey % 97 AS forks, o_orderkey % 31 AS issues, strftime(o_orderdate, '%Y-%m-%d') AS updated_at FROM orders) GROUP BY 1""",
)
def repository_popularity(spark, sf):
    repos = bridge.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("vendor_id"),
        F.col("o_orderkey").alias("repo"),
        F.floor(F.col("o_totalprice") / 100).alias("stars"),
        (F.col("o_orderkey") % 97).alias("forks"),
        (F.col("o_orderkey") % 31).alias("issues"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
    )
    return rounded(intake.repository_popularity(repos), "score")


TOOL_SQL = """SELECT DISTINCT CASE l_linenumber WHEN 1 THEN s_name WHEN 2 THEN upper(s_name) WHEN 3 THEN replace(s_name, '#', ' ') WHEN 4 THEN concat('our ', s_name, ' box') WHEN 5 THEN concat('old ', lower(s_name))
 WHEN 6 THEN concat('Palo Alto ', CAST(l_suppkey AS VARCHAR)) ELSE ['MDE', 'Falcon', '000000003', 'Nothing Known', ' s1 '][CAST(l_partkey % 5 AS INTEGER) + 1] END AS tool FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""
ALIAS_SQL = "[" + ", ".join("{'a': '%s', 'id': '%s'}" % a for a in intake.TOOL_ALIASES) + "]"


@query(
    "in24_match_tools",
    f"""WITH t AS (SELECT tool, lower(trim(tool)) AS n FROM ({TOOL_SQL})), al AS (SELECT a, id, row_number() OVER () AS o FROM (SELECT unnest({ALIAS_SQL}, recursive := true))),
 c AS (SELECT tool, 1 AS rule, 0 AS o, vendor_id FROM t JOIN registry ON lower(vendor_id) = n
  UNION ALL SELECT tool, 2, o, id FROM t JOIN al ON a = n
  UNION ALL SELECT tool, 3, 0, vendor_id FROM t JOIN registry ON lower(display_name) = n
  UNION ALL SELECT tool, 4, 0, vendor_id FROM t JOIN registry ON contains(lower(display_name), n)
  UNION ALL SELECT tool, 5, o, id FROM t JOIN al ON contains(n, a)
  UNION ALL SELECT tool, 6, 0, vendor_id FROM t JOIN registry ON contains(n, lower(vendor_id))
  UNION ALL SELECT tool, 7, 0, vendor_id FROM t JOIN registry ON contains(n, replace(lower(vendor_id), '-', ' ')))
 SELECT t.tool, x.vendor_id, CAST(x.rule AS INTEGER) AS rule FROM t LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY tool ORDER BY rule, o, vendor_id) = 1) x ON x.tool = t.tool""",
    ("registry",),
)
def match_tools(spark, sf):
    l, s = bridge.table(spark, sf, "lineitem"), bridge.table(spark, sf, "supplier")
    name = F.col("s_name")
    forms = [
        name,
        F.upper(name),
        F.replace(name, F.lit("#"), F.lit(" ")),
        F.concat(F.lit("our "), name, F.lit(" box")),
        F.concat(F.lit("old "), F.lower(name)),
        F.concat(F.lit("Palo Alto "), F.col("l_suppkey").cast("string")),
        pick(["MDE", "Falcon", "000000003", "Nothing Known", " s1 "], F.col("l_partkey") % 5),
    ]
    tools = l.join(s, l.l_suppkey == s.s_suppkey).select(
        F.element_at(F.array(*forms), F.col("l_linenumber")).alias("tool")
    )
    return intake.match_tools(tools, bridge.registry(spark, sf))


FRAMEWORK_NAMES = ["hipaa", "PCI_DSS", " soc 2", "NIST-CSF", "fed_ramp", "Custom One", "iso 27001"]


@query(
    "in25_framework_coverage",
    f"""SELECT org, CASE lower(trim(f)) WHEN 'hipaa' THEN 'HIPAA' WHEN 'pci_dss' THEN 'PCI-DSS' WHEN 'soc 2' THEN 'SOC2' WHEN 'nist-csf' THEN 'NIST CSF' WHEN 'fed_ramp' THEN 'FedRAMP' WHEN 'iso 27001' THEN 'ISO27001' ELSE trim(f) END AS framework,
 bool_or(st) AS covered, count(*) AS controls, count(*) FILTER (st) AS passing FROM (SELECT o_custkey AS org, {_sql_list(FRAMEWORK_NAMES)}[CAST(l_partkey % 7 AS INTEGER) + 1] AS f, l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'O') AS st
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2""",
)
def framework_coverage(spark, sf):
    l, o = bridge.table(spark, sf, "lineitem"), bridge.table(spark, sf, "orders")
    status = (
        F.when(F.col("l_returnflag") == "A", " Passing ")
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "YES")
        .otherwise("failing")
    )
    controls = l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("org"), pick(FRAMEWORK_NAMES, F.col("l_partkey") % 7).alias("framework"), status.alias("status")
    )
    return intake.framework_coverage(controls, ("org",))


BREACH_TYPES = list(intake.BREACH_TYPE_TECHNIQUES)
LOCATIONS = list(intake.LOCATION_TECHNIQUES)


def _case_lists(expr, table):
    parts = " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in table.items())
    return f"CASE {expr} {parts} END"


@query(
    "in17_breach_to_attack_map",
    f"""WITH b AS (SELECT o_orderkey, o_totalprice * 5 AS n, {_sql_list(BREACH_TYPES)}[CAST(o_orderkey % 5 AS INTEGER) + 1] AS bt, {_sql_list(LOCATIONS)}[CAST(o_custkey % 7 AS INTEGER) + 1] AS loc FROM orders),
 t AS (SELECT *, list_distinct(list_concat({_case_lists('bt', intake.BREACH_TYPE_TECHNIQUES)}, {_case_lists('loc', intake.LOCATION_TECHNIQUES)}, CASE WHEN n > 500000 AND bt = 'Hacking/IT Incident' THEN ['T1486'] ELSE [] END)) AS ts FROM b)
 SELECT o_orderkey, CASE WHEN len(ts) > 0 THEN array_to_string(list_sort(ts), ',') ELSE 'T1078' END AS techniques, CASE WHEN n > 1000000 THEN 'critical' ELSE 'high' END AS severity FROM t""",
)
def breach_to_attack_map(spark, sf):
    rows = bridge.table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") * 5).alias("individuals_affected"),
        pick(BREACH_TYPES, F.col("o_orderkey") % 5).alias("breach_type"),
        pick(LOCATIONS, F.col("o_custkey") % 7).alias("location"),
    )
    out = intake.breach_to_attack_map(rows)
    return out.select("o_orderkey", F.array_join("techniques", ",").alias("techniques"), "severity")


@query(
    "in17_court_cases",
    "SELECT DISTINCT conv_id, 'T1078,T1048' AS techniques, 'high' AS severity FROM conversations",
)
def court_cases(spark, sf):
    cases = bridge.table(spark, sf, "conversations").select("conv_id").distinct()
    return intake.court_case_to_attack_map(cases).withColumn("techniques", F.array_join("techniques", ","))
