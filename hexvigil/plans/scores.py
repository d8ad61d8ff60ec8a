"""Vendor scores, rankings and market views."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexvigil import bridge, dims
from hexvigil.operators import scores
from hexvigil.plans.registry import R, query, r6, rounded

AGG_SQL = """SELECT vendor, category, avg(overall_score) AS avg_score, avg(detection_rate) AS avg_detection_rate,
 avg(fp_rate) AS avg_fp_rate, avg(deploy_days) AS avg_deploy_days, count(*) AS contribution_count,
 100.0 * sum(CASE WHEN would_buy THEN 1 ELSE 0 END) / count(*) AS would_buy_pct_all FROM evals GROUP BY vendor, category"""
AGG_COLS = ["avg_score", "avg_detection_rate", "avg_fp_rate", "avg_deploy_days", "would_buy_pct_all"]
AGG_IN = ("vendor", "category", "overall_score", "detection_rate", "fp_rate", "deploy_days", "would_buy")
AGG_ROUNDED = ", ".join(f"{R(c)} AS {c}" for c in AGG_COLS)


def vendor_scores(spark, sf):
    return scores.vendor_aggregate(bridge.evals(spark, sf, *AGG_IN))


@query(
    "a01_vendor_aggregate",
    f"SELECT vendor, category, contribution_count, {AGG_ROUNDED} FROM ({AGG_SQL}) WHERE contribution_count >= 3",
    ("evals",),
)
def vendor_aggregate(spark, sf):
    return rounded(scores.min_k(vendor_scores(spark, sf), 3), *AGG_COLS)


@query(
    "p06_min_k_report",
    f"""SELECT vendor, category, contribution_count, contribution_count < 10 AS suppressed,
 CASE WHEN contribution_count >= 10 THEN {R('avg_score')} END AS avg_score FROM ({AGG_SQL})""",
    ("evals",),
)
def min_k_report(spark, sf):
    flagged = scores.min_k(vendor_scores(spark, sf), 10, report=True)
    return flagged.select(
        "vendor",
        "category",
        "contribution_count",
        "suppressed",
        F.when(~F.col("suppressed"), r6("avg_score")).alias("avg_score"),
    )


FIELD_IN = (
    "vendor", "category", "overall_score", "detection_rate", "fp_rate", "deploy_days", "annual_cost", "would_buy",
    "chose_this_vendor",
)


@query(
    "a02_field_aggregate",
    f"""SELECT vendor, count(*) AS contributor_count, {R('avg(overall_score)')} AS avg_overall_score,
 {R('avg(detection_rate)')} AS avg_detection_rate, {R('avg(fp_rate)')} AS avg_fp_rate, {R('avg(deploy_days)')} AS avg_deploy_days,
 {R('avg(annual_cost)')} AS avg_annual_cost,
 {R('100.0 * sum(CASE WHEN would_buy THEN 1 ELSE 0 END) / count(would_buy)')} AS would_buy_pct_answered,
 {R('100.0 * sum(CASE WHEN chose_this_vendor THEN 1 ELSE 0 END) / count(chose_this_vendor)')} AS chose_this_vendor_pct_answered
 FROM evals GROUP BY vendor""",
    ("evals",),
)
def field_aggregate(spark, sf):
    df = bridge.evals(spark, sf, *[c for c in FIELD_IN if c != "category"])
    numeric, boolean, _ = scores.present_fields(df)
    out = scores.field_aggregate(df, ("vendor",), numeric, boolean)
    return rounded(out, *[c for c in out.columns if c.startswith("avg_") or c.endswith("_answered")])


@query(
    "a02_categorical_counts",
    """SELECT industry, 'severity' AS field, severity AS value, count(*) AS n FROM incidents GROUP BY 1, 3
 UNION ALL SELECT industry, 'time_to_detect', time_to_detect, count(*) FROM incidents GROUP BY 1, 3""",
    ("incidents",),
)
def categorical_counts(spark, sf):
    df = bridge.incidents(spark, sf, "industry", "severity", "time_to_detect")
    _, _, fields = scores.present_fields(df)
    return scores.categorical_counts(df, ("industry",), fields)


@query(
    "a03_category_average",
    f"SELECT category, {R('avg(avg_score)')} AS category_avg, count(*) AS vendor_count FROM ({AGG_SQL}) GROUP BY category",
    ("evals",),
)
def category_average(spark, sf):
    agg = scores.vendor_aggregate(bridge.evals(spark, sf, *AGG_IN)).select("vendor", "category", "avg_score")
    return rounded(scores.category_average(agg), "category_avg")


# The order priorities of the tables stand for contribution sources.
SOURCE_OF = [("1-URGENT", "mitre"), ("2-HIGH", "av-test"), ("3-MEDIUM", "community"), ("5-LOW", "g2")]


@query(
    "a04_weighted_score",
    f"""WITH s AS (SELECT vendor, overall_score, coalesce(m.source, e.source) AS source FROM evals e
 LEFT JOIN {dims.values(SOURCE_OF, ['alias', 'source'], 'm')} m ON e.source = m.alias),
 w AS {dims.values(dims.SOURCE_WEIGHTS, ['source', 'weight'], 'w')}
 SELECT vendor, {R('sum(overall_score * coalesce(weight, 1.0)) / sum(coalesce(weight, 1.0))')} AS weighted_score,
 count(*) AS eval_count, count(DISTINCT s.source) AS source_count FROM s LEFT JOIN w ON s.source = w.source GROUP BY vendor""",
    ("evals",),
)
def weighted_score(spark, sf):
    out = scores.weighted_score(
        bridge.evals(spark, sf, "vendor", "overall_score", "source"),
        dims.frame(spark, dims.SOURCE_WEIGHTS, ["source", "weight"]),
        aliases=dims.frame(spark, SOURCE_OF, ["alias", "source"]),
    )
    return rounded(out, "weighted_score")


CONF_SQL = """CASE WHEN eval_count >= 8 AND source_count >= 5 THEN 'high' WHEN eval_count >= 4 AND source_count >= 3 THEN 'medium'
 WHEN eval_count >= 3 THEN 'low' ELSE 'insufficient' END"""


@query(
    "a05_confidence",
    f"""SELECT vendor, category, eval_count, source_count, {CONF_SQL} AS confidence FROM
 (SELECT vendor, category, count(*) AS eval_count, count(DISTINCT source) AS source_count FROM evals GROUP BY vendor, category)""",
    ("evals",),
)
def vendor_confidence(spark, sf):
    return scores.vendor_confidence(bridge.evals(spark, sf, "vendor", "category", "source"), ("vendor", "category"))


MEASURED_SQL = """SELECT vendor, category, avg(overall_score) AS avg_score, count(*) AS contribution_count,
 count(DISTINCT source) AS source_count FROM evals GROUP BY vendor, category"""
LISTING_SQL = f"""SELECT coalesce(m.vendor, r.vendor_id) AS vendor_id, coalesce(m.category, r.category) AS category,
 n.display_name AS display, avg_score, coalesce(contribution_count, 0) AS eval_count, coalesce(source_count, 0) AS source_count,
 r.vendor_id IS NOT NULL AS in_registry
 FROM ({MEASURED_SQL}) m FULL OUTER JOIN registry r ON m.vendor = r.vendor_id AND m.category = r.category
 LEFT JOIN registry n ON n.vendor_id = coalesce(m.vendor, r.vendor_id)"""


def listing(spark, sf):
    e = bridge.evals(spark, sf, "vendor", "category", "overall_score", "source")
    per_source = e.groupBy("vendor", "category", "source").agg(
        F.sum("overall_score").alias("s"), F.count("*").alias("n")
    )
    measured = (
        per_source.groupBy("vendor", "category")
        .agg(
            (F.sum("s") / F.sum("n")).alias("avg_score"),
            F.sum("n").alias("contribution_count"),
            F.count("source").alias("source_count"),
        )
    )
    return scores.category_listing(bridge.registry(spark, sf), measured)


@query(
    "j09_category_listing",
    f"SELECT vendor_id, category, display, {R('avg_score')} AS avg_score, eval_count, source_count, in_registry FROM ({LISTING_SQL})",
    ("evals", "registry"),
)
def category_listing(spark, sf):
    return rounded(listing(spark, sf), "avg_score")


@query(
    "a06_market_map",
    f"""SELECT vendor_id, category, avg_score, eval_count, confidence,
 CASE WHEN avg_score > 8 AND confidence = 'high' THEN 'leader' WHEN avg_score BETWEEN 7 AND 8 THEN 'contender'
 WHEN confidence = 'medium' THEN 'emerging' ELSE 'watch' END AS tier FROM (SELECT * REPLACE ({R('avg_score')} AS avg_score), {CONF_SQL} AS confidence FROM ({LISTING_SQL}))""",
    ("evals", "registry"),
)
def market_map(spark, sf):
    out = scores.market_map(rounded(listing(spark, sf), "avg_score"))
    return out.select("vendor_id", "category", "avg_score", "eval_count", "confidence", "tier")


VENDOR_SQL = """SELECT vendor, avg(overall_score) AS avg_score, avg(detection_rate) AS avg_detection_rate, count(*) AS contribution_count,
 100.0 * sum(CASE WHEN would_buy THEN 1 ELSE 0 END) / count(*) AS would_buy_pct_all FROM evals GROUP BY vendor"""


@query(
    "a07_danger_radar",
    f"""SELECT vendor_id, display_name, category, {R('avg_score')} AS avg_score, coalesce(contribution_count, 0) AS eval_count,
 CAST(CASE WHEN trim(known_issues) <> '' THEN 2 ELSE 0 END + CASE WHEN len(insurance_carriers) = 0 THEN 1 ELSE 0 END AS INTEGER) AS danger_score,
 concat_ws(',', CASE WHEN trim(known_issues) <> '' THEN 'documented_issues' END,
  CASE WHEN len(insurance_carriers) = 0 THEN 'no_insurance_carrier' END) AS danger_signals
 FROM registry LEFT JOIN ({VENDOR_SQL}) ON vendor = vendor_id WHERE trim(known_issues) <> '' OR len(insurance_carriers) = 0""",
    ("evals", "registry"),
)
def danger_radar(spark, sf):
    per_vendor = scores.vendor_aggregate(
        bridge.evals(spark, sf, *[c for c in AGG_IN if c != "category"]), ("vendor",)
    ).select("vendor", "avg_score", "contribution_count")
    out = scores.danger_radar(bridge.registry(spark, sf), per_vendor)
    return rounded(out.withColumn("danger_signals", F.array_join("danger_signals", ",")), "avg_score")


@query(
    "a08_category_rank",
    f"""WITH g AS (SELECT tool AS vendor, count(DISTINCT technique_id) AS gap_count FROM technique_obs WHERE outcome = 'missed' GROUP BY tool)
 SELECT a.vendor, a.category, {R('avg_score')} AS avg_score, contribution_count,
 rank() OVER (PARTITION BY category ORDER BY {R('avg_score')} DESC) AS category_rank, count(*) OVER (PARTITION BY category) AS category_total,
 coalesce(gap_count, 0) AS gap_count FROM ({AGG_SQL}) a LEFT JOIN g ON a.vendor = g.vendor""",
    ("evals", "technique_obs"),
)
def category_rank(spark, sf):
    agg = rounded(vendor_scores(spark, sf).select("vendor", "category", "avg_score", "contribution_count"), "avg_score")
    gaps = (
        bridge.technique_obs(spark, sf, "technique_id", "tool", "outcome")
        .where("outcome = 'missed'")
        .groupBy(F.col("tool").alias("vendor"))
        .agg(F.count_distinct("technique_id").alias("gap_count"))
    )
    return scores.category_rank(agg, gaps)


@query(
    "a09_my_position",
    f"""WITH v AS (SELECT category, vendor, avg(overall_score) AS vendor_avg, count(*) AS contributor_count FROM evals GROUP BY 1, 2),
 c AS (SELECT category, avg(vendor_avg) AS category_avg FROM v GROUP BY 1),
 p AS (SELECT category, vendor, overall_score, percent_rank() OVER (PARTITION BY category ORDER BY overall_score) AS percent_rank FROM evals)
 SELECT p.category, p.vendor, overall_score, count(*) AS n_evals, {R('any_value(vendor_avg)')} AS vendor_avg,
 any_value(contributor_count) AS contributor_count, {R('any_value(category_avg)')} AS category_avg, {R('any_value(percent_rank)')} AS percent_rank,
 CAST(CASE WHEN overall_score > any_value(vendor_avg) + 1e-9 THEN 75 WHEN abs(overall_score - any_value(vendor_avg)) <= 1e-9 THEN 50 ELSE 25 END AS INTEGER) AS position
 FROM p JOIN v ON p.category = v.category AND p.vendor = v.vendor JOIN c ON c.category = p.category GROUP BY p.category, p.vendor, overall_score""",
    ("evals",),
)
def my_position(spark, sf):
    out = scores.my_position(bridge.evals(spark, sf, "vendor", "category", "overall_score"))
    return rounded(out, "vendor_avg", "category_avg", "percent_rank")


DETAIL_SQL = f"""SELECT vendor_id, display_name, r.category, coalesce(contribution_count, 0) AS eval_count, avg_score, avg_detection_rate,
 would_buy_pct_all, coalesce(source_count, 0) AS source_count,
 CASE WHEN c.eval_count IS NULL THEN 'insufficient' ELSE {CONF_SQL.replace('eval_count', 'c.eval_count')} END AS confidence,
 array_to_string(certifications, ',') AS certifications, CAST(len(insurance_carriers) AS INTEGER) AS carrier_count,
 array_to_string(compliance_frameworks, ',') AS compliance_frameworks, known_issues, typical_deploy_days, weighted_score
 FROM registry r LEFT JOIN (SELECT vendor, sum(overall_score * CASE source WHEN '1-URGENT' THEN 2.0 ELSE 1.0 END) / sum(CASE source WHEN '1-URGENT' THEN 2.0 ELSE 1.0 END) AS weighted_score FROM evals GROUP BY vendor) ws ON ws.vendor = r.vendor_id LEFT JOIN ({VENDOR_SQL}) s ON s.vendor = r.vendor_id
 LEFT JOIN (SELECT vendor, count(*) AS eval_count, count(DISTINCT source) AS source_count FROM evals GROUP BY vendor) c ON c.vendor = r.vendor_id"""


def detail(spark, sf):
    per_vendor = scores.vendor_aggregate(
        bridge.evals(spark, sf, *[c for c in AGG_IN if c != "category"]), ("vendor",)
    )
    conf = scores.vendor_confidence(bridge.evals(spark, sf, "vendor", "source"))
    urgent = spark.range(1).select(F.lit("1-URGENT").alias("source"), F.lit(2.0).alias("weight"))
    weighted = scores.weighted_score(bridge.evals(spark, sf, "vendor", "overall_score", "source"), urgent)
    return scores.vendor_detail(bridge.registry(spark, sf), per_vendor, conf, weighted=weighted)


@query(
    "j10_vendor_detail",
    f"""SELECT vendor_id, display_name, category, eval_count, {R('avg_score')} AS avg_score, {R('avg_detection_rate')} AS avg_detection_rate,
 {R('would_buy_pct_all')} AS would_buy_pct_all, source_count, confidence, certifications, carrier_count,
 compliance_frameworks, known_issues, typical_deploy_days, {R('weighted_score')} AS weighted_score FROM ({DETAIL_SQL})""",
    ("evals", "registry"),
)
def vendor_detail(spark, sf):
    lists = ["certifications", "compliance_frameworks"]
    out = detail(spark, sf).withColumns({c: F.array_join(c, ",") for c in lists})
    return rounded(out, "avg_score", "avg_detection_rate", "would_buy_pct_all", "weighted_score")


@query(
    "j10_compare_vendors",
    f"""WITH d AS ({DETAIL_SQL}), p AS (SELECT s1.s_name AS vendor_a, s2.s_name AS vendor_b FROM supplier s1 JOIN supplier s2 ON s2.s_suppkey = s1.s_suppkey + 1)
 SELECT vendor_a, vendor_b, a.display_name AS display_name_a, {R('a.avg_score')} AS avg_score_a, a.eval_count AS eval_count_a, a.confidence AS confidence_a,
 b.display_name AS display_name_b, {R('b.avg_score')} AS avg_score_b, b.eval_count AS eval_count_b, b.confidence AS confidence_b,
 {R('a.avg_score - b.avg_score')} AS score_difference FROM p JOIN d a ON a.vendor_id = vendor_a JOIN d b ON b.vendor_id = vendor_b""",
    ("evals", "registry"),
)
def compare_vendors(spark, sf):
    s = bridge.table(spark, sf, "supplier")
    pairs = s.select(F.col("s_name").alias("vendor_a"), (F.col("s_suppkey") + 1).alias("k")).join(
        s.select(F.col("s_name").alias("vendor_b"), F.col("s_suppkey").alias("k")), "k"
    )
    out = scores.compare_vendors(detail(spark, sf), pairs.drop("k"))
    return rounded(out, "avg_score_a", "avg_score_b", "score_difference")


@query(
    "a33_rfp_comparison",
    """WITH cov AS (SELECT v, count(DISTINCT technique_id) AS n FROM (SELECT unnest(primary_vendors) AS v, technique_id FROM technique_map) GROUP BY v),
 sc AS (SELECT vendor_id, display_name, typical_deploy_days, CAST(coalesce(n, 0) AS INTEGER) AS technique_coverage,
  CAST(least(100, len(compliance_frameworks) * 15 + len(certifications) * 8) AS INTEGER) AS compliance_score,
  CASE WHEN len(insurance_carriers) >= 4 THEN 95 WHEN len(insurance_carriers) >= 2 THEN 75 WHEN len(insurance_carriers) >= 1 THEN 50 ELSE 20 END AS insurance_score,
  CASE WHEN known_issues = '' THEN 95 WHEN contains(lower(known_issues), 'breach') OR contains(lower(known_issues), 'cve') THEN 40
   WHEN contains(lower(known_issues), 'ban') THEN 25 ELSE 60 END AS risk_score FROM registry LEFT JOIN cov ON v = vendor_id),
 so AS (SELECT *, CAST(least(100, floor(technique_coverage * 2 + compliance_score * 0.3 + insurance_score * 0.2 + risk_score * 0.2 + 1e-9)) AS INTEGER) AS overall FROM sc),
 req AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS request_id, s_name AS vendor_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'Unlisted tool' FROM orders),
 j AS (SELECT request_id, req.vendor_id, so.vendor_id IS NOT NULL AS found, display_name, technique_coverage, compliance_score, insurance_score, risk_score, overall, typical_deploy_days
  FROM req LEFT JOIN so ON so.vendor_id = req.vendor_id),
 w AS (SELECT *, row_number() OVER o AS rn, lead(vendor_id) OVER o AS nv, lead(found) OVER o AS nf, lead(risk_score) OVER o AS nr, lead(typical_deploy_days) OVER o AS nd
  FROM j WINDOW o AS (PARTITION BY request_id ORDER BY overall DESC NULLS LAST, vendor_id))
 SELECT request_id, vendor_id, found, display_name, technique_coverage, compliance_score, insurance_score, risk_score, overall, typical_deploy_days,
 CAST(CASE WHEN found THEN rn END AS INTEGER) AS position, CASE WHEN found AND nf THEN nv END AS runner_up, CASE WHEN found AND nf THEN risk_score < nr END AS riskier_than_next,
 CASE WHEN found AND nf THEN typical_deploy_days > nd * 2 END AS next_deploys_faster FROM w""",
    ("registry", "technique_map"),
)
def rfp_comparison(spark, sf):
    o = bridge.table(spark, sf, "orders")
    l = bridge.table(spark, sf, "lineitem")
    s = bridge.table(spark, sf, "supplier")
    named = (
        l.join(o, l.l_orderkey == o.o_orderkey)
        .join(s, l.l_suppkey == s.s_suppkey)
        .select(F.col("o_custkey").cast("string").alias("request_id"), F.col("s_name").alias("vendor_id"))
        .distinct()
    )
    unknown = (
        o.select(F.col("o_custkey").cast("string").alias("request_id"), F.lit("Unlisted tool").alias("vendor_id"))
        .distinct()
    )
    return scores.rfp_comparison(
        bridge.registry(spark, sf), bridge.technique_map(spark), named.unionAll(unknown)
    )


@query(
    "p01_browse_page",
    """SELECT vendor, source, category, overall_score, strftime(received_at, '%Y-%m-%d') AS received_on, annual_cost FROM evals
 WHERE category = 'PROMO' AND source = '2-HIGH' ORDER BY received_at DESC, vendor, annual_cost, overall_score LIMIT 100 OFFSET 50""",
    ("evals",),
)
def browse_page(spark, sf):
    cols = ("vendor", "source", "category", "overall_score", "received_at", "annual_cost")
    page = scores.browse(
        bridge.evals(spark, sf, *cols),
        source="2-HIGH",
        category="PROMO",
        limit=100,
        offset=50,
        tie_break=("vendor", "annual_cost", "overall_score"),
    )
    return page.withColumn("received_on", F.date_format("received_at", "yyyy-MM-dd")).drop("received_at")


@query(
    "p01_browse_counts",
    """SELECT source, count(*) AS n, source = '2-HIGH' AS selected FROM evals WHERE category = 'PROMO' GROUP BY source""",
    ("evals",),
)
def browse_counts(spark, sf):
    return scores.browse_counts(bridge.evals(spark, sf, "source", "category"), source="2-HIGH", category="PROMO")


@query(
    "a24_peer_benchmark",
    f"""SELECT industry, count(*) AS total_contributions, count(DISTINCT vendor) AS unique_vendors, {R('avg(overall_score)')} AS avg_score
 FROM evals GROUP BY industry""",
    ("evals",),
)
def peer_benchmark(spark, sf):
    out = scores.peer_benchmark(bridge.evals(spark, sf, "industry", "vendor", "overall_score"))
    return rounded(out, "avg_score")


@query(
    "a27_top_vendors",
    "SELECT vendor, count(*) AS count FROM evals GROUP BY vendor ORDER BY count(*) DESC, vendor LIMIT 20",
    ("evals",),
)
def top_vendors(spark, sf):
    return scores.top_counts(bridge.evals(spark, sf, "vendor"), "vendor", 20)


@query(
    "a27_top_categories",
    "SELECT category, count(*) AS count FROM evals GROUP BY category ORDER BY count(*) DESC, category LIMIT 20",
    ("evals",),
)
def top_categories(spark, sf):
    return scores.top_counts(bridge.evals(spark, sf, "category"), "category", 20)
