"""Credibility, robust averages and poisoning bounds over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexvigil import bridge
from hexvigil.functions.prefix import exact_median_mad, median_mad_of_counts
from hexvigil.operators import trust
from hexvigil.plans.registry import R, query, rounded
from hexvigil.session import stored


def contributions(spark, sf):
    e = bridge.evals(spark, sf, "submitter", "deploy_days", "vendor", "source", "received_at")
    return e.select(
        F.col("submitter").alias("participant"),
        F.expr("CASE deploy_days % 3 WHEN 0 THEN 'eval' WHEN 1 THEN 'attack_map' ELSE 'ioc_bundle' END").alias(
            "contrib_type"
        ),
        "vendor",
        F.when(F.col("source") == "1-URGENT", "siem").alias("integration"),
        F.col("received_at").alias("ts"),
    )


def requests(spark, sf):
    vendor = F.concat(F.lit("Supplier#"), F.lpad((F.floor("value") % 100).cast("string"), 9, "0"))
    return bridge.request_log(spark, sf).select(
        F.col("user_id").alias("participant"), F.col("endpoint").alias("query_type"), vendor.alias("vendor"), "ts"
    )


def matches(spark, sf):
    return bridge.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("participant"),
        (F.col("c_nationkey") % 12).alias("iocs_matched"),
        (F.col("c_nationkey") % 5).alias("techniques_corroborated"),
    )


def profiles(spark, sf):
    return trust.behavioural_profiles(contributions(spark, sf), requests(spark, sf), matches(spark, sf))


PROFILE_SQL = """SELECT coalesce(c.participant, q.participant) AS participant, coalesce(ct, []) AS ct, coalesce(cv, []) AS cv, coalesce(ig, []) AS ig,
 coalesce(qt, []) AS qt, coalesce(qv, []) AS qv, coalesce(nc, 0) AS nc, coalesce(nq, 0) AS nq, least(c0, q0) AS first_seen, greatest(c1, q1) AS last_seen,
 coalesce(c_nationkey % 12, 0) AS im, coalesce(c_nationkey % 5, 0) AS tc FROM
 (SELECT submitter AS participant, list(DISTINCT CASE deploy_days % 3 WHEN 0 THEN 'eval' WHEN 1 THEN 'attack_map' ELSE 'ioc_bundle' END) AS ct, list(DISTINCT lower(vendor)) AS cv,
  coalesce(list(DISTINCT 'siem') FILTER (source = '1-URGENT'), []) AS ig, count(*) AS nc, min(received_at) AS c0, max(received_at) AS c1 FROM evals GROUP BY 1) c
 FULL OUTER JOIN (SELECT user_id AS participant, list(DISTINCT endpoint) AS qt, list(DISTINCT concat('supplier#', lpad(CAST(CAST(floor(value) AS BIGINT) % 100 AS VARCHAR), 9, '0'))) AS qv,
  count(*) AS nq, min(ts) AS q0, max(ts) AS q1 FROM request_log GROUP BY 1) q ON q.participant = c.participant
 LEFT JOIN customer ON c_custkey = coalesce(c.participant, q.participant)"""
FEATURE_SQL = f"""SELECT *, least(1.0, len(qt) / 8) AS f1, least(1.0, len(ct) / 3) AS f2,
 least(1.0, (epoch_us(last_seen) - epoch_us(first_seen)) / (86400 * 1e6) / 180) AS f3,
 CASE WHEN len(list_distinct(list_concat(cv, qv))) > 0 THEN len(list_intersect(cv, qv)) / len(list_distinct(list_concat(cv, qv))) ELSE 0 END AS f4,
 CASE WHEN len(ig) > 0 THEN 1.0 ELSE 0 END AS f5, least(1.0, (im + tc) / 10) AS f6 FROM ({PROFILE_SQL})"""
WEIGHT_SQL = f"""SELECT participant, greatest(0.05, least(0.95, 1 / (1 + exp(-8.0 * (0.10 * f1 + 0.10 * f2 + 0.10 * f3 + 0.30 * f4 + 0.25 * f5 + 0.15 * f6 - 0.4))))) AS weight, f1, f2, f3, f4, f5, f6, first_seen, last_seen FROM ({FEATURE_SQL})"""
VIEWS = ("evals", "request_log")


def weights(spark, sf):
    return trust.credibility(profiles(spark, sf), digits=None)


@query(
    "c01_profiles",
    f"""SELECT participant, array_to_string(list_sort(ct), ',') AS contribution_types, array_to_string(list_sort(cv), ',') AS contributed_vendors,
 array_to_string(ig, ',') AS integration_sources, array_to_string(list_sort(qt), ',') AS query_types, array_to_string(list_sort(qv), ',') AS queried_vendors,
 nc AS total_contributions, nq AS total_queries, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen,
 im AS iocs_matched, tc AS techniques_corroborated FROM ({PROFILE_SQL})""",
    VIEWS,
)
def profile_rows(spark, sf):
    lists = ["contribution_types", "contributed_vendors", "integration_sources", "query_types", "queried_vendors"]
    times = ["first_seen", "last_seen"]
    return profiles(spark, sf).withColumns(
        {c: F.array_join(c, ",") for c in lists} | {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times}
    )


@query(
    "c02_alignment",
    f"SELECT participant, {R('f4')} AS alignment FROM ({FEATURE_SQL})",
    VIEWS,
)
def alignment(spark, sf):
    out = profiles(spark, sf).select(
        "participant", trust.alignment("contributed_vendors", "queried_vendors").alias("alignment")
    )
    return rounded(out, "alignment")


@query(
    "c03_features",
    f"""SELECT participant, {R('f1')} AS f_query_diversity, {R('f2')} AS f_contribution_diversity, {R('f3')} AS f_temporal_spread, {R('f4')} AS f_alignment,
 {R('f5')} AS f_integration, {R('f6')} AS f_corroboration FROM ({FEATURE_SQL})""",
    VIEWS,
)
def features(spark, sf):
    out = profiles(spark, sf).withColumns(trust.features()).select("participant", *trust.features())
    return rounded(out, *trust.features())


@query("c04_credibility", f"SELECT participant, {R('weight')} AS weight FROM ({WEIGHT_SQL})", VIEWS)
def credibility(spark, sf):
    return rounded(weights(spark, sf).select("participant", "weight"), "weight")


MEDIAN_SQL = """m AS (SELECT vendor, category, median(overall_score) AS median FROM evals GROUP BY 1, 2),
 dv AS (SELECT e.vendor, e.category, abs(overall_score - median) AS dev, row_number() OVER (PARTITION BY e.vendor, e.category ORDER BY abs(overall_score - median)) AS rn,
  count(*) OVER (PARTITION BY e.vendor, e.category) AS n FROM evals e JOIN m ON m.vendor = e.vendor AND m.category = e.category),
 md AS (SELECT m.vendor, m.category, median, dev AS mad FROM m JOIN dv ON dv.vendor = m.vendor AND dv.category = m.category AND rn = n // 2 + 1)"""


@query(
    "w03_median_mad",
    f"WITH {MEDIAN_SQL} SELECT vendor, category, {R('median')} AS median, {R('mad')} AS mad FROM md",
    ("evals",),
)
def median_mad(spark, sf):
    e = bridge.evals(spark, sf, "vendor", "category", "overall_score")
    return rounded(exact_median_mad(e, ["vendor", "category"], "overall_score", 0.0, 10.0), "median", "mad")


@query(
    "w03_category_median_mad",
    f"""WITH m AS (SELECT category, median(annual_cost) AS median FROM evals GROUP BY 1),
 dv AS (SELECT e.category, abs(annual_cost - median) AS dev, row_number() OVER (PARTITION BY e.category ORDER BY abs(annual_cost - median)) AS rn, count(*) OVER (PARTITION BY e.category) AS n
  FROM evals e JOIN m ON m.category = e.category)
 SELECT m.category, {R('median')} AS median, {R('dev')} AS mad FROM m JOIN dv ON dv.category = m.category AND rn = n // 2 + 1""",
    ("evals",),
)
def category_median_mad(spark, sf):
    e = bridge.evals(spark, sf, "category", "annual_cost")
    return rounded(exact_median_mad(e, ["category"], "annual_cost"), "median", "mad")


OUTLIER_SQL = f"""w AS ({WEIGHT_SQL}), {MEDIAN_SQL},
 r AS (SELECT e.vendor, e.category, e.submitter, overall_score AS x, w.weight AS w0, median, mad,
  CASE WHEN mad <= 1e-12 OR abs(overall_score - median) <= 2.0 * mad + 1e-9 OR w.weight >= 0.4 THEN w.weight ELSE w.weight * exp(-(abs(overall_score - median) / mad) / 2.0) END AS w1
  FROM evals e JOIN w ON w.participant = e.submitter JOIN md ON md.vendor = e.vendor AND md.category = e.category)"""


@query(
    "c05_outlier_weight",
    f"""WITH {OUTLIER_SQL} SELECT vendor, category, submitter, {R('x')} AS overall_score, count(*) AS n, {R('any_value(w0)')} AS base_weight, {R('any_value(w1)')} AS weight
 FROM r GROUP BY vendor, category, submitter, x""",
    VIEWS,
)
def outlier_weight(spark, sf):
    e = bridge.evals(spark, sf, "submitter", "vendor", "category", "overall_score")
    cells = stored(e.groupBy("vendor", "category", "submitter", "overall_score").agg(F.count("*").alias("n")), "cells")
    counts = cells.where("overall_score is not null").groupBy("vendor", "category", "overall_score").agg(F.sum("n").alias("n"))
    centre = median_mad_of_counts(counts, ["vendor", "category"], "overall_score", 0.0, 10.0)
    w = weights(spark, sf).select(F.col("participant").alias("submitter"), F.col("weight").alias("base_weight"))
    out = (
        cells.join(centre, ["vendor", "category"])
        .join(w, "submitter")
        .withColumn(
            "weight",
            trust.outlier_weight(F.col("overall_score"), F.col("median"), F.col("mad"), F.col("base_weight")),
        )
        .drop("median", "mad")
    )
    return rounded(out, "overall_score", "base_weight", "weight")


@query(
    "c06_robust_aggregate",
    f"""WITH {OUTLIER_SQL} SELECT vendor, category, {R('sum(w1 * x) / sum(w1)')} AS aggregate, {R('avg(x)')} AS simple_average, count(*) AS n_contributors,
 count(*) FILTER (w0 >= 0.4) AS n_trusted, count(*) FILTER (w0 < 0.4) AS n_untrusted, {R('any_value(median)')} AS median, {R('any_value(mad)')} AS mad,
 {R('abs(sum(w1 * x) / sum(w1) - avg(x))')} AS shift FROM r GROUP BY vendor, category""",
    VIEWS,
)
def robust_aggregate(spark, sf):
    e = bridge.evals(spark, sf, "submitter", "vendor", "category", "overall_score")
    out = trust.robust_aggregate(
        e.withColumnRenamed("submitter", "participant"),
        weights(spark, sf),
        ["vendor", "category"],
        "overall_score",
        0.0,
        10.0,
    )
    return rounded(out, "aggregate", "simple_average", "median", "mad", "shift")


@query(
    "c06_weighted_average",
    f"""WITH w AS ({WEIGHT_SQL}) SELECT vendor, {R('sum(overall_score * weight) / sum(weight)')} AS weighted_average, count(*) AS n FROM evals JOIN w ON w.participant = submitter GROUP BY vendor""",
    VIEWS,
)
def weighted_average(spark, sf):
    e = bridge.evals(spark, sf, "submitter", "vendor", "overall_score")
    w = weights(spark, sf).select(F.col("participant").alias("submitter"), "weight")
    return rounded(trust.weighted_average(e.join(w, "submitter"), ["vendor"], "overall_score"), "weighted_average")


@query(
    "c07_decay",
    f"""SELECT participant, {R("weight * pow(2.0, -greatest(date_diff('day', CAST(last_seen AS DATE), DATE '2024-06-30'), 0) / 90.0)")} AS weight FROM ({WEIGHT_SQL})""",
    VIEWS,
)
def decayed(spark, sf):
    out = weights(spark, sf).select(
        "participant",
        trust.decay(F.col("weight"), F.lit("2024-06-30").cast("date"), F.col("last_seen")).alias("weight"),
    )
    return rounded(out, "weight")


@query(
    "c08_rule_score",
    """WITH p AS (SELECT submitter AS participant, count(*) FILTER (deploy_days % 3 = 2) AS ib, count(*) FILTER (deploy_days % 3 = 1) AS am, count(*) FILTER (deploy_days % 3 = 0) AS te,
  count(*) FILTER (source = '2-HIGH' AND would_buy) AS tm, count(*) FILTER (chose_this_vendor AND overall_score > 9.5) AS si, count(*) FILTER (fp_rate > 7) AS rr,
  coalesce(bool_or(source = '1-URGENT' AND overall_score > 8), false) AS ig, count(*) AS n, min(received_at) AS c0, max(received_at) AS c1, max(c_nationkey % 12) AS im, max(c_nationkey % 5) AS tc
  FROM evals JOIN customer ON c_custkey = submitter GROUP BY 1),
 s AS (SELECT *, round(least(1.0, greatest(0.0, least(0.35, 0.07 * (CAST(ib > 0 AS INT) + CAST(am > 0 AS INT) + CAST(te > 0 AS INT) + CAST(tm > 0 AS INT) + CAST(si > 0 AS INT) + CAST(rr > 0 AS INT)))
  + CASE WHEN ig THEN 0.25 ELSE 0 END + CASE WHEN n >= 10 THEN 0.15 WHEN n >= 5 THEN 0.10 WHEN n >= 2 THEN 0.05 ELSE 0 END
  + CASE WHEN date_diff('day', CAST(c0 AS DATE), CAST(c1 AS DATE)) >= 90 THEN 0.10 WHEN date_diff('day', CAST(c0 AS DATE), CAST(c1 AS DATE)) >= 30 THEN 0.05 ELSE 0 END
  + CASE WHEN im >= 5 THEN 0.10 WHEN im >= 1 THEN 0.05 ELSE 0 END + CASE WHEN tc >= 3 THEN 0.05 ELSE 0 END + 1e-9)), 2) AS score FROM p)
 SELECT participant, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.7 THEN 'trusted' WHEN score >= 0.4 THEN 'established' WHEN score >= 0.15 THEN 'new' ELSE 'unverified' END AS tier FROM s""",
    ("evals",),
)
def rule_score(spark, sf):
    e = bridge.evals(
        spark, sf, "submitter", "deploy_days", "source", "would_buy", "chose_this_vendor", "overall_score", "fp_rate",
        "received_at",
    )

    def n(cond):
        return F.count(F.when(F.expr(cond), 1))

    counters = e.groupBy(F.col("submitter").alias("participant")).agg(
        n("deploy_days % 3 = 2").alias("ioc_bundles"),
        n("deploy_days % 3 = 1").alias("attack_maps"),
        n("deploy_days % 3 = 0").alias("tool_evals"),
        n("source = '2-HIGH' AND would_buy").alias("threat_models_run"),
        n("chose_this_vendor AND overall_score > 9.5").alias("simulations_run"),
        n("fp_rate > 7").alias("reports_requested"),
        (n("source = '1-URGENT' AND overall_score > 8") > 0).alias("integration_source"),
        F.count("*").alias("total_contributions"),
        F.min("received_at").alias("first_contribution"),
        F.max("received_at").alias("last_contribution"),
    )
    return trust.rule_score(counters.join(matches(spark, sf), "participant")).select("participant", "score", "tier")


SIGNAL_SQL = """SELECT vendor, overall_score, concat_ws(',', CASE WHEN overall_score <= 1.0 OR overall_score >= 9.9 THEN 'extreme_score' END,
 CASE WHEN industry IS NULL OR industry = '' THEN 'missing_context' END, CASE WHEN coalesce(top_strength, '') = '' AND coalesce(top_friction, '') = '' THEN 'no_qualitative_data' END) AS reasons
 FROM (SELECT vendor, overall_score, CASE WHEN industry <> 'BUILDING' THEN industry END AS industry, CASE WHEN would_buy THEN 'fast' END AS top_strength, CASE WHEN chose_this_vendor THEN 'cost' ELSE '' END AS top_friction FROM evals)"""


@query(
    "c09_poisoning_signals",
    f"""SELECT vendor, {R('overall_score')} AS overall_score, reasons, CASE WHEN reasons LIKE '%,%' THEN 'high' ELSE 'medium' END AS risk, count(*) AS n FROM ({SIGNAL_SQL}) WHERE reasons <> '' GROUP BY ALL""",
    ("evals",),
)
def poisoning_signals(spark, sf):
    e = bridge.evals(spark, sf, "vendor", "overall_score", "industry", "would_buy", "chose_this_vendor").select(
        "vendor",
        "overall_score",
        F.when(F.col("industry") != "BUILDING", F.col("industry")).alias("industry"),
        F.when(F.col("would_buy"), "fast").alias("top_strength"),
        F.when(F.col("chose_this_vendor"), "cost").otherwise("").alias("top_friction"),
    )
    out = trust.poisoning_signals(e).withColumn("reasons", F.array_join("reasons", ","))
    return rounded(out, "overall_score").groupBy("vendor", "overall_score", "reasons", "risk").agg(
        F.count("*").alias("n")
    )


# One row per (vendor, submitter): the contributor's weight in the vendor's group.
GROUP_SQL = f"g AS (SELECT DISTINCT vendor, submitter, weight FROM evals JOIN ({WEIGHT_SQL}) w ON w.participant = submitter)"


def group_rows(spark, sf):
    w = weights(spark, sf).select(F.col("participant").alias("submitter"), "weight")
    return bridge.evals(spark, sf, "vendor", "submitter").distinct().join(w, "submitter")


@query(
    "c10_poisoning_bound",
    f"""WITH {GROUP_SQL}, m AS (SELECT vendor, median(overall_score) AS median FROM evals GROUP BY 1),
 dv AS (SELECT e.vendor, abs(overall_score - median) AS dev, row_number() OVER (PARTITION BY e.vendor ORDER BY abs(overall_score - median)) AS rn, count(*) OVER (PARTITION BY e.vendor) AS n FROM evals e JOIN m ON m.vendor = e.vendor),
 md AS (SELECT vendor, dev AS mad FROM dv WHERE rn = n // 2 + 1),
 t AS (SELECT vendor, sum(weight) AS tw, count(*) AS n_contributors, count(*) FILTER (weight >= 0.4) AS n_trusted FROM g GROUP BY 1)
 SELECT g.vendor, g.submitter, {R('weight')} AS weight, n_contributors, n_trusted, {R('weight * 8.0 / tw / 10.0 * 100')} AS max_impact_pct,
 {R('CASE WHEN mad > 1e-12 AND weight < 0.4 THEN weight * exp(-(8.0 / mad) / 2.0) ELSE weight END * 8.0 / tw / 10.0 * 100')} AS effective_impact_pct
 FROM g JOIN t ON t.vendor = g.vendor JOIN md ON md.vendor = g.vendor""",
    VIEWS,
)
def poisoning_bound(spark, sf):
    mad = exact_median_mad(bridge.evals(spark, sf, "vendor", "overall_score"), ["vendor"], "overall_score", 0.0, 10.0)
    out = trust.poisoning_bound(group_rows(spark, sf), ["vendor"], 8.0, 10.0, mad)
    return rounded(out, "weight", "max_impact_pct", "effective_impact_pct").select(
        "vendor", "submitter", "weight", "n_contributors", "n_trusted", "max_impact_pct", "effective_impact_pct"
    )


@query(
    "c11_collective_bound",
    f"""WITH {GROUP_SQL}, f AS (SELECT *, submitter % 7 = 0 AS flagged FROM g)
 SELECT vendor, {R('100.0 * sum(weight) FILTER (flagged) * 10.0 / 10.0 / sum(weight)')} AS collective_impact_pct, {R('sum(weight) FILTER (flagged)')} AS poisoner_total_weight,
 {R('sum(weight) FILTER (NOT flagged)')} AS honest_total_weight, count(*) FILTER (flagged) AS n_poisoners, count(*) FILTER (NOT flagged) AS n_honest,
 {R('sum(weight) FILTER (flagged) / sum(weight) FILTER (NOT flagged)')} AS weight_ratio FROM f GROUP BY vendor""",
    VIEWS,
)
def collective_bound(spark, sf):
    rows = group_rows(spark, sf).withColumn("flagged", F.col("submitter") % 7 == 0)
    out = trust.collective_bound(rows, ["vendor"], 10.0)
    return rounded(out, "collective_impact_pct", "poisoner_total_weight", "honest_total_weight", "weight_ratio")


@query(
    "c13_credibility_stats",
    f"""SELECT count(*) AS total_profiles, {R('avg(weight)')} AS avg_credibility, count(*) FILTER (weight >= 0.4) AS trusted_count, count(*) FILTER (weight < 0.4) AS untrusted_count,
 count(*) FILTER (weight >= 0.7) AS high, count(*) FILTER (weight >= 0.4 AND weight < 0.7) AS medium, count(*) FILTER (weight < 0.4) AS low FROM ({WEIGHT_SQL})""",
    VIEWS,
)
def credibility_stats(spark, sf):
    return rounded(trust.credibility_stats(weights(spark, sf)), "avg_credibility")


@query(
    "c14_usage_counts",
    """WITH s AS (SELECT concat('Supplier#', lpad(CAST(CAST(floor(value) AS BIGINT) % 100 AS VARCHAR), 9, '0')) AS vendor, count(*) AS n FROM request_log WHERE endpoint LIKE '/query%' GROUP BY 1)
 SELECT e.vendor, e.submitter, e.category, count(*) AS contributions, any_value(coalesce(s.n, 0)) AS usage_count FROM evals e LEFT JOIN s ON s.vendor = e.vendor GROUP BY 1, 2, 3""",
    VIEWS,
)
def usage_counts(spark, sf):
    served = requests(spark, sf).where(F.col("query_type").startswith("/query")).select("vendor")
    out = trust.usage_counts(bridge.evals(spark, sf, "vendor", "submitter", "category"), served, ["vendor"])
    return out.groupBy("vendor", "submitter", "category").agg(
        F.count("*").alias("contributions"), F.max("usage_count").alias("usage_count")
    )
