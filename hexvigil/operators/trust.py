"""Contributor credibility, robust averages and poisoning bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexvigil import dims
from hexvigil.functions.noise import laplace, uniform
from hexvigil.functions.prefix import median_mad_of_counts
from hexvigil.session import cut_lineage

TRUST_THRESHOLD = 0.4
DEFAULT_CREDIBILITY = 0.15


def _names(col: str | Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def behavioural_profiles(contributions: DataFrame, requests: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """One profile per participant from both logs.

    ``contributions(participant, contrib_type, vendor, integration, ts)``,
    ``requests(participant, query_type, vendor, ts)``, optional
    ``matches(participant, iocs_matched, techniques_corroborated)``.  The sets hold
    dictionary names; rows are counted per name by hash before the sets are collected.
    """
    span = [F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1")]
    vendor = F.lower("vendor").alias("vendor")
    given = contributions.groupBy("participant", "contrib_type", vendor, "integration").agg(*span)
    gave = given.groupBy("participant").agg(
        F.collect_set("contrib_type").alias("contribution_types"),
        F.collect_set("vendor").alias("contributed_vendors"),
        F.collect_set("integration").alias("integration_sources"),
        F.sum("n").alias("__nc"),
        F.min("t0").alias("__c0"),
        F.max("t1").alias("__c1"),
    )
    wanted = requests.groupBy("participant", "query_type", vendor).agg(*span)
    asked = wanted.groupBy("participant").agg(
        F.collect_set("query_type").alias("query_types"),
        F.collect_set("vendor").alias("queried_vendors"),
        F.sum("n").alias("__nq"),
        F.min("t0").alias("__q0"),
        F.max("t1").alias("__q1"),
    )
    zero = F.lit(0)
    out = gave.join(asked, "participant", "full_outer").select(
        "participant",
        *[
            F.sort_array(_names(c)).alias(c)
            for c in (
                "contribution_types",
                "contributed_vendors",
                "integration_sources",
                "query_types",
                "queried_vendors",
            )
        ],
        F.coalesce("__nc", zero).alias("total_contributions"),
        F.coalesce("__nq", zero).alias("total_queries"),
        F.least("__c0", "__q0").alias("first_seen"),
        F.greatest("__c1", "__q1").alias("last_seen"),
    )
    if matches is None:
        return out.withColumns({"iocs_matched": zero, "techniques_corroborated": zero})
    return out.join(matches, "participant", "left").na.fill(0, ["iocs_matched", "techniques_corroborated"])


def alignment(contributed: Column | str, queried: Column | str) -> Column:
    """Jaccard of contributed and queried vendors; 0 when both are empty."""
    union = F.size(F.array_union(contributed, queried))
    return F.when(union > 0, F.size(F.array_intersect(contributed, queried)) / union).otherwise(0.0)


def features() -> dict[str, Column]:
    """Six features in [0, 1] of a profile row."""
    days = (F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / (
        86400 * 1e6
    )
    one = F.lit(1.0)
    return {
        "f_query_diversity": F.least(one, F.size("query_types") / 8),
        "f_contribution_diversity": F.least(one, F.size("contribution_types") / 3),
        "f_temporal_spread": F.coalesce(F.least(one, days / 180), F.lit(0.0)),
        "f_alignment": alignment("contributed_vendors", "queried_vendors"),
        "f_integration": F.when(F.size("integration_sources") > 0, 1.0).otherwise(0.0),
        "f_corroboration": F.least(one, (F.col("iocs_matched") + F.col("techniques_corroborated")) / 10),
    }


def squash(raw: Column, steepness: float = 8.0, centre: float = 0.4) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 / (1 + F.exp(-steepness * (raw - centre)))))


def credibility(profiles: DataFrame, epsilon: float | None = None, secret: str = "", digits: int | None = 3) -> DataFrame:
    """C4: weighted features, squashed to [0.05, 0.95].

    With ``epsilon`` each feature gets Laplace noise of scale 1/epsilon, drawn from
    the participant and ``secret`` so a retried task draws the same noise.
    """
    with_f = profiles.withColumns(features())
    raw = F.lit(0.0)
    for name, weight in zip(features(), dims.FEATURE_WEIGHTS):
        value = F.col(name)
        if epsilon is not None:
            u = uniform(secret, F.col("participant").cast("string"), F.lit(name))
            value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), laplace(value, 1.0, epsilon, u)))
        raw = raw + weight * value
    weight = squash(raw)
    return with_f.withColumn("weight", weight if digits is None else F.round(weight, digits))


def decay(weight: Column, as_of: Column, last_seen: Column, half_life_days: float = 90.0) -> Column:
    """Weight halves every ``half_life_days`` without activity."""
    return weight * F.pow(F.lit(2.0), -F.greatest(F.date_diff(as_of, last_seen), F.lit(0)) / half_life_days)


def outlier_weight(
    value: Column, median: Column, mad: Column, weight: Column, threshold: float = TRUST_THRESHOLD
) -> Column:
    """Untrusted values more than two MADs off fade exponentially; trusted ones are kept.

    The comparisons leave room for the rounding of binary fractions.
    """
    distance = F.abs(value - median)
    inside = distance <= 2.0 * mad + 1e-9
    return F.when((mad <= 1e-12) | inside | (weight >= threshold), weight).otherwise(
        weight * F.exp(-(distance / mad) / 2.0)
    )


def robust_aggregate(
    values: DataFrame,
    weights: DataFrame,
    keys: list[str],
    value: str,
    lo: float | None = None,
    hi: float | None = None,
    default_weight: float = DEFAULT_CREDIBILITY,
) -> DataFrame:
    """Credibility-weighted average per group beside the plain one.

    ``values(participant, *keys, value)``, ``weights(participant, weight)``.  Equal
    (group, participant, value) rows are counted before they are joined, and median
    and MAD come from bucketed counts, so a group with a third of all rows is never
    sorted in one task.
    """
    present = values.where(F.col(value).isNotNull())
    cells = cut_lineage(present.groupBy(*keys, "participant", value).agg(F.count("*").alias("__n")))
    centre = median_mad_of_counts(cells.groupBy(*keys, value).agg(F.sum("__n").alias("n")), keys, value, lo, hi)
    base = F.coalesce("weight", F.lit(default_weight))
    rows = (
        cells.join(weights.select("participant", "weight"), "participant", "left")
        .withColumn("weight", base)
        .join(centre, keys)
    )
    n, x = F.col("__n"), F.col(value)
    w = outlier_weight(x, F.col("median"), F.col("mad"), F.col("weight"))
    total_w = F.sum(n * w)
    plain = F.sum(n * x) / F.sum(n)
    out = rows.groupBy(*keys).agg(
        F.when(total_w == 0, plain).otherwise(F.sum(n * w * x) / total_w).alias("aggregate"),
        plain.alias("simple_average"),
        F.sum("__n").alias("n_contributors"),
        F.sum(F.when(F.col("weight") >= TRUST_THRESHOLD, n).otherwise(0)).alias("n_trusted"),
        F.sum(F.when(F.col("weight") < TRUST_THRESHOLD, n).otherwise(0)).alias("n_untrusted"),
        F.first("median").alias("median"),
        F.first("mad").alias("mad"),
    )
    return out.withColumn("shift", F.abs(F.col("aggregate") - F.col("simple_average")))


def weighted_average(values: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """C6, simple form: sum(w x) / sum(w), null where the weights sum to nothing."""
    total = F.sum(weight)
    return values.groupBy(*keys).agg(
        F.when(total != 0, F.sum(F.col(value) * F.col(weight)) / total).alias("weighted_average"),
        F.count("*").alias("n"),
    )


def rule_score(profile: DataFrame) -> DataFrame:
    """Score and tier by fixed rules over usage counters."""
    used = sum(
        (
            F.when(F.col(c) > 0, 1).otherwise(0)
            for c in (
                "ioc_bundles",
                "attack_maps",
                "tool_evals",
                "threat_models_run",
                "simulations_run",
                "reports_requested",
            )
        ),
        F.lit(0),
    )
    n = F.col("total_contributions")
    days = F.date_diff("last_contribution", "first_contribution")
    matched = F.col("iocs_matched")
    score = (
        F.least(F.lit(0.35), used * 0.07)
        + F.when(F.col("integration_source"), 0.25).otherwise(0.0)
        + F.when(n >= 10, 0.15).when(n >= 5, 0.10).when(n >= 2, 0.05).otherwise(0.0)
        + F.when(days >= 90, 0.10).when(days >= 30, 0.05).otherwise(0.0)
        + F.when(matched >= 5, 0.10).when(matched >= 1, 0.05).otherwise(0.0)
        + F.when(F.col("techniques_corroborated") >= 3, 0.05).otherwise(0.0)
    )
    scored = profile.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score + 1e-9)), 2))
    s = F.col("score")
    tier = F.when(s >= 0.7, "trusted").when(s >= 0.4, "established").when(s >= 0.15, "new").otherwise("unverified")
    return scored.withColumn("tier", tier)


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def poisoning_signals(evals: DataFrame) -> DataFrame:
    """Suspicious evaluations with their reasons; two reasons make a high risk."""
    score = F.col("overall_score")
    named = ~_blank("vendor")
    reasons = F.array_compact(
        F.array(
            F.when((score <= 1.0) | (score >= 9.9), "extreme_score"),
            F.when(named & _blank("industry"), "missing_context"),
            F.when(named & _blank("top_strength") & _blank("top_friction"), "no_qualitative_data"),
        )
    )
    return (
        evals.withColumn("reasons", reasons)
        .where(F.size("reasons") > 0)
        .withColumn("risk", F.when(F.size("reasons") >= 2, "high").otherwise("medium"))
    )


def poisoning_bound(
    rows: DataFrame, keys: list[str], max_deviation: float, value_range: float = 10.0, mad: DataFrame | None = None
) -> DataFrame:
    """What each contributor alone could move its group by, in percent of the value range.

    Group totals are aggregated and joined back; with ``mad(*keys, mad)`` the bound of
    untrusted contributors shrinks by the outlier rule.
    """
    totals = rows.groupBy(*keys).agg(
        F.sum("weight").alias("total_weight"),
        F.count("*").alias("n_contributors"),
        F.sum(F.when(F.col("weight") >= TRUST_THRESHOLD, 1).otherwise(0)).alias("n_trusted"),
    )
    if mad is None:
        totals = totals.withColumn("mad", F.lit(None).cast("double"))
    else:
        totals = totals.join(mad.select(*keys, "mad"), keys, "left")
    w = F.col("weight")
    share = 100.0 * max_deviation / value_range / F.col("total_weight")
    suppressed = (F.col("mad") > 1e-12) & (w < TRUST_THRESHOLD)
    faded = w * F.exp(-(F.lit(max_deviation) / F.col("mad")) / 2.0)
    positive = F.col("total_weight") > 0
    return rows.join(totals, keys).withColumns(
        {
            "max_impact_pct": F.when(positive, w * share).otherwise(0.0),
            "effective_impact_pct": F.when(
                positive, F.when(suppressed, faded).otherwise(w) * share
            ).otherwise(0.0),
        }
    )


def collective_bound(
    rows: DataFrame, keys: list[str], max_deviation: float, value_range: float = 10.0, flag: str = "flagged"
) -> DataFrame:
    """C11: what all flagged contributors of a group together could move it by."""
    total = F.sum("weight")
    bad = F.sum(F.when(F.col(flag), F.col("weight")).otherwise(0.0))
    n_bad = F.sum(F.when(F.col(flag), 1).otherwise(0))
    return rows.groupBy(*keys).agg(
        F.when(total > 0, 100.0 * bad * max_deviation / value_range / total).otherwise(0.0).alias("collective_impact_pct"),
        bad.alias("poisoner_total_weight"),
        (total - bad).alias("honest_total_weight"),
        n_bad.alias("n_poisoners"),
        (F.count("*") - n_bad).alias("n_honest"),
        F.when(total > bad, bad / (total - bad)).alias("weight_ratio"),
    )


def credibility_stats(weights: DataFrame) -> DataFrame:
    """Platform-wide distribution of the weights."""
    w = F.col("weight")

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return weights.agg(
        F.count("*").alias("total_profiles"),
        F.avg("weight").alias("avg_credibility"),
        n(w >= TRUST_THRESHOLD).alias("trusted_count"),
        n(w < TRUST_THRESHOLD).alias("untrusted_count"),
        n(w >= 0.7).alias("high"),
        n((w >= 0.4) & (w < 0.7)).alias("medium"),
        n(w < 0.4).alias("low"),
    )


def usage_counts(contributions: DataFrame, served: DataFrame, keys: list[str]) -> DataFrame:
    """C14: how often each contribution went into an aggregate that was served.

    The served log is counted per aggregate before it meets the contributions.
    """
    counted = served.groupBy(*keys).agg(F.count("*").alias("usage_count"))
    return contributions.join(counted, keys, "left").withColumn(
        "usage_count", F.coalesce("usage_count", F.lit(0))
    )
