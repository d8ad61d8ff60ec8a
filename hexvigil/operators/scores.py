"""Vendor scores, rankings and market views over evaluation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexvigil import dims
from hexvigil.functions.prefix import cumulative_counts


def vendor_aggregate(evals: DataFrame, by: tuple[str, ...] = ("vendor", "category")) -> DataFrame:
    """A1: averages with nulls skipped; would-buy share of *all* evaluations of the group."""
    yes = F.sum(F.when(F.col("would_buy"), 1).otherwise(0))
    return evals.groupBy(*by).agg(
        F.avg("overall_score").alias("avg_score"),
        F.avg("detection_rate").alias("avg_detection_rate"),
        F.avg("fp_rate").alias("avg_fp_rate"),
        F.avg("deploy_days").alias("avg_deploy_days"),
        F.count("*").alias("contribution_count"),
        (100.0 * yes / F.count("*")).alias("would_buy_pct_all"),
    )


def min_k(df: DataFrame, k: int = 3, count_col: str = "contribution_count", report: bool = False) -> DataFrame:
    """Keep groups of at least ``k``; with ``report`` keep all and flag the small ones."""
    if report:
        return df.withColumn("suppressed", F.col(count_col) < k)
    return df.where(F.col(count_col) >= k)


def field_aggregate(evals: DataFrame, by: tuple[str, ...], numeric: list[str], boolean: list[str]) -> DataFrame:
    """A2: average of every numeric field, share of true among the *answered* booleans."""
    aggs: list[Column] = [F.count("*").alias("contributor_count")]
    aggs += [F.avg(c).alias(f"avg_{c}") for c in numeric]
    aggs += [
        (100.0 * F.sum(F.when(F.col(c), 1).otherwise(0)) / F.count(c)).alias(f"{c}_pct_answered") for c in boolean
    ]
    return evals.groupBy(*by).agg(*aggs)


def present_fields(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """The known numeric, boolean and categorical fields that a frame carries."""
    have = set(df.columns)
    return (
        [c for c in dims.NUMERIC_FIELDS if c in have],
        [c for c in dims.BOOL_FIELDS if c in have],
        [c for c in dims.CATEGORICAL_FIELDS if c in have],
    )


def categorical_counts(df: DataFrame, by: tuple[str, ...], fields: list[str]) -> DataFrame:
    """A2: long (group, field, value, n) counts of the categorical fields."""
    typed = df.select(*by, *[F.col(f).cast("string").alias(f) for f in fields])
    return (
        typed.unpivot(list(by), fields, "field", "value")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "field", "value")
        .agg(F.count("*").alias("n"))
    )


def category_average(vendor_scores: DataFrame) -> DataFrame:
    """A3: average over vendors of the vendor averages."""
    return vendor_scores.groupBy("category").agg(
        F.avg("avg_score").alias("category_avg"), F.count("*").alias("vendor_count")
    )


def weighted_score(
    evals: DataFrame, weights: DataFrame, by: tuple[str, ...] = ("vendor",), aliases: DataFrame | None = None
) -> DataFrame:
    """A4: sum(score * w(source)) / sum(w); unknown sources weigh 1.

    ``aliases(alias, source)`` maps feed spellings to the weighted name; leave it
    out for the literal behaviour.
    """
    scored = evals.where(F.col("overall_score").isNotNull())
    if aliases is not None:
        scored = (
            scored.join(aliases.select("alias", F.col("source").alias("__to")), scored.source == F.col("alias"), "left")
            .withColumn("source", F.coalesce("__to", "source"))
            .drop("alias", "__to")
        )
    per_source = scored.groupBy(*by, "source").agg(F.sum("overall_score").alias("__s"), F.count("*").alias("__n"))
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    return (
        per_source.join(weights, "source", "left")
        .groupBy(*by)
        .agg(
            (F.sum(F.col("__s") * w) / F.sum(F.col("__n") * w)).alias("weighted_score"),
            F.sum("__n").alias("eval_count"),
            F.count("source").alias("source_count"),
        )
    )


def confidence(eval_count: Column, source_count: Column) -> Column:
    """A5: tier from evaluation and source counts."""
    return (
        F.when((eval_count >= 8) & (source_count >= 5), "high")
        .when((eval_count >= 4) & (source_count >= 3), "medium")
        .when(eval_count >= 3, "low")
        .otherwise("insufficient")
    )


def vendor_confidence(evals: DataFrame, by: tuple[str, ...] = ("vendor",)) -> DataFrame:
    per_source = evals.groupBy(*by, "source").agg(F.count("*").alias("__n"))
    return (
        per_source.groupBy(*by)
        .agg(F.sum("__n").alias("eval_count"), F.count("source").alias("source_count"))
        .withColumn("confidence", confidence(F.col("eval_count"), F.col("source_count")))
    )


def category_listing(registry: DataFrame, measured: DataFrame) -> DataFrame:
    """Registry rows and measured (vendor, category) rows side by side, whichever exists."""
    reg = registry.select(
        F.col("vendor_id").alias("__v"), F.col("category").alias("__c"), F.col("display_name").alias("__d")
    )
    joined = measured.join(reg, (measured.vendor == F.col("__v")) & (measured.category == F.col("__c")), "full_outer")
    names = registry.select(F.col("vendor_id").alias("__nv"), F.col("display_name").alias("__nd"))
    vendor = F.coalesce("vendor", "__v")
    out = joined.withColumn("vendor_id", vendor).join(names, F.col("vendor_id") == F.col("__nv"), "left")
    return out.select(
        "vendor_id",
        F.coalesce("category", "__c").alias("category"),
        F.coalesce("__nd", F.initcap(F.replace("vendor_id", F.lit("-"), F.lit(" ")))).alias("display"),
        F.col("avg_score"),
        F.coalesce("contribution_count", F.lit(0)).alias("eval_count"),
        F.coalesce("source_count", F.lit(0)).alias("source_count"),
        F.col("__v").isNotNull().alias("in_registry"),
    )


def market_map(listing: DataFrame) -> DataFrame:
    """Leader / contender / emerging / watch.  A score above 8 without high confidence is no contender."""
    conf = confidence(F.col("eval_count"), F.col("source_count"))
    tier = (
        F.when((F.col("avg_score") > 8) & (conf == "high"), "leader")
        .when(F.col("avg_score").between(7, 8), "contender")
        .when(conf == "medium", "emerging")
        .otherwise("watch")
    )
    return listing.withColumns({"confidence": conf, "tier": tier})


def danger_radar(registry: DataFrame, scores: DataFrame) -> DataFrame:
    """Vendors with documented issues (+2) or no insurance carrier (+1)."""
    issue = F.trim(F.coalesce("known_issues", F.lit(""))) != ""
    uninsured = F.coalesce(F.size("insurance_carriers"), F.lit(0)) <= 0
    signals = F.array_compact(
        F.array(F.when(issue, F.lit("documented_issues")), F.when(uninsured, F.lit("no_insurance_carrier")))
    )
    return (
        registry.withColumns(
            {
                "danger_score": F.when(issue, 2).otherwise(0) + F.when(uninsured, 1).otherwise(0),
                "danger_signals": signals,
            }
        )
        .where(F.col("danger_score") > 0)
        .join(scores.withColumnRenamed("vendor", "__v"), F.col("vendor_id") == F.col("__v"), "left")
        .select(
            "vendor_id",
            "display_name",
            "category",
            "avg_score",
            F.coalesce("contribution_count", F.lit(0)).alias("eval_count"),
            "danger_score",
            "danger_signals",
        )
    )


def category_rank(vendor_scores: DataFrame, gaps: DataFrame) -> DataFrame:
    """1 + number of strictly better peers of the category, and the vendor's gap count."""
    ranked = Window.partitionBy("category").orderBy(F.col("avg_score").desc_nulls_last())
    peers = Window.partitionBy("category")
    return (
        vendor_scores.withColumns(
            {"category_rank": F.rank().over(ranked), "category_total": F.count("*").over(peers)}
        )
        .join(gaps.withColumnRenamed("vendor", "__v"), F.col("vendor") == F.col("__v"), "left")
        .drop("__v")
        .withColumn("gap_count", F.coalesce("gap_count", F.lit(0)))
    )


def my_position(evals: DataFrame, lo: float = 0.0, hi: float = 10.0) -> DataFrame:
    """Per (category, vendor, score): quarter position against the vendor average, and the true percent rank.

    The rank runs over counted distinct scores of a category, so its cost follows
    the number of distinct scores, not of evaluations.
    """
    per_score = evals.groupBy("category", "vendor", "overall_score").agg(F.count("*").alias("n_evals"))
    vendor_avg = (
        per_score.where(F.col("overall_score").isNotNull())
        .groupBy("category", "vendor")
        .agg(
            (F.sum(F.col("overall_score") * F.col("n_evals")) / F.sum("n_evals")).alias("vendor_avg"),
            F.sum("n_evals").alias("contributor_count"),
        )
    )
    cat_avg = vendor_avg.groupBy("category").agg(F.avg("vendor_avg").alias("category_avg"))
    cum = cumulative_counts(evals, ["category"], "overall_score", lo, hi)
    rank = cum.select(
        "category",
        "overall_score",
        F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.0).alias("percent_rank"),
    )
    position = (
        F.when(F.col("overall_score") > F.col("vendor_avg") + 1e-9, 75)
        .when(F.abs(F.col("overall_score") - F.col("vendor_avg")) <= 1e-9, 50)
        .otherwise(25)
    )
    return (
        per_score.where(F.col("overall_score").isNotNull())
        .join(vendor_avg, ["category", "vendor"])
        .join(cat_avg, "category")
        .join(rank, ["category", "overall_score"])
        .withColumn("position", position)
    )


def vendor_detail(
    registry: DataFrame,
    scores: DataFrame,
    confidence_rows: DataFrame,
    vendors: list[str] | None = None,
    weighted: DataFrame | None = None,
) -> DataFrame:
    """One profile row per vendor from registry and measurements (compare = two rows side by side).

    ``weighted(vendor, weighted_score)`` adds the source-weighted score.
    """
    s = scores.withColumnRenamed("vendor", "__sv")
    c = confidence_rows.select(F.col("vendor").alias("__cv"), "source_count", "confidence")
    base = registry if vendors is None else registry.where(F.col("vendor_id").isin(vendors))
    extra = []
    if weighted is not None:
        base = base.join(weighted.select(F.col("vendor").alias("vendor_id"), "weighted_score"), "vendor_id", "left")
        extra = ["weighted_score"]
    return (
        base.join(s, F.col("vendor_id") == F.col("__sv"), "left")
        .join(c, F.col("vendor_id") == F.col("__cv"), "left")
        .select(
            "vendor_id",
            "display_name",
            "category",
            F.coalesce("contribution_count", F.lit(0)).alias("eval_count"),
            "avg_score",
            "avg_detection_rate",
            "would_buy_pct_all",
            F.coalesce("source_count", F.lit(0)).alias("source_count"),
            F.coalesce("confidence", F.lit("insufficient")).alias("confidence"),
            "certifications",
            F.size("insurance_carriers").alias("carrier_count"),
            "compliance_frameworks",
            "known_issues",
            "typical_deploy_days",
            *extra,
        )
    )


def compare_vendors(detail: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(vendor_a, vendor_b)`` with both profiles in one row."""
    cols = ["display_name", "avg_score", "eval_count", "confidence"]
    a = detail.select(F.col("vendor_id").alias("vendor_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = detail.select(F.col("vendor_id").alias("vendor_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return (
        pairs.join(a, "vendor_a")
        .join(b, "vendor_b")
        .withColumn("score_difference", F.col("avg_score_a") - F.col("avg_score_b"))
    )


def rfp_comparison(registry: DataFrame, technique_map: DataFrame, requests: DataFrame) -> DataFrame:
    """Score, rank and runner-up of every candidate of every request.

    ``requests(request_id, vendor_id)``; candidates that are not registered come back with ``found`` false.
    """
    coverage = (
        technique_map.select(F.explode("primary_vendors").alias("__tv"), "technique_id")
        .distinct()
        .groupBy("__tv")
        .agg(F.count("*").alias("technique_coverage"))
    )
    carriers = F.size("insurance_carriers")
    issue = F.lower(F.coalesce("known_issues", F.lit("")))
    compliance = F.least(F.lit(100), F.size("compliance_frameworks") * 15 + F.size("certifications") * 8)
    insurance = F.when(carriers >= 4, 95).when(carriers >= 2, 75).when(carriers >= 1, 50).otherwise(20)
    risk = (
        F.when(issue == "", 95)
        .when(issue.contains("breach") | issue.contains("cve"), 40)
        .when(issue.contains("ban"), 25)
        .otherwise(60)
    )
    scored = (
        registry.join(coverage, F.col("vendor_id") == F.col("__tv"), "left")
        .withColumns(
            {
                "technique_coverage": F.coalesce("technique_coverage", F.lit(0)).cast("int"),
                "compliance_score": compliance.cast("int"),
                "insurance_score": insurance,
                "risk_score": risk,
            }
        )
        .withColumn(
            "overall",
            F.least(
                F.lit(100),
                F.floor(
                    F.col("technique_coverage") * 2
                    + F.col("compliance_score") * 0.3
                    + F.col("insurance_score") * 0.2
                    + F.col("risk_score") * 0.2
                    + F.lit(1e-9)
                ).cast("int"),
            ),
        )
        .select(
            F.col("vendor_id").alias("__id"),
            "display_name",
            "technique_coverage",
            "compliance_score",
            "insurance_score",
            "risk_score",
            "overall",
            "typical_deploy_days",
        )
    )
    wanted = requests.select("request_id", F.lower(F.trim("vendor_id")).alias("__key"), "vendor_id")
    joined = wanted.join(scored, F.col("__key") == F.lower("__id"), "left").withColumn("found", F.col("__id").isNotNull())
    order = Window.partitionBy("request_id").orderBy(F.col("overall").desc_nulls_last(), F.col("vendor_id"))
    nxt = lambda c: F.lead(c).over(order)
    lead_row = F.col("found") & nxt("found")
    return joined.withColumns(
        {
            "position": F.when(F.col("found"), F.row_number().over(order)),
            "runner_up": F.when(lead_row, nxt("vendor_id")),
            "riskier_than_next": F.when(lead_row, F.col("risk_score") < nxt("risk_score")),
            "next_deploys_faster": F.when(lead_row, F.col("typical_deploy_days") > nxt("typical_deploy_days") * 2),
        }
    ).drop("__key", "__id")


def browse(
    contributions: DataFrame,
    source: str | None = None,
    vendor: str | None = None,
    category: str | None = None,
    contrib_type: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    tie_break: tuple[str, ...] = (),
) -> DataFrame:
    """Filtered rows, newest first, from ``offset``; all of them or a page of ``limit``."""
    page = _filtered(contributions, source=source, vendor=vendor, category=category, contrib_type=contrib_type)
    order = [F.col("received_at").desc(), *[F.col(c) for c in tie_break]]
    rest = page.orderBy(*order).offset(offset)
    return rest if limit is None else rest.limit(limit)


def browse_counts(
    contributions: DataFrame,
    source: str | None = None,
    vendor: str | None = None,
    category: str | None = None,
    contrib_type: str | None = None,
) -> DataFrame:
    """Per source count ignoring the source filter, and the total that honours it."""
    wide = _filtered(contributions, vendor=vendor, category=category, contrib_type=contrib_type)
    counts = wide.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    if source is None:
        return counts.withColumn("selected", F.lit(True))
    return counts.withColumn("selected", F.col("source") == source)


def _filtered(df: DataFrame, **equal: str | None) -> DataFrame:
    for column, value in equal.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def top_counts(df: DataFrame, column: str, limit: int = 20, name: str = "count") -> DataFrame:
    """Most frequent values; ties go to the smaller value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias(name))
        .orderBy(F.col(name).desc(), column)
        .limit(limit)
    )


def peer_benchmark(evals: DataFrame, by: tuple[str, ...] = ("industry",)) -> DataFrame:
    """Platform totals per peer group."""
    return evals.groupBy(*by).agg(
        F.count("*").alias("total_contributions"),
        F.count_distinct("vendor").alias("unique_vendors"),
        F.avg("overall_score").alias("avg_score"),
    )
