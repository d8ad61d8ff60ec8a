"""Operators as functions that Spark SQL can call; each is plain SQL, so Catalyst inlines it."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "vendor_slug(name STRING) RETURNS STRING": "replace(lower(name), ' ', '-')",
    "indicator_hash(value STRING) RETURNS STRING": "sha2(lower(trim(value)), 256)",
    "category_hash(name STRING, salt STRING) RETURNS STRING": "sha2(concat(lower(trim(name)), ':', salt), 256)",
    "credibility_weight(f1 DOUBLE, f2 DOUBLE, f3 DOUBLE, f4 DOUBLE, f5 DOUBLE, f6 DOUBLE) RETURNS DOUBLE": (
        "greatest(0.05D, least(0.95D, 1 / (1 + exp(-8 * (0.10D * f1 + 0.10D * f2 + 0.10D * f3 + 0.30D * f4"
        " + 0.25D * f5 + 0.15D * f6 - 0.4D)))))"
    ),
    "decayed_weight(weight DOUBLE, days INT) RETURNS DOUBLE": "weight * pow(2, -greatest(days, 0) / 90)",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"
        " / nullif(sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)), 0D), 0D)"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; gives their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
