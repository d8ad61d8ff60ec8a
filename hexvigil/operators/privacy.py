"""Noise on records, privacy budgets and privacy levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexvigil import dims
from hexvigil.functions.bind import kept, once
from hexvigil.functions.hashing import indicator_hash, indicator_hmac
from hexvigil.functions.noise import laplace, randomized_response, uniform
from hexvigil.functions.prefix import running_total
from hexvigil.functions.scrub import scrub, scrub_infra, scrub_pii


def noise_records(evals: DataFrame, epsilon: float, key: list[str], secret: str, digits: int | None = 1) -> DataFrame:
    """Laplace noise on the present numeric fields, the budget split equally among them.

    Values are clamped to their range; day counts become whole, the others get ``digits``.
    ``key`` identifies the record, so equal records of one submitter need distinct keys.
    """
    fields = [f for f in dims.EVAL_SENSITIVITY if f in evals.columns]
    present = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    ident = [F.col(k).cast("string") for k in key]
    out: dict[str, Column] = {}
    for f in fields:
        sensitivity, low, high = dims.EVAL_SENSITIVITY[f]
        u = uniform(secret, *ident, F.lit(f))
        noised = laplace(F.col(f).cast("double"), sensitivity, F.lit(float(epsilon)) / F.col("__present"), u)
        clamped = F.greatest(F.lit(low), F.least(F.lit(high), noised))
        if digits is None:
            shaped = clamped
        elif f in ("deploy_days", "eval_duration_days"):
            shaped = F.bround(clamped, 0)
        else:
            shaped = F.bround(clamped, digits)
        out[f] = F.when(F.col(f).isNotNull(), shaped)
    if "would_buy" in evals.columns:
        out["would_buy"] = randomized_response(F.col("would_buy"), epsilon, uniform(secret, *ident, F.lit("would_buy")))
    return evals.withColumn("__present", present).withColumns(out).drop("__present")


def flip_outcomes(obs: DataFrame, epsilon: float, secret: str) -> DataFrame:
    """Randomised response on detected/missed per (contribution, technique, tool).

    The budget is split by the contribution's number of techniques; a tool listed on
    both sides counts as having detected.
    """
    cells = (
        obs.where("outcome IS NOT NULL")
        .groupBy("contribution_id", "technique_id", "tool")
        .agg(F.max((F.col("outcome") == "detected").cast("int")).alias("__d"))
    )
    sizes = obs.groupBy("contribution_id").agg(F.count_distinct("technique_id").alias("__k"))
    u = uniform(secret, F.col("contribution_id").cast("string"), F.col("technique_id"), F.col("tool"))
    eps = F.lit(float(epsilon)) / F.col("__k")
    reported = randomized_response(F.col("__d") == 1, eps, u)
    return cells.join(sizes, "contribution_id").select(
        "contribution_id",
        "technique_id",
        "tool",
        F.when(reported, "detected").otherwise("missed").alias("outcome"),
    )


def budget_ledger(
    spends: DataFrame, subject: str = "subject", ts: str = "ts", order: list[str] | None = None, threshold: float = 10.0
) -> DataFrame:
    """Cumulative epsilon after every spend, what remains, and the warning level.

    Sums run over days first and within a day second, so one busy subject is not one task.
    """
    summed = running_total(spends, [subject], F.to_date(ts), order or [ts], "epsilon", "cumulative")
    ratio = F.col("cumulative") / threshold
    return summed.withColumns(
        {
            "remaining": F.greatest(F.lit(0.0), threshold - F.col("cumulative")),
            "exhausted": ratio >= 1.0,
            "warning": F.when(ratio >= 1.0, "exhausted")
            .when(ratio >= 0.8, "nearly exhausted")
            .when(ratio >= 0.5, "half spent"),
        }
    )


# What each level switches on.
LEVELS = {
    "maximum": {"scrub": "aggressive", "noise_epsilon": 1.0, "min_k": 10, "strip_timing": True},
    "standard": {"scrub": "standard", "noise_epsilon": None, "min_k": 3, "strip_timing": False},
    "research": {"scrub": "light", "noise_epsilon": None, "min_k": 2, "strip_timing": False},
}
TEXT_FIELDS = ["notes", "top_strength", "top_friction"]
TIMING_FIELDS = ["received_at", "created_at", "last_used", "timestamp"]


def apply_level(df: DataFrame, level: str, key: list[str], secret: str) -> DataFrame:
    """Hash raw indicators, scrub text, strip timing, add noise and mark the group size to release."""
    if level not in LEVELS:
        raise ValueError(f"unknown privacy level {level!r}; one of {sorted(LEVELS)}")
    policy = LEVELS[level]
    if "value_raw" in df.columns:
        hashed = indicator_hash("value_raw")
        kept = F.coalesce("value_hash", hashed) if "value_hash" in df.columns else hashed
        df = df.withColumn("value_hash", kept).drop("value_raw")
    for name in (f for f in TEXT_FIELDS if f in df.columns):
        clean = scrub_pii(F.col(name))
        if policy["scrub"] != "light":
            clean = scrub_infra(clean)
        if policy["scrub"] == "aggressive":
            clean = scrub_infra(scrub_pii(clean))
        df = df.withColumn(name, clean)
    if policy["noise_epsilon"] is not None:
        df = noise_records(df, policy["noise_epsilon"], key, secret)
    if policy["strip_timing"]:
        df = df.drop(*TIMING_FIELDS)
    return df.withColumns({"privacy_level": F.lit(level), "min_k": F.lit(policy["min_k"])})


def anonymize_evals(evals: DataFrame, epsilon: float | None = None, key: list[str] | None = None, secret: str = "") -> DataFrame:
    """Scrubbed text fields, optionally noised numbers."""
    present = [c for c in TEXT_FIELDS if c in evals.columns]
    clean = evals.withColumns({c: scrub(F.col(c)) for c in present})
    return clean if epsilon is None else noise_records(clean, epsilon, key or [], secret)


def anonymize_attack_maps(maps: DataFrame, epsilon: float | None = None, secret: str = "") -> DataFrame:
    """Scrubbed notes of the map and of its nested techniques, optionally flipped outcomes.

    Flipping works on the nested lists in place: a tool listed on both sides counts as
    having detected, and the budget is split by the number of techniques.
    """

    def flipped(t: Column) -> Column:
        """Every tool with what is reported of it, drawn once."""
        eps = F.lit(float(epsilon)) / F.greatest(F.size("techniques"), F.lit(1))

        def reported(tool: Column) -> Column:
            u = uniform(secret, F.col("contribution_id").cast("string"), t.getField("technique_id"), tool)
            return randomized_response(F.array_contains(t.getField("detected_by"), tool), eps, u)

        tools = F.array_union(t.getField("detected_by"), t.getField("missed_by"))
        return F.transform(tools, lambda tool: F.struct(tool.alias("tool"), reported(tool).alias("reported")))

    def side(drawn: Column, detected: bool) -> Column:
        ours = F.filter(drawn, lambda x: x.getField("reported") if detected else ~x.getField("reported"))
        return F.transform(ours, lambda x: x.getField("tool"))

    def clean(t: Column) -> Column:
        out = t.withField("notes", scrub(t.getField("notes")))
        if epsilon is None:
            return out
        return once(flipped(t), lambda d: out.withField("detected_by", side(d, True)).withField("missed_by", side(d, False)))

    out = maps.withColumn("techniques", kept(F.transform("techniques", clean)))
    return out.withColumn("notes", scrub(F.col("notes"))) if "notes" in maps.columns else out


def anonymize_bundles(bundles: DataFrame, key: bytes | None = None) -> DataFrame:
    """Indicators by hash only (keyed with ``key``), scrubbed notes; raw values are dropped."""

    def hashed(i: Column) -> Column:
        raw = i.getField("value_raw")
        fresh = indicator_hash(raw) if key is None else indicator_hmac(key, raw)
        return i.withField("value_hash", F.coalesce(i.getField("value_hash"), fresh)).dropFields("value_raw")

    cols = {"iocs": F.transform("iocs", hashed)}
    if "notes" in bundles.columns:
        cols["notes"] = scrub(F.col("notes"))
    return bundles.withColumns(cols)
