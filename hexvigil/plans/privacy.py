"""Noise, budgets and privacy levels; draws come from hashes, so the oracle draws the same."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hexvigil import bridge, dims
from hexvigil.functions.noise import gaussian, laplace, randomized_response, response_rate, uniform
from hexvigil.functions.sql import register
from hexvigil.operators import privacy
from hexvigil.plans.registry import R, query, rounded
from hexvigil.plans.text import CLEAN_SQL, NOTES, with_sentence

SECRET = "noise-demo-secret"


def u_sql(*parts: str) -> str:
    joined = ", ".join([f"'{SECRET}'", *parts])
    return f"((CAST(concat('0x', substr(sha256(concat_ws(':', {joined})), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def lap_sql(value: str, scale: str, u: str) -> str:
    return f"({value} - ({scale}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


EVENT = "CAST(event_id AS VARCHAR)"
P1 = math.exp(1.0) / (1 + math.exp(1.0))


@query(
    "d01_laplace",
    f"SELECT event_id, {R(lap_sql('value', '500.0 / 2.0', u_sql(EVENT)))} AS noised FROM events",
)
def laplace_noise(spark, sf):
    u = uniform(SECRET, F.col("event_id").cast("string"))
    out = bridge.table(spark, sf, "events").select("event_id", laplace(F.col("value"), 500.0, 2.0, u).alias("noised"))
    return rounded(out, "noised")


SIGMA = 500.0 * math.sqrt(2 * math.log(1.25 / 1e-5)) / 2.0


@query(
    "d02_gaussian",
    f"""SELECT event_id, {R(f"value + {SIGMA!r}::DOUBLE * sqrt(-2 * ln({u_sql(EVENT, chr(39) + 'a' + chr(39))})) * cos({2 * math.pi!r}::DOUBLE * {u_sql(EVENT, chr(39) + 'b' + chr(39))})")} AS noised FROM events""",
)
def gaussian_noise(spark, sf):
    key = F.col("event_id").cast("string")
    out = bridge.table(spark, sf, "events").select(
        "event_id",
        gaussian(
            F.col("value"), 500.0, 2.0, uniform(SECRET, key, F.lit("a")), uniform(SECRET, key, F.lit("b"))
        ).alias("noised"),
    )
    return rounded(out, "noised")


RR_SQL = f"SELECT user_id, value > 20 AS truth, CASE WHEN {u_sql(EVENT)} < {P1!r}::DOUBLE THEN value > 20 ELSE NOT (value > 20) END AS reported FROM events"


@query(
    "d03_randomized_response",
    f"""SELECT user_id, count(*) AS n, {R('avg(CASE WHEN truth THEN 1.0 ELSE 0 END)')} AS true_rate, {R('avg(CASE WHEN reported THEN 1.0 ELSE 0 END)')} AS reported_rate,
 {R(f'(avg(CASE WHEN reported THEN 1.0 ELSE 0 END) - (1 - {P1!r}::DOUBLE)) / (2 * {P1!r}::DOUBLE - 1)')} AS estimated_rate FROM ({RR_SQL}) GROUP BY user_id""",
)
def randomized_responses(spark, sf):
    ev = bridge.table(spark, sf, "events").select(
        "user_id",
        (F.col("value") > 20).alias("truth"),
        randomized_response(F.col("value") > 20, 1.0, uniform(SECRET, F.col("event_id").cast("string"))).alias("reported"),
    )
    reported = F.avg(F.when(F.col("reported"), 1.0).otherwise(0.0))
    out = ev.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("truth"), 1.0).otherwise(0.0)).alias("true_rate"),
        reported.alias("reported_rate"),
        response_rate(reported, 1.0).alias("estimated_rate"),
    )
    return rounded(out, "true_rate", "reported_rate", "estimated_rate")


REC_KEY = "CAST(o_orderkey AS VARCHAR)"
PRESENT = "(1 + CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END + 1)"


def rec_sql(value: str, field: str) -> str:
    sens, low, high = dims.EVAL_SENSITIVITY[field]
    noised = lap_sql(value, f"{sens!r}::DOUBLE / (4.0::DOUBLE / {PRESENT})", u_sql(REC_KEY, f"'{field}'"))
    return f"greatest({low!r}::DOUBLE, least({high!r}::DOUBLE, {noised}))"


@query(
    "d04_noise_records",
    f"""SELECT o_orderkey, {R(rec_sql('o_totalprice / 50000', 'overall_score'))} AS overall_score, CASE WHEN o_orderkey % 3 <> 0 THEN {R(rec_sql('o_custkey % 101', 'detection_rate'))} END AS detection_rate,
 {R(rec_sql('o_orderkey % 365', 'deploy_days'))} AS deploy_days, CASE WHEN {u_sql(REC_KEY, "'would_buy'")} < {math.exp(4.0) / (1 + math.exp(4.0))!r}::DOUBLE THEN o_orderstatus = 'F' ELSE o_orderstatus <> 'F' END AS would_buy FROM orders""",
)
def noise_records(spark, sf):
    recs = bridge.table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") / 50000).alias("overall_score"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 101).alias("detection_rate"),
        (F.col("o_orderkey") % 365).alias("deploy_days"),
        (F.col("o_orderstatus") == "F").alias("would_buy"),
    )
    out = privacy.noise_records(recs, 4.0, ["o_orderkey"], SECRET, digits=None)
    return rounded(out, "overall_score", "detection_rate", "deploy_days")


@query(
    "d05_flip_outcomes",
    f"""WITH c AS (SELECT contribution_id, technique_id, tool, max(CASE WHEN outcome = 'detected' THEN 1 ELSE 0 END) = 1 AS d FROM technique_obs WHERE outcome IS NOT NULL GROUP BY 1, 2, 3),
 k AS (SELECT contribution_id, count(DISTINCT technique_id) AS k FROM technique_obs GROUP BY 1)
 SELECT c.contribution_id, technique_id, tool, CASE WHEN ({u_sql('CAST(c.contribution_id AS VARCHAR)', 'technique_id', 'tool')} < exp(3.0 / k) / (1 + exp(3.0 / k))) = d THEN 'detected' ELSE 'missed' END AS outcome FROM c JOIN k ON k.contribution_id = c.contribution_id""",
    ("technique_obs",),
)
def flip_outcomes(spark, sf):
    obs = bridge.technique_obs(spark, sf, "contribution_id", "technique_id", "tool", "outcome")
    return privacy.flip_outcomes(obs, 3.0, SECRET)


@query(
    "d06_budget_ledger",
    f"""WITH s AS (SELECT event_id, user_id AS subject, ts, value / 100 AS epsilon, sum(value / 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cumulative FROM events)
 SELECT event_id, subject, {R('cumulative')} AS cumulative, {R('greatest(0.0, 10.0 - cumulative)')} AS remaining, cumulative / 10.0 >= 1.0 AS exhausted,
 CASE WHEN cumulative / 10.0 >= 1.0 THEN 'exhausted' WHEN cumulative / 10.0 >= 0.8 THEN 'nearly exhausted' WHEN cumulative / 10.0 >= 0.5 THEN 'half spent' END AS warning FROM s""",
)
def budget_ledger(spark, sf):
    spends = bridge.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("subject"), "ts", (F.col("value") / 100).alias("epsilon")
    )
    out = privacy.budget_ledger(spends, order=["ts", "event_id"], threshold=10.0)
    return rounded(out, "cumulative", "remaining").drop("ts", "epsilon")


@query("d07_maximum_privacy")
def maximum_privacy(spark, sf):
    """The strictest level over evaluations whose notes are whole conversation turns."""
    conv = bridge.texts(spark, sf, "conversations", "conv_id").select(
        "conv_id",
        "turn",
        F.col("text").alias("notes"),
        (F.length("text") % 11).cast("double").alias("overall_score"),
        (F.col("turn") % 2 == 0).alias("would_buy"),
        F.concat(F.lit("host-"), F.col("conv_id").cast("string"), F.lit(".corp")).alias("value_raw"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("received_at"),
    )
    return privacy.apply_level(conv, "maximum", ["conv_id", "turn"], SECRET)


@query(
    "d07_research_privacy",
    """SELECT conv_id, turn, length(text) AS notes_chars, sha256(concat('host-', CAST(conv_id AS VARCHAR), '.corp')) AS value_hash, 'research' AS privacy_level, 2 AS min_k
 FROM conversations""",
)
def research_privacy(spark, sf):
    """The lightest level keeps security context; these turns hold no personal data, so lengths stay."""
    conv = bridge.texts(spark, sf, "conversations", "conv_id").select(
        "conv_id",
        "turn",
        F.col("text").alias("notes"),
        F.concat(F.lit(" HOST-"), F.col("conv_id").cast("string"), F.lit(".corp")).alias("value_raw"),
    )
    out = privacy.apply_level(conv, "research", ["conv_id", "turn"], SECRET)
    return out.withColumn("notes_chars", F.length("notes").cast("long")).drop("notes")


@query("t06_anonymize_evals", f"SELECT doc_id, clean AS notes FROM ({CLEAN_SQL})")
def anonymize_evals(spark, sf):
    docs = with_sentence(spark, sf, NOTES).withColumnRenamed("text", "notes")
    return privacy.anonymize_evals(docs)


@query(
    "t06_anonymize_bundles",
    "SELECT sha256(concat('host', CAST(l_partkey AS VARCHAR))) AS value_hash, count(*) AS n FROM lineitem GROUP BY 1",
)
def anonymize_bundles(spark, sf):
    raw = F.concat(F.lit(" Host"), F.col("l_partkey").cast("string"))
    entry = F.struct(raw.alias("value_raw"), F.lit(None).cast("string").alias("value_hash"))
    bundles = bridge.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(entry).alias("iocs"))
    flat = privacy.anonymize_bundles(bundles).select(F.explode("iocs").alias("i")).select("i.*")
    return flat.groupBy("value_hash").agg(F.count("*").alias("n"))


@query(
    "t06_anonymize_attack_maps",
    f"""SELECT technique_id, o.tool, CASE WHEN {u_sql('CAST(contribution_id AS VARCHAR)', 'technique_id', 'o.tool')} < exp(3.0 / k) / (1 + exp(3.0 / k)) THEN outcome = 'detected' ELSE outcome <> 'detected' END AS detected, 'mail [EMAIL]' AS notes, count(*) AS n
 FROM technique_obs o JOIN (SELECT contribution_id AS c, count(*) AS k FROM technique_obs GROUP BY 1) x ON x.c = contribution_id WHERE outcome IS NOT NULL GROUP BY ALL""",
    ("technique_obs",),
)
def anonymize_attack_maps(spark, sf):
    obs = bridge.technique_obs(spark, sf, "contribution_id", "technique_id", "tool", "outcome")
    none = F.array().cast("array<string>")
    entry = F.struct(
        "technique_id",
        F.when(F.col("outcome") == "detected", F.array("tool")).otherwise(none).alias("detected_by"),
        F.when(F.col("outcome") == "missed", F.array("tool")).otherwise(none).alias("missed_by"),
        F.concat(F.lit("mail u"), F.col("contribution_id").cast("string"), F.lit("@example.org")).alias("notes"),
    )
    maps = obs.groupBy("contribution_id").agg(F.collect_list(entry).alias("techniques"))
    out = privacy.anonymize_attack_maps(maps, 3.0, SECRET).select(F.explode("techniques").alias("t")).select("t.*")
    both = F.concat(
        F.transform("detected_by", lambda v: F.struct(v.alias("tool"), F.lit(True).alias("detected"))),
        F.transform("missed_by", lambda v: F.struct(v.alias("tool"), F.lit(False).alias("detected"))),
    )
    flat = out.select("technique_id", "notes", F.explode(both).alias("x")).select("technique_id", "x.tool", "x.detected", "notes")
    return flat.groupBy("technique_id", "tool", "detected", "notes").agg(F.count("*").alias("n"))


@query(
    "u01_sql_functions",
    f"""SELECT vec_id, {R('list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))')} AS turned, {R('greatest(0.05, least(0.95, 1 / (1 + exp(-8 * (0.1 * (label / 10.0) - 0.4)))))')} AS weight,
 sha256(CAST(vec_id AS VARCHAR)) AS hashed FROM embeddings""",
)
def sql_functions(spark, sf):
    """The registered functions called from Spark SQL."""
    register(spark)
    return spark.sql(
        """SELECT vec_id, round(cosine(e, reverse(e)) + 1e-9, 6) AS turned,
        round(credibility_weight(label / 10D, 0D, 0D, 0D, 0D, 0D) + 1e-9, 6) AS weight,
        indicator_hash(concat(' ', vec_id)) AS hashed FROM {vectors}""",
        vectors=bridge.table(spark, sf, "embeddings").select(
            "vec_id", "label", F.col("embedding").cast("array<double>").alias("e")
        ),
    )
