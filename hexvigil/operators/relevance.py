"""Which techniques a threat text speaks of, and what a stack does about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexvigil.functions.phrases import phrases_in


def evidence_table(technique_map: DataFrame) -> DataFrame:
    """Points that a phrase or word found in a text gives to a technique."""
    t = technique_map.select(
        "technique_id",
        F.lower("name").alias("name"),
        F.replace("tactic", F.lit("-"), F.lit(" ")).alias("tactic"),
        F.transform("categories", lambda c: F.lower(c)).alias("categories"),
        F.lower("description").alias("description"),
    )

    def rows(kind: str, key: Column, points: int) -> DataFrame:
        return t.select("technique_id", F.lit(kind).alias("kind"), key.alias("key"), F.lit(points).alias("points"))

    def words(column: str, longer_than: int, distinct: bool) -> Column:
        parts = F.filter(F.split(F.trim(column), r"\s+"), lambda w: F.length(w) > longer_than)
        return F.explode(F.array_distinct(parts) if distinct else parts)

    return (
        rows("phrase", F.col("name"), 5)
        .unionAll(rows("word", words("name", 2, False), 2))
        .unionAll(rows("phrase", F.col("tactic"), 3))
        .unionAll(rows("word", words("tactic", 3, False), 1))
        .unionAll(rows("phrase", F.explode("categories"), 2))
        .unionAll(rows("word", words("description", 4, True), 1))
        .groupBy("technique_id", "kind", "key")
        .agg(F.sum("points").alias("points"))
    )


def technique_relevance(
    texts: DataFrame, technique_map: DataFrame, key: str, text: str = "text", top: int | None = 15
) -> DataFrame:
    """Score of every technique a text gives evidence for, the ``top`` best per text.

    Each text is read whole.  Its distinct words meet the words of the techniques in an
    equi-join.  Phrases may begin and end inside a word, so an automaton of all of them reads
    the text itself once.
    """
    evidence = evidence_table(technique_map)
    low = F.lower(text)
    words = texts.select(
        key, F.lit("word").alias("kind"), F.explode(F.array_distinct(F.split(F.trim(low), r"\s+"))).alias("__key")
    )
    dictionary = evidence.where("kind = 'phrase'").select(F.col("key").alias("phrase"))
    held = phrases_in(texts.select(key, low.alias("__low")), [key], "__low", dictionary)
    found = words.unionByName(held.select(key, F.lit("phrase").alias("kind"), F.col("phrase").alias("__key")))
    scored = (
        found.join(evidence.withColumnRenamed("key", "__key"), ["kind", "__key"])
        .groupBy(key, "technique_id")
        .agg(F.sum("points").alias("score"))
    )
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "technique_id")
    ranked = scored.withColumn("place", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("place") <= top)


ADVICE = {
    "email": ["email"],
    "edr": ["edr"],
    "identity": ["iam", "pam"],
    "network": ["ndr"],
    "siem": ["siem"],
}


def threat_map(
    relevant: DataFrame, technique_map: DataFrame, tools: DataFrame, scores: DataFrame, key: str
) -> DataFrame:
    """Covered or gap for each relevant technique of a text, with the three best-scored alternatives.

    ``tools(key, tool)`` is the stack of whoever sent the text; ``scores(vendor, avg_score)``.
    """
    owned = tools.groupBy(key).agg(F.collect_set("tool").alias("__own"))
    rows = (
        relevant.join(technique_map, "technique_id")
        .join(owned, key, "left")
        .withColumn("__own", F.coalesce("__own", F.array().cast("array<string>")))
        .withColumn("covering", F.array_sort(F.array_intersect("primary_vendors", "__own")))
    )
    options = rows.select(key, "technique_id", F.explode(F.array_except("primary_vendors", "__own")).alias("vendor"))
    order = Window.partitionBy(key, "technique_id").orderBy(F.col("avg_score").desc_nulls_last(), "vendor")
    best = (
        options.join(scores.select("vendor", "avg_score"), "vendor", "left")
        .withColumn("__r", F.row_number().over(order))
        .where(F.col("__r") <= 3)
        .groupBy(key, "technique_id")
        .agg(F.sort_array(F.collect_list(F.struct("__r", "vendor"))).alias("__b"))
        .select(key, "technique_id", F.transform("__b", lambda b: b.getField("vendor")).alias("recommended"))
    )
    return rows.join(best, [key, "technique_id"], "left").select(
        key,
        "technique_id",
        "tactic",
        "tactic_order",
        "score",
        (F.size("covering") == 0).alias("gap"),
        F.try_element_at("covering", F.lit(1)).alias("your_coverage"),
        F.coalesce("recommended", F.array().cast("array<string>")).alias("recommended"),
        "categories",
    )


def threat_summary(mapped: DataFrame, key: str) -> DataFrame:
    """Covered and gap counts of a text and the advice its gap categories call for."""
    per = mapped.groupBy(key).agg(
        F.count(F.when(~F.col("gap"), 1)).alias("covered"),
        F.count(F.when(F.col("gap"), 1)).alias("gaps"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("gap"), F.col("categories"))))).alias("__cats"),
    )
    advice = F.array_compact(
        F.array(
            *[
                F.when(F.arrays_overlap("__cats", F.array(*[F.lit(k) for k in kinds])), F.lit(name))
                for name, kinds in ADVICE.items()
            ]
        )
    )
    return per.select(key, "covered", "gaps", (F.col("covered") + F.col("gaps")).alias("techniques"), advice.alias("advice"))
