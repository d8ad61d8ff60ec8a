"""Additive secret shares and blind category discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexvigil.functions.noise import uniform


def make_shares(values: DataFrame, parties: int, secret: str, key: list[str], spread: float = 1e6) -> DataFrame:
    """``parties`` additive shares of every value; the last is the value minus the others.

    ``values(session, field, value, *key)``; a single share is a uniform draw and says
    nothing about the value.
    """
    if parties < 2:
        raise ValueError("at least two parties")
    ident = [F.col(k).cast("string") for k in key]

    def draw(i: int) -> Column:
        return (uniform(secret, *ident, F.col("field"), F.lit(str(i))) * 2 - 1) * spread

    drawn = [draw(i) for i in range(parties - 1)]
    last = F.col("value") - sum(drawn[1:], drawn[0])
    return values.select(
        "session", "field", F.posexplode(F.array(*drawn, last)).alias("party", "share")
    )


def secure_sum(shares: DataFrame, parties: int) -> DataFrame:
    """Sum of all shares per (session, field), released only when every party's shares came in.

    Parties add up what they received first, so a session with a third of all shares
    meets the final sum as one row per party.
    """
    per_party = shares.groupBy("session", "field", "party").agg(F.sum("share").alias("s"), F.count("*").alias("n"))
    return (
        per_party.groupBy("session", "field")
        .agg(F.sum("s").alias("total"), F.count("*").alias("parties"), F.sum("n").alias("shares"))
        .where(F.col("parties") >= parties)
    )


def category_hash(name: Column, salt: Column) -> Column:
    """What a proposer sends instead of a name."""
    return F.sha2(F.concat(F.lower(F.trim(name)), F.lit(":"), salt), 256)


CATEGORY_TYPES = ["threat_actor", "malware", "tool", "technique", "remediation", "campaign"]


def blind_categories(
    proposals: DataFrame, votes: DataFrame, threshold: int = 3, quorum: int = 2
) -> DataFrame:
    """State of every proposed hash on a closed log, in event order.

    ``proposals(category_hash, category_type, proposer, ts)``,
    ``votes(category_hash, plaintext, salt, proposer, ts)``.  A hash is discovered with the
    ``threshold``-th distinct proposer; from then on a vote counts if its plaintext and
    salt hash to the category and its voter has proposed it before; the ``quorum``-th
    distinct voter reveals the name.  Later proposals no longer add support.
    """
    valid = proposals.where((F.length("category_hash") == 64) & F.col("category_type").isin(CATEGORY_TYPES))
    first = valid.groupBy("category_hash", "proposer").agg(F.min("ts").alias("joined"))
    kinds = valid.groupBy("category_hash").agg(
        F.min(F.struct("ts", "category_type")).getField("category_type").alias("category_type"),
        F.min("ts").alias("first_seen"),
    )
    in_order = Window.partitionBy("category_hash").orderBy("joined", "proposer")
    met = (
        first.withColumn("__r", F.row_number().over(in_order))
        .where(F.col("__r") <= threshold)
        .groupBy("category_hash")
        .agg(F.max("joined").alias("met_at"), F.count("*").alias("__k"))
        .where(F.col("__k") >= threshold)
        .drop("__k")
    )
    genuine = (
        votes.where(category_hash(F.col("plaintext"), F.col("salt")) == F.col("category_hash"))
        .join(met, "category_hash")
        .where(F.col("ts") >= F.col("met_at"))
        .join(first, ["category_hash", "proposer"])
        .where(F.col("ts") >= F.col("joined"))
        .groupBy("category_hash", "proposer")
        .agg(F.min(F.struct("ts", F.lower(F.trim("plaintext")).alias("name"))).alias("v"))
        .select("category_hash", "proposer", F.col("v.ts").alias("voted"), F.col("v.name").alias("name"))
    )
    voting = Window.partitionBy("category_hash").orderBy("voted", "proposer")
    revealed = (
        genuine.withColumn("__r", F.row_number().over(voting))
        .where(F.col("__r") <= quorum)
        .groupBy("category_hash")
        .agg(F.max("voted").alias("revealed_at"), F.count("*").alias("votes"), F.min("name").alias("name"))
    )
    done = F.col("votes") >= quorum
    support = (
        first.join(revealed.where(done).select("category_hash", "revealed_at"), "category_hash", "left")
        .where(F.col("revealed_at").isNull() | (F.col("joined") <= F.col("revealed_at")))
        .groupBy("category_hash")
        .agg(F.count("*").alias("supporters"))
    )
    return (
        kinds.join(support, "category_hash")
        .join(met, "category_hash", "left")
        .join(revealed, "category_hash", "left")
        .select(
            "category_hash",
            "category_type",
            "supporters",
            F.when(done, "revealed")
            .when(F.col("met_at").isNotNull(), "threshold_met")
            .otherwise("pending")
            .alias("status"),
            F.coalesce("votes", F.lit(0)).alias("reveal_votes"),
            F.when(done, F.col("name")).alias("revealed_name"),
        )
    )


def pending_categories(states: DataFrame, min_supporters: int = 0) -> DataFrame:
    """Unrevealed categories, best supported first."""
    return states.where((F.col("status") != "revealed") & (F.col("supporters") >= min_supporters)).orderBy(
        F.col("supporters").desc(), "category_hash"
    )
