"""Many phrases in many texts: an index of character n-grams for names, an automaton of all phrases for long texts."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Characters of a gram.  Phrases of up to so many are grams themselves and need no further test.
GRAM = 6
#: A gram that many names hold is spread over so many parts.
SALTS = 8
#: Phrases of one automaton; a larger dictionary takes several passes over the texts.
AUTOMATON = 100_000


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct substrings of these lengths."""

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(text) - (n - 1))
        found = F.transform(places, lambda i: F.substring(text, i, F.lit(n))) if n else F.array(F.lit(""))
        return F.when(F.length(text) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[of(n) for n in sizes])))


def containing(long: DataFrame, short: DataFrame) -> DataFrame:
    """All pairs (long, short) of two tables of strings, ``long`` and ``short``, in which the one contains the other.

    Short strings of up to GRAM characters meet the grams of the long ones in an equi-join, at most one pair a gram.  A
    longer one is indexed under its rarest gram, by how many long strings hold it, and the pairs that share this gram are
    tested; one that has a gram which no long string holds is left out.  Nulls pair with nothing, repeats count once.
    """
    long, short = long.select("long").dropna().distinct(), short.select("short").dropna().distinct()
    sizes = sorted(r[0] for r in short.select(F.least(F.length("short"), F.lit(GRAM))).distinct().collect())  # GRAM + 1 at most
    if not sizes:
        return long.select("long", F.lit("").alias("short")).limit(0)
    index = long.select("long", F.explode(grams(F.col("long"), sizes)).alias("gram"))
    found = index.join(short.where(F.length("short") <= GRAM).select("short", F.col("short").alias("gram")), "gram").select("long", "short")
    if GRAM not in sizes:
        return found
    own = short.where(F.length("short") > GRAM).select("short", F.explode(grams(F.col("short"), [GRAM])).alias("gram"))
    held = index.join(own.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        own.join(often, "gram", "left")
        .groupBy("short")
        .agg(F.min(F.struct("n", "gram")).alias("least"), F.every(F.col("n").isNotNull()).alias("all"))
        .where("all")
        .select("short", F.col("least.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = held.withColumn("salt", F.pmod(F.xxhash64("long"), F.lit(SALTS)).cast("int"))
    tested = salted.join(rarest, ["gram", "salt"]).where(F.contains("long", "short")).select("long", "short")
    return found.unionByName(tested)


def _finder(phrases, keys: list[str]):
    def run(batches):
        words = phrases.value
        automaton = ahocorasick.Automaton()
        for word in words:
            if word:
                automaton.add_word(word, word)
        automaton.make_automaton()
        always = [""] if "" in words else []
        for batch in batches:
            found = [
                sorted({w for _, w in automaton.iter(t)} | set(always)) if len(automaton) else always for t in batch["__text"]
            ]
            out = batch[keys].assign(phrase=found).explode("phrase")
            yield out[out["phrase"].notna()]

    return run


def phrases_in(texts: DataFrame, keys: list[str], text: str, phrases: DataFrame, block: int = AUTOMATON) -> DataFrame:
    """(keys, phrase) for every distinct phrase of ``phrases`` (phrase) that a text contains, as often as its row occurs.

    One automaton of all phrases reads a text once, whole, whatever their number.  A dictionary of more than about
    ``block`` phrases is dealt to several automata by hash, a pass each, so tasks and driver hold one block at a time.
    Null texts and phrases meet nothing; the empty phrase is in every text.
    """
    spark = texts.sparkSession
    phrases = phrases.select("phrase").dropna().distinct()
    parts = max(1, -(-phrases.count() // block))
    schema = StructType([*[texts.schema[k] for k in keys], StructField("phrase", phrases.schema["phrase"].dataType)])
    read = texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text"))
    found = None
    for part in range(parts):
        own = phrases if parts == 1 else phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part)
        words = spark.sparkContext.broadcast(own.toPandas()["phrase"].tolist())
        hits = read.mapInPandas(_finder(words, keys), schema)
        found = hits if found is None else found.unionByName(hits)
    return found
