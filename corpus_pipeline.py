"""A training-data pipeline over ``documents``: five stages, each one of the operators of ``hexvigil.llm``.

``run(spark, sf_dir)`` applies the stages in order.  Each stage's rows are written as Parquet below the session's
checkpoint folder and read again as the next one's documents, so a lost executor repeats one stage's tasks at most.
All stages but the last return the columns of ``documents``; nulls, empty texts and empty tables pass as each
operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexvigil.llm.langid import learn_and_identify
from hexvigil.llm.minhash import near_duplicates
from hexvigil.llm.mixing import mix_sources
from hexvigil.llm.packing import best_fit
from hexvigil.llm.secrets import common_words, redact
from hexvigil.session import cut_lineage, scratch_path


def _aside(docs: DataFrame, *results: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns out of the way that have a result's name or begin with ``_``, and how to name them again."""
    back = {}
    for name in docs.columns:
        if name in results or name.startswith("_"):
            other = f"given_{name}"
            while other in docs.columns or other in back:
                other = f"given_{other}"
            back[other] = name
    return docs.withColumnsRenamed({name: other for other, name in back.items()}), back


def _again(rows: DataFrame, back: dict[str, str], columns: list[str]) -> DataFrame:
    """The columns of the input, under their own names."""
    other = {name: given for given, name in back.items()}
    return rows.select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: those without letters, or all if nothing could be learned.

    A text in several languages stays, as its spans tell them.
    """
    given, back = _aside(docs, "held_out", "lang_pred", "score", "spans")
    return _again(learn_and_identify(given).filter(F.col("lang_pred") != "und"), back, docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words a shingle, similarity 0.8) stays.

    It is the one with the smallest doc_id, then the smallest digest of its text.  Rows are told apart by id and text, so
    a text goes only by its own group.  Of rows that repeat both, one stays.  Rows without an id or words are no
    duplicates of others.
    """
    found = cut_lineage(near_duplicates(docs, shingle=5, percent=80).filter("doc_id is not null"))
    key = ["doc_id", "digest"]
    grouped = found.filter("grp is not null").select(*key, "grp", "kept").distinct()
    stay = grouped.filter("kept").groupBy("grp").agg(F.min(F.struct(*key)).alias("x")).select("grp", "x.*")
    away = grouped.join(stay, ["grp", *key], "left_anti").select(*key)
    digest = F.xxhash64("text").alias("digest")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"))
    keyed = keyed.join(away, key, "left_anti")
    again = found.groupBy(*key).count().filter("count > 1").select(*key)
    if not again.isEmpty():
        once = keyed.join(again, key, "left_semi").dropDuplicates(key)
        keyed = keyed.join(again, key, "left_anti").unionByName(once)
    return keyed.select(*[F.col(f"given.`{c}`").alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret of the texts, words of these documents taken as easy to guess; all documents stay."""
    return redact(docs, words=common_words(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights."""
    given, back = _aside(docs, "size", "source_size", "target", "taken", "times", "threshold")
    mixed = mix_sources(given).filter("times > 0")
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return _again(copies, back, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token pieces into sequences of 2048."""
    return best_fit(docs)


STAGES = [
    ("language", language),
    ("near duplicates", deduplicate),
    ("secrets", secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Language, near duplicates and packing can't be expressed in SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
