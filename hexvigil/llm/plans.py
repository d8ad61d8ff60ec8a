"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexvigil.llm import centroids, divergence, mixing
from hexvigil.llm.ann import nearest
from hexvigil.llm.common import table
from hexvigil.llm.langid import learn_and_identify
from hexvigil.llm.minhash import near_duplicates
from hexvigil.llm.ngram_lm import score_texts
from hexvigil.llm.packing import best_fit
from hexvigil.llm.pii import find_pii
from hexvigil.llm.quality import score_quality
from hexvigil.llm.secrets import common_words, scan_secrets
from hexvigil.llm.toxicity import score_toxicity
from hexvigil.llm.vector_dedup import link_vectors


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return learn_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return scan_secrets(docs, words=common_words(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return centroids.with_inertia(assigned, found)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; its stages import this subpackage

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_mixing": op2_mixing,
    "op3_language": op3_language,
    "op4_pii": op4_pii,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_minhash": op8_minhash,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_centroids": op11_centroids,
    "op12_divergence": op12_divergence,
    "op13_language_model": op13_language_model,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op11_centroids": centroids.ORACLE, "op12_divergence": divergence.ORACLE}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
