"""The registered queries of the corpus operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depthloom.llm import fingerprints, line_dedup, minhash, mixing, packing, pitman_yor, quality_cnn, robust_quality, token_counts, toxicity
from depthloom.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(spark, sf_dir)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents")))


def op6_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op10_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_quality.robust_quality(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_minhash, op3_line_dedup, op4_mixing, op5_packing, op6_quality_cnn, op7_language_model, op8_fingerprints, op9_token_counts, op10_robust_quality)}

ORACLE_SQL = {"op3_line_dedup": line_dedup.SQL, "op4_mixing": mixing.SQL}
