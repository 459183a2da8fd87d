"""From raw documents to packed training sequences.

Five stages, each over all that the one before kept: toxic documents go, lines
that are boilerplate for their site go, one document of each group of near
duplicates stays, sources, languages and topics are sampled to their target
weights, and what is left is packed into sequences.

Rows with null columns, empty texts and repeated rows go through each stage as
its operator's docstring says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depthloom.llm import line_dedup, minhash, mixing, packing, toxicity
from depthloom.llm.common import importable, materialise, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold; the field learns from the labels in sf_dir."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many of their source's documents hold."""
    importable(spark)
    return line_dedup.line_dedup(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its shingles of five words."""
    importable(spark)
    return minhash.without_near_duplicates(docs, percent=80, bands=32)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens approach the target weights of sources, languages and topics."""
    importable(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in sequences of 2048."""
    importable(spark)
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The field and the near-duplicate groups can't be said in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in sf_dir, after all stages."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
