"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthloom.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most `most` rows of each label, 0 and 1, chosen by a hash of the id.

    Rows whose crc32(id as text) mod `parts` is `part` are never taken, nor
    those without an id or a label; an id labelled twice counts once, by its
    greater label. The ids, at most 2 * `most`, meet the documents in a
    broadcast join; ids that several rows share give one of them.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")).filter(F.col("_id").isNotNull() & F.col("label").isin(0, 1)).filter(~held_out(F.col("_id"), parts, part))
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    ids = known.filter("label = 1").orderBy(*order).limit(most).union(known.filter("label = 0").orderBy(*order).limit(most))
    met = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return met.select("doc_id", "label", "text")
