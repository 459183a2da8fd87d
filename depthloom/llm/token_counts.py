"""Token counts by byte-pair merging that emits no ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthloom.llm.bpe import merger


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Whole texts, without truncation. A null or empty text has 0 bytes and 0
    tokens; a null id stays null; repeated rows each give a row; other columns
    are not read; an empty table gives no rows. No shuffle: one pass over the
    scan, in Arrow batches, with a bounded cache of words in each worker.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merger(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([merges.count(t) if t else 0 for t in texts], pa.int64())],
                names=["doc_id", "n_tokens"],
            )

    # the byte length comes from the text itself, in the JVM, before the text goes to Python
    source = docs.select(F.struct(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(count, f"doc_id struct<id: {docs.schema[id_col].dataType.simpleString()}, n_bytes: bigint>, n_tokens bigint")
    return out.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
