"""Concatenate-and-cut packing of token sequences."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthloom.llm.bpe import encoder
from depthloom.llm.common import materialise

END_ID = 1
TEXTS_AT_ONCE = 256


def tokenised(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """First pass: each document's ids with its end id, and where they begin among the ids of its own partition."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, begin = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = struct.pack("<H" if ids_of.kind.itemsize == 2 else "<I", END_ID)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                rows = batch.slice(at, TEXTS_AT_ONCE)
                ids = [x + end for x in ids_of.encode([t or "" for t in rows.column(1).to_pylist()])]
                n = np.array([len(x) // ids_of.kind.itemsize for x in ids], np.int64)
                starts = begin + np.cumsum(n) - n
                begin += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "begin", "n", "ids"],
                )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(encode, f"doc_id {kind}, part int, begin bigint, n bigint, ids binary")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into one stream of tokens, cut every `length` tokens.

    Per piece: doc_id, start (the document's ids before it), length, ids
    (binary, little-endian unsigned 32-bit), doc_tokens (with the end id),
    sequence_id and offset. Only the last sequence can be short of `length`.

    Two passes of prefix sums: within a partition while its texts are
    tokenised, then over the partitions' totals, one number per task, which
    is all the driver sees. The ids of the first pass are written once to the
    shared folder, so a lost executor can't move an offset. No shuffle.

    A null or empty text is its end id alone; a null id stays null; repeated
    rows are packed each; a document longer than a sequence is cut into
    several pieces; other columns are not read; an empty table gives no rows.
    """
    first = materialise(tokenised(docs, vocabulary, id_col, text_col), "tokens")
    spark = docs.sparkSession
    totals = sorted((r["part"], r["total"]) for r in first.groupBy("part").agg(F.sum("n").alias("total")).collect())
    bases, running = {}, 0
    for part, total in totals:
        bases[part] = running
        running += total
    base_of = spark.sparkContext.broadcast(bases)
    narrow = encoder_width(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                rows = batch.slice(at, TEXTS_AT_ONCE)
                doc, part, begin, n, ids = (rows.column(i) for i in range(5))
                base = np.array([base_of.value[p] for p in part.to_pylist()], np.int64) + begin.to_numpy()
                n = n.to_numpy()
                pieces = (base + n - 1) // length - base // length + 1
                row = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = base[row] // length + nth
                start = np.where(nth == 0, 0, sequence * length - base[row])
                stop = np.minimum((sequence + 1) * length - base[row], n[row])
                wide = [np.frombuffer(x, narrow).astype("<u4") for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(row)), pa.array(start), pa.array(stop - start), pa.array([wide[r][a:b].tobytes() for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist())], pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(base[row] + start - sequence * length)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return first.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def encoder_width(vocabulary: str) -> str:
    return encoder(vocabulary).kind.str


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens and its pieces (doc_id, start, length, ids) in order; a group holds one sequence, so at most its length in pieces."""
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"))


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
