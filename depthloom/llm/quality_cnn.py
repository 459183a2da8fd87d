"""Quality by a convolutional network over bytes, in numpy.

The input alphabet has 512 signs: a byte, and whether the eight bytes there
also stood at most LAG bytes before. Filters over WIDTH signs, at every second
byte, are max-pooled over overlapping chunks that cover the whole text; the
chunks' pooled activations, their mean and their maximum over the document,
are combined by a hidden layer into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthloom.llm.common import held_out
from depthloom.llm.samples import labelled_sample

#: Labelled documents of each label to learn from, at most; training reads them whole.
SAMPLE = 1000
FILTERS = 16
HIDDEN = 12
WIDTH = 8
STRIDE = 2
BLOCK = 32
CHUNK_BLOCKS = 8
HOP_BLOCKS = 7
LAG = 24
EPOCHS = 14
THRESHOLD = 0.3
AT_ONCE = 1 << 20  # bytes whose activations are held at a time


def signs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The signs of texts laid end to end, each padded with zeros to whole blocks, and where their blocks begin (one more entry at the end)."""
    blocks = [-(-(len(t) + WIDTH) // BLOCK) for t in texts]
    first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    data = np.frombuffer(b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, blocks)) + bytes(16), np.uint8)
    n = int(first[-1]) * BLOCK
    out = data[:n].astype(np.int16)
    if n <= 1:
        return out, first
    four = data[: n + 8].astype(np.uint32)
    four = four[:-3] | four[1:-2] << 8 | four[2:-1] << 16 | four[3:] << 24
    eight = four[: n + 1].astype(np.uint64) | four[4 : n + 5].astype(np.uint64) << np.uint64(32)
    eight = eight[:n]
    again = np.zeros(n, bool)
    for lag in range(1, LAG + 1):
        again[lag:] |= eight[lag:] == eight[:-lag]
    # a text repeats nothing of the one before it: the first LAG places look no further back than its begin
    head = first[:-1, None] * BLOCK + np.arange(LAG)
    own, marks = eight[head], np.zeros(head.shape, bool)
    for lag in range(1, LAG):
        marks[:, lag:] |= own[:, lag:] == own[:, :-lag]
    again[head] = marks
    again &= data[:n] != 0  # padding repeats nothing
    out[again] += 256
    return out, first


def chunk_bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks as runs of blocks: begin, end, and the text of each; they overlap by a block and cover every block."""
    blocks = np.diff(first)
    count = np.maximum(1, -(-(blocks - (CHUNK_BLOCKS - HOP_BLOCKS)) // HOP_BLOCKS))
    text = np.repeat(np.arange(len(blocks)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[text] + nth * HOP_BLOCKS
    return begin, np.minimum(begin + CHUNK_BLOCKS, first[text + 1]), text


class Network:
    """tables[j, sign, filter] are the filters' weights for the sign at place j; the rest is a layer on top."""

    def __init__(self, tables, bias, hidden, hidden_bias, top, top_bias):
        self.tables, self.bias = tables.astype(np.float32), bias.astype(np.float32)
        self.hidden, self.hidden_bias, self.top, self.top_bias = hidden, hidden_bias, top, top_bias

    def activations(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs at every second sign."""
        n = len(x) // STRIDE
        padded = np.concatenate([x, np.zeros(WIDTH, np.int16)])
        out = np.broadcast_to(self.bias, (n, len(self.bias))).copy()
        for j in range(WIDTH):
            out += self.tables[j][padded[j : j + n * STRIDE : STRIDE]]
        return np.maximum(out, 0, out=out)

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's maximum of each filter, and the chunk's text. Long texts are taken a stretch of blocks at a time."""
        x, first = signs(texts)
        step = AT_ONCE // BLOCK * BLOCK
        parts = []
        # the last windows of a text begin in its padding and must not see the next text
        padding = np.maximum(self.bias + self.tables[:, 0].sum(axis=0), 0)
        last = (first[1:, None] * (BLOCK // STRIDE) - np.arange(1, WIDTH // STRIDE)).ravel()
        for at in range(0, len(x), step):
            piece = self.activations(x[at : at + step + WIDTH + STRIDE])[: len(x[at : at + step]) // STRIDE]
            piece[last[(last >= at // STRIDE) & (last < at // STRIDE + len(piece))] - at // STRIDE] = padding
            parts.append(piece.reshape(-1, BLOCK // STRIDE, piece.shape[1]).max(axis=1))
        tops = np.concatenate([*parts, np.zeros((1, len(self.bias)), np.float32)])
        begin, end, text = chunk_bounds(first)
        return np.maximum.reduceat(tops, np.column_stack([begin, end]).ravel(), axis=0)[::2], text

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        chunks, text = self.pooled(texts)
        starts = np.searchsorted(text, np.arange(len(texts)))
        count = np.diff([*starts, len(text)])[:, None]
        v = np.concatenate([np.add.reduceat(chunks.astype(np.float64), starts, axis=0) / count, np.maximum.reduceat(chunks, starts, axis=0)], axis=1)
        h = np.maximum(v @ self.hidden + self.hidden_bias, 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.top + self.top_bias, -60, 60)))


def train_network(samples: list[list[np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adam on the documents' log loss, back through both poolings to the signs that were the maxima.

    samples: for each document its chunks of signs, all of CHUNK_BLOCKS blocks (short ones padded with zeros).
    """
    rng = np.random.default_rng(seed)
    places = CHUNK_BLOCKS * BLOCK // STRIDE
    weights = [rng.normal(0, 0.15, (WIDTH, 512, FILTERS)), rng.uniform(0, 0.1, FILTERS), rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    weights[0][:, 0] = 0  # padding
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            chunks = np.stack([c for i in batch for c in samples[i]])
            text = np.repeat(np.arange(len(batch)), [len(samples[i]) for i in batch])
            starts = np.searchsorted(text, np.arange(len(batch)))
            count = np.diff([*starts, len(text)])[:, None]
            padded = np.concatenate([chunks, np.zeros((len(chunks), WIDTH), np.int16)], axis=1)
            out = np.zeros((len(chunks), places, FILTERS), np.float32) + weights[1].astype(np.float32)
            tables = weights[0].astype(np.float32)
            for j in range(WIDTH):
                out += tables[j][padded[:, j : j + places * STRIDE : STRIDE]]
            where = out.argmax(axis=1)
            top = np.take_along_axis(out, where[:, None], axis=1)[:, 0]
            pool = np.maximum(top, 0).astype(np.float64)
            mean = np.add.reduceat(pool, starts, axis=0) / count
            high = np.maximum.reduceat(pool, starts, axis=0)
            x = np.concatenate([mean, high], axis=1)
            pre = x @ weights[2] + weights[3]
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ weights[4] + weights[5], -60, 60)))
            d = (p - y[batch]) / len(batch)
            dh = np.outer(d, weights[4]) * (pre > 0)
            dx = dh @ weights[2].T
            dpool = dx[text, :FILTERS] / count[text]
            winner = pool == high[text]
            dpool += dx[text, FILTERS:] * winner / np.add.reduceat(winner.astype(float), starts, axis=0)[text]
            dpool *= top > 0
            grads = [np.zeros_like(weights[0]), dpool.sum(axis=0), x.T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()])]
            rows, filters = np.nonzero(dpool)
            spot = where[rows, filters] * STRIDE
            for j in range(WIDTH):
                grads[0][j] = np.bincount(padded[rows, spot + j].astype(np.int64) * FILTERS + filters, dpool[rows, filters], 512 * FILTERS).reshape(512, FILTERS)
            grads[0][:, 0] = 0
            t += 1
            rate = 0.01 if epoch < epochs * 0.7 else 0.003
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                weights[k] = weights[k] * (1 - 1e-4) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(weights[0], weights[1], weights[2], weights[3], weights[4], float(weights[5][0]))


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Network:
    """Learn from at most `most` labelled documents of each label, none of whose crc32(id as text) mod `parts` is `part`.

    The two labels are weighted by their shares among all rows that may be
    learnt from, so that scores are calibrated. Training sees all chunks of a
    document, cut on the executors; the driver holds those of at most 2 * most
    documents.
    """
    sample = labelled_sample(docs, labels, label, parts, part, most, id_col, text_col)
    size = CHUNK_BLOCKS * BLOCK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                x, first = signs([text.encode()])
                begin, end, _ = chunk_bounds(first)
                own = np.zeros((len(begin), size), "<i2")
                for k, (a, b) in enumerate(zip((begin * BLOCK).tolist(), (end * BLOCK).tolist())):
                    own[k, : b - a] = x[a:b]
                rows.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "chunks"])

    kind = docs.schema[id_col].dataType.simpleString()
    seen = sample.mapInArrow(cut, f"doc_id {kind}, label int, chunks binary").toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    y = seen["label"].to_numpy(np.float64)
    if len(np.unique(y)) < 2:  # nothing to tell apart
        share = 0.5 if not len(y) else 0.01 + 0.98 * y[0]
        return Network(np.zeros((WIDTH, 512, FILTERS)), np.zeros(FILTERS), np.zeros((2 * FILTERS, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    samples = [list(np.frombuffer(b, "<i2").reshape(-1, size).astype(np.int16)) for b in seen["chunks"]]
    network = train_network(samples, y)
    counts = {r["_y"]: r["n"] for r in labels.select(F.col(label).cast("int").alias("_y"), F.col(id_col).alias("_i")).filter(F.col("_y").isin(0, 1) & ~held_out(F.col("_i"), parts, part)).groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the sample holds the labels in other shares than the table does
    network.top_bias += float(np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum()))
    return network


def scored(text: Column, network: Network) -> Column:
    """The probability of label 1; a null text is empty."""

    def run(texts: pa.Array) -> pa.Array:
        data = [(t or "").encode() for t in texts.to_pylist()]
        out, at = [], 0
        while at < len(data):
            end, size = at, 0
            while end < len(data) and (end == at or size + len(data[end]) <= AT_ONCE):
                size += len(data[end])
                end += 1
            out.append(network.probabilities(data[at:end]))
            at = end
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(run, "double")(text)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, parts: int = 5, part: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (probability of label 1), predicted.

    The text alone is scored, as a whole. Null and empty texts score as
    padding does; null ids stay null (held_out as for the empty id); repeated
    rows score alike; null labels and labels without a document teach nothing;
    without both labels all rows get one score; an empty table gives no rows.
    """
    network = train(docs, labels, parts, part, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), scored(F.col(f"`{text_col}`").cast("string"), network).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
