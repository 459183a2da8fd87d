"""Near-duplicate documents: one-permutation min-hash with optimal densification, banded buckets, star-shaped candidates, and full sets to confirm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthloom.llm.common import bucketed, materialise
from depthloom.llm.components import components
from depthloom.llm.shingles import U, Sketcher, Words, mix, permuted, shingle_sets

WIDTH = 5
PERCENT = 85
#: Two sets at 0.85 miss every one of 25 bands of 5 rows once in two million pairs.
BINS, BANDS = 128, 25
#: Rounds for what the first stars leave apart in a bucket: rows a band and bands, each round over a permutation of its own.
ROUNDS = ((8, 32), (12, 64), (16, 128), (16, 128))


@lru_cache(maxsize=2)
def _tools(bins: int, bands: int) -> tuple[Words, Sketcher]:
    return Words(), Sketcher(bins, bands)


@lru_cache(maxsize=8)
def _fresh(rows: int, bands: int) -> Sketcher:
    return Sketcher(1 << (rows * bands - 1).bit_length(), bands, rows)


def _node(own: np.ndarray) -> int:
    """One number for a set, the same for equal sets."""
    total = int(mix(own ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + len(own) * 0x2545F4914F6CDD1D
    return int(mix(np.array([total % (1 << 64)], np.uint64))[0].view(np.int64))


def _sets(column: pa.Array, width: int, words: Words) -> list[np.ndarray]:
    return shingle_sets([(t or "").encode() for t in column.to_pylist()], width, words)


def signatures(docs: DataFrame, id_col: str, text_col: str, row: Column, width: int, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, row (its key, a bigint), n_shingles, node (one number for the set; null if empty), keys (a bucket per band)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sketcher = _tools(bins, bands)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                sets = _sets(rows.column(1), width, words)
                made = [sketcher.sketch(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([sketcher.keys(m).view(np.int64) if m is not None else None for m in made], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "row", "n_shingles", "node", "keys"],
                )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), row.alias("_row")).mapInArrow(sign, f"doc_id {kind}, row bigint, n_shingles bigint, node bigint, keys array<bigint>")


def _full_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, own): the full shingle sets of the nodes in `wanted` (node, first_doc), from their texts once more, in buckets by node.

    Rows of one id can hold several texts: each is taken for the node that its
    own set says it is, and those that nobody wants go.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = _tools(BINS, BANDS)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [s for s in _sets(batch.column(0).slice(at, 512), width, words) if len(s)]
                ends = np.cumsum([0] + [len(s) for s in sets])
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["node", "own"])

    ids = wanted.select(F.col("first_doc").alias("_doc")).distinct()
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    # one plan at every size: the ids grow with the table
    found = texts.join(ids.hint("merge"), F.col("_id").eqNullSafe(F.col("_doc")), "left_semi").select("_text").mapInArrow(resolve, "node bigint, own array<bigint>")
    return bucketed(found.join(wanted.select(F.col("node").alias("_want")), F.col("node") == F.col("_want"), "left_semi").dropDuplicates(["node"]), "node", "sets")


def _star_pairs(dealt: DataFrame, percent: int, centre: Column) -> DataFrame:
    """Pairs (a, b, la, lb) of a bucket's centre with its members of other labels, at most one for each row of dealt (node, label, n, key).

    centre: what a bucket takes its least of, a number of its own for each of
    its nodes. Sets whose sizes alone rule the similarity out make no pair.
    """
    by = dealt.withColumn("_by", centre).groupBy(F.col("key").alias("_k"))
    stars = by.agg(*[F.min_by(c, "_by").alias(x) for c, x in (("node", "a"), ("label", "la"), ("n", "na"))], F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x < _y")
    near = (100 * F.col("na") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("na"))
    met = dealt.join(stars, (F.col("key") == F.col("_k")) & (F.col("label") != F.col("la")) & near)
    return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), F.least("la", "label").alias("la"), F.greatest("la", "label").alias("lb")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the labels la and lb of the pairs whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(f"_{x}"), F.col("own").alias(f"_own_{x}"))
    met = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    both = F.size(F.array_intersect("_own_a", "_own_b")).cast("long")
    sizes = F.size("_own_a").cast("long") + F.size("_own_b").cast("long")
    return met.select(F.col("la").alias("a"), F.col("lb").alias("b"), both.alias("_both"), sizes.alias("_sum")).filter(100 * F.col("_both") >= percent * (F.col("_sum") - F.col("_both"))).select("a", "b").distinct()


def _dealt_anew(sets: DataFrame, labels: DataFrame, rows: int, bands: int, salt: int) -> DataFrame:
    """(node, label, n, key): the nodes in buckets of `bands` bands of `rows` rows, by a permutation of its own."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = _fresh(rows, bands)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [sketcher.keys(sketcher.sketch(permuted(np.array(own, np.int64).view(np.uint64), salt))).view(np.int64) for own in part.column(2).to_pylist()]
                each = pa.array(np.repeat(np.arange(len(found)), bands))
                keys = np.concatenate(found) if found else np.zeros(0, np.int64)
                sizes = pa.array(np.diff(part.column(2).offsets.to_numpy()).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(each), part.column(1).take(each), sizes.take(each), pa.array(keys)], names=["node", "label", "n", "key"])

    labelled = sets.join(labels.select(F.col("node").alias("_n"), "label"), F.col("node") == F.col("_n")).select("node", "label", "own")
    return materialise(labelled.mapInArrow(deal, "node bigint, label bigint, n bigint, key bigint"), "dealt")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after the links (a, b) between labels."""
    if links.isEmpty():
        return labels
    to = components(links).select(F.col("node").alias("_l"), F.col("label").alias("_to"))
    return materialise(labels.join(to, F.col("label") == F.col("_l"), "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")


def _judged(docs: DataFrame, row: Column, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rounds: tuple = ROUNDS) -> DataFrame:
    """Per row: doc_id, row, n_shingles, node, label (its component; null without a node), component_id (the component's least id).

    Rows with equal sets of shingles are one node. Nodes meet in banded
    buckets, and each is compared with its bucket's least node: at most one
    candidate per node and band. Two members may be similar that are both far
    from that centre, so the nodes that share a bucket are dealt anew in
    rounds: longer bands over a fresh permutation, in which unlike members
    part, and a centre drawn by a hash for each bucket. A round compares
    members with a centre of another component only, again at most one
    candidate per node and band. Full sets confirm all links.
    """
    rows = materialise(signatures(docs, id_col, text_col, row, width, BINS, bands), "signatures")
    classes = rows.filter("node is not null").groupBy(F.col("node").alias("_n")).agg(F.min("row").alias("_row"), F.min("doc_id").alias("first_doc"))
    nodes = materialise(rows.join(classes, F.col("row") == F.col("_row")).select("node", "first_doc", F.col("n_shingles").alias("n"), "keys"), "nodes")
    dealt = nodes.select("node", "first_doc", F.col("node").alias("label"), "n", F.explode("keys").alias("key"))
    shared = dealt.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select("_k")
    members = materialise(dealt.join(shared, F.col("key") == F.col("_k"), "left_semi"), "members")
    wanted = materialise(members.select("node", "first_doc").distinct(), "wanted")
    sets = _full_sets(wanted, docs, id_col, text_col, width)
    labels = wanted.select("node", F.col("node").alias("label"))
    links = materialise(_confirmed(_star_pairs(members, percent, F.col("node")), sets, percent), "links")
    labels = _relabelled(labels, links)
    for salt, (long, many) in enumerate(rounds, 1):
        dealt = _dealt_anew(sets, labels, long, many, salt)
        links = materialise(_confirmed(_star_pairs(dealt, percent, F.col("node").bitwiseXOR(F.xxhash64("key"))), sets, percent), "links")
        labels = _relabelled(labels, links)
    named = nodes.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "first_doc", F.coalesce("label", "node").alias("label"))
    least = named.groupBy(F.col("label").alias("_l")).agg(F.min("first_doc").alias("component_id"))
    named = named.join(least, F.col("label") == F.col("_l")).select(F.col("node").alias("_n"), "label", "component_id")
    out = rows.join(named, F.col("node") == F.col("_n"), "left")
    return out.select("doc_id", "row", "n_shingles", "node", "label", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. For the options see _judged.

    component_id is the least doc_id that a row reaches over links, kept
    whether that is its own. Null and empty texts have no shingles, link with
    nothing and are kept. A null id counts as greater than any; a component of
    null ids only has a null component_id and its rows are kept. Repeated rows
    of a kept id are all kept. Other columns are not read; an empty table
    gives no rows.
    """
    out = _judged(docs, F.monotonically_increasing_id(), id_col=id_col, text_col=text_col, **options)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near copies: of each component one row, of its least id (a null id counts as greater than any). All columns stay.

    Rows are told apart by a key of their own, not by their ids: unlike texts
    under one id or under null ids all stay, and so does each row without a
    shingle.
    """
    key = "_row"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")  # written, as a key must be the same each time it is read
    verdict = _judged(keyed, F.col(f"`{key}`"), id_col=id_col, text_col=text_col, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))["row"]
    chosen = verdict.filter("node is not null").groupBy("label").agg(first.alias("_kept")).select("_kept")
    kept = chosen.union(verdict.filter("node is null").select("row"))
    return keyed.join(kept, F.col(f"`{key}`") == F.col("_kept"), "left_semi").drop(key)
