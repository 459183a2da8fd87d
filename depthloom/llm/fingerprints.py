"""Document fingerprints from closed syncmers of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthloom.llm.common import materialise, words

K = 4
S = 2
#: Rows that a range of ids aims at, and ranges whose ends are quantiles; ranges are cut further to that aim.
ROWS_A_RANGE = 256
QUANTILES = 128
#: Rows of narrow numbers that one window orders; more are dealt out by ranges of their own.
ROWS_A_WINDOW = 20_000


def with_anchors(docs: DataFrame, text: Column, name: str, k: int = K, s: int = S) -> DataFrame:
    """docs with `name`: array of structs (at: word offset, hash: 64-bit) of the text's closed syncmers, in order.

    A k-mer of words is chosen if the least hash among its runs of s words is
    that of its first or last run. The choice looks at nothing outside the
    k-mer, so a passage has the same anchors wherever it stands. A text of
    fewer than k words, or without such a k-mer, is one anchor; one without
    words, or null, has none.
    Arrays that a lambda reads are columns of their own and read twice, so
    that they are computed once a row.
    """
    own = docs.columns
    m = k - s + 1  # runs of s words in a k-mer
    out = docs.select("*", words(text).alias("_sw"))
    out = out.select(*own, F.col("_sw"), F.transform("_sw", lambda w: F.xxhash64(w)).alias("_sh"))
    runs = F.when(F.size("_sh") >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size("_sh") - s, F.lit(0))), lambda i: F.xxhash64(*[F.get("_sh", i + j) for j in range(s)]))).otherwise(F.array().cast("array<bigint>"))
    whole = F.when((F.size("_sw") > 0) & (F.size("_sw") < k), F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.array_join("_sw", " ")).alias("hash")))).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))
    out = out.select(*own, runs.alias("_sr"), whole.alias("_whole"))
    least = lambda i: F.least(*[F.get("_sr", i + j) for j in range(m)]) if m > 1 else F.get("_sr", i)
    closed = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_sr") - m, F.lit(0))), lambda i: (least(i) == F.get("_sr", i)) | (least(i) == F.get("_sr", i + m - 1)))
    out = out.select(*own, F.col("_sr"), F.col("_whole"), F.when(F.size("_sr") >= m, closed).otherwise(F.array().cast("array<int>")).alias("_sc"))
    chosen = F.transform("_sc", lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get("_sr", i + j) for j in sorted({0, *range(0, m, s), m - 1})]).alias("hash")))
    none = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64("_sr").alias("hash")))
    return out.select(*own, F.when(F.size("_sc") > 0, chosen).when(F.size("_sr") >= m, none).otherwise(F.col("_whole")).alias(name))


def printed(anchors: str) -> Column:
    """The SHA-256 of all anchors of the named column, places and hashes, in order; empty without any."""
    listed = F.concat_ws("|", *[F.array_join(F.col(f"{anchors}.{x}").cast("array<string>"), " ") for x in ("at", "hash")])
    return F.when(F.size(anchors) == 0, "").otherwise(F.sha2(listed, 256))


def places(anchors: str) -> Column:
    """What two texts are matched by: each anchor with the next one and the words between them, wherever they stand; a lone anchor by itself. Distinct, from the named column."""
    of = lambda i: F.get(F.col(anchors), i)
    i = F.sequence(F.lit(0), F.greatest(F.size(anchors) - 2, F.lit(0)))
    pairs = F.transform(i, lambda i: F.xxhash64(of(i)["hash"], of(i + 1)["at"] - of(i)["at"], of(i + 1)["hash"]))
    return F.when(F.size(anchors) < 2, F.transform(F.col(anchors), lambda x: x["hash"])).otherwise(F.array_distinct(pairs))


def likeness(a: str, b: str, shared: str) -> Column:
    """Jaccard similarity of two texts from the named columns: their places, and how many they share; two texts without words are alike, one is like no other."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.col(shared) / (F.size(a) + F.size(b) - F.col(shared)).cast("double"))


def by_ranges(docs: DataFrame, key: str, rows: int = ROWS_A_RANGE, quantiles: int = QUANTILES) -> Column:
    """A bigint column that rises with the key, equal for about `rows` neighbours: quantile ranges, each cut evenly.

    The driver sees the table's size and the quantiles, at most `quantiles` + 1 numbers.
    """
    n, cuts = docs.agg(F.count(F.lit(1)), F.percentile_approx(key, F.array(*[F.lit(i / quantiles) for i in range(quantiles + 1)]), 1000)).first()
    ends = sorted(set(cuts or []))
    if len(ends) < 2:
        return F.lit(0).cast("bigint")
    parts = max(1, -(-n // (rows * (len(ends) - 1))))

    def tree(low: int, high: int) -> Column:
        if high - low == 1:
            a, width = ends[low], max(1, -(-(ends[high] - ends[low]) // parts))
            inside = F.least(F.greatest(F.floor(F.col(key) / F.lit(float(width)) - F.lit(a / width)), F.lit(0)), F.lit(parts - 1))
            return F.lit(low * parts).cast("bigint") + inside.cast("bigint")
        mid = (low + high) // 2
        return F.when(F.col(key) < F.lit(ends[mid]), tree(low, mid)).otherwise(tree(mid, high))

    return tree(0, len(ends) - 1)


def before_each(heads: DataFrame) -> DataFrame:
    """(_r, _for): for each number _range of heads, one row each, the greatest lower one, for the least the greatest. A few in one window; many by ranges of their own."""
    if heads.count() > ROWS_A_WINDOW:
        return with_next(heads.select(F.col("_range").alias("_at")), "_at", F.col("_at"), "_at").select(F.col("_at").alias("_r"), F.col("_next").alias("_for"))
    around = Window.orderBy(F.col("_range").desc())
    least = Window.partitionBy()
    return heads.select(F.col("_range").alias("_r"), F.coalesce(F.lead("_range").over(around), F.max("_range").over(least)).alias("_for"))


def with_next(docs: DataFrame, key: str, value: Column, tie: str) -> DataFrame:
    """docs with `_next`, the value of the next row by descending key (ties by descending `tie`), after the last the first.

    Rows are dealt out by ranges of the key; within a range a window finds the
    next row, and a range's last row takes the first of the next range. No
    window spans the table, nor that of the ranges where it is large. A null
    key or tie is less than any; rows equal in both follow one another; rows
    of one key share a range; other columns stay; an empty table gives none.
    """
    own = docs.columns
    ranged = docs.withColumn("_range", by_ranges(docs, key))
    order = Window.partitionBy("_range").orderBy(F.col(key).desc(), F.col(tie).desc())
    placed = ranged.withColumn("_value", value).withColumn("_next", F.lead("_value").over(order)).withColumn("_ends", F.lead(F.lit(True)).over(order).isNull())
    heads = materialise(ranged.groupBy("_range").agg(F.max(key).alias("_top")), "heads")  # its size is then known, and the texts need no shuffle to meet it while it is small
    tops = heads.select(F.col("_range").alias("_h"), "_top")
    first = ranged.join(tops, (F.col("_range") == F.col("_h")) & F.col(key).eqNullSafe(F.col("_top"))).groupBy("_range").agg(F.max(F.struct(F.col(tie).alias("by"), value.alias("value")))["value"].alias("_first"))
    follows = before_each(heads.select("_range"))
    firsts = first.join(follows, F.col("_range") == F.col("_for")).select("_r", "_first")
    return placed.join(firsts, F.col("_range") == F.col("_r"), "left").select(*own, F.when(F.col("_ends"), F.col("_first")).otherwise(F.col("_next")).alias("_next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last third (rounded down, in code points) is replaced
    by the first as many of the next document by descending id, or all it has;
    after the last comes the first. A fingerprint is a digest of all anchors of
    a text and their places, so equal texts have equal ones. near_edited and
    near_next match all anchors by position: the share of neighbouring anchors
    that both texts have at the same distance, wherever they stand.

    A null text counts as empty: no anchors, fingerprint ''. Null ids come
    after all others; rows of one id follow one another by descending text;
    a table of one row is its own next; other columns are not read; an empty
    table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("_key"), text.alias("_text"))
    follows = with_next(base, "_key", F.col("_text"), "_text")
    n = F.char_length("_text")
    third = F.floor(n / 3).cast("int")
    follows = follows.select("doc_id", "_text", "_next", n.cast("long").alias("n_chars"), F.concat(F.substring("_text", F.lit(1), n - third), F.substring("_next", F.lit(1), third)).alias("_edited"))
    out = follows
    for source, name in (("_text", "_a"), ("_edited", "_b"), ("_next", "_c")):
        own = out.columns
        print_ = [] if name == "_c" else [printed(name).alias(f"{name}_print")]
        out = with_anchors(out, F.col(source), name).select(*own, *print_, places(name).alias(name))
    out = out.select("*", *[F.size(F.array_intersect("_a", x)).alias(f"{x}_shared") for x in ("_b", "_c")])
    return out.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), F.col("_a_print").alias("fingerprint"), F.col("_b_print").alias("edited_fingerprint"), likeness("_a", "_b", "_b_shared").alias("near_edited"), likeness("_a", "_c", "_c_shared").alias("near_next"))
