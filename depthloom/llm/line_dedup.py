"""Site-relative line frequency: lines on too large a share of a site's pages are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.01
MIN_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(host, h) of the lines to drop, and (host, h) with the page's columns for every line with a word.

    Lines are keyed by a 64-bit hash, so the shuffles carry no text. A page
    counts once for a line however often it holds it. Counting is a partial
    aggregate, so a line on a third of all pages costs one row per task.
    """
    spoken = F.filter(_lines(F.col(text_col)), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    on_page = pages.withColumn("_h", F.explode(F.array_distinct(F.transform(spoken, lambda x: F.xxhash64(x)))))
    keyed = on_page.select("*", host.alias("_host"))
    counts = keyed.groupBy("_host", "_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_pages)
    totals = pages.select(host.alias("_host_of")).groupBy("_host_of").agg(F.count(F.lit(1)).alias("_pages"))
    frequent = counts.join(totals, F.col("_host").eqNullSafe(F.col("_host_of"))).filter(F.col("_n") > ratio * F.col("_pages"))
    return frequent.select("_host", "_h"), keyed


def line_dedup(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source") -> DataFrame:
    """All rows and columns of docs, the text without its site's boilerplate lines, and n_dropped (n_dropped_ where docs has a column of that name).

    A line is boilerplate for a site if at least `min_pages` of its pages hold
    it and their share of the site's pages exceeds `ratio`. Lines are what
    line ends cut; lines without a word are never boilerplate. A text keeps
    its other lines in order; one that loses all is empty, and its row stays.

    Null text becomes the empty text; null sites form one site; null ids and
    repeated rows are pages like any other, each counted; `n_chars`, where
    there is one, is brought up to date; an empty table gives no rows. Only
    hashes are counted and joined; the text is shuffled once, to meet the
    (few) lines that its row must lose.
    """
    host = F.col(host) if isinstance(host, str) else host
    names = docs.columns
    # columns get private names, so that none can clash
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], host.alias("_site"))
    doc, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    frequent, keyed = boilerplate(inner.select(doc, text, "_site"), F.col("_site"), text, ratio, min_pages)
    lost = (
        keyed.select(F.col(doc).alias("_doc"), "_host", "_h")
        .join(frequent.select(F.col("_host").alias("_bad_host"), F.col("_h").alias("_bad")), F.col("_host").eqNullSafe(F.col("_bad_host")) & (F.col("_h") == F.col("_bad")))
        .groupBy("_doc", "_host")
        .agg(F.collect_set("_bad").alias("_lost"))
    )
    joined = inner.join(lost.hint("shuffle_hash"), F.col(doc).eqNullSafe(F.col("_doc")) & F.col("_site").eqNullSafe(F.col("_host")), "left")
    all_lines = _lines(F.col(text))
    kept = F.filter(all_lines, lambda x: ~F.array_contains(F.col("_lost"), F.xxhash64(x)))
    clean = joined.withColumn("_kept", F.when(F.col("_lost").isNull(), F.lit(None)).otherwise(kept))
    new_text = F.when(F.col("_kept").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join("_kept", "\n"))
    dropped = F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.size(all_lines) - F.size("_kept"))
    out = clean.select(*[F.col(f"c{i}") for i in range(len(names)) if f"c{i}" != text], new_text.alias(text), dropped.alias("_n_dropped"))
    put = {text_col: F.col(text)} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in names else {})
    count = "n_dropped"
    while count in {c.lower() for c in names}:
        count += "_"
    return out.select(*[put.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(names)], F.col("_n_dropped").alias(count))


SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents),
cut AS (SELECT rid, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM pages),
held AS (SELECT DISTINCT rid, source, line FROM cut WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
bad AS (SELECT h.source, h.line FROM held h JOIN totals t ON h.source IS NOT DISTINCT FROM t.source
        GROUP BY h.source, h.line, t.pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * t.pages),
marked AS (SELECT c.*, b.line IS NOT NULL AS lost FROM cut c LEFT JOIN bad b ON c.source IS NOT DISTINCT FROM b.source AND c.line = b.line)
SELECT p.doc_id, coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (NOT m.lost), '') AS text,
       CAST(sum(CASE WHEN m.lost THEN 1 ELSE 0 END) AS INT) AS n_dropped
FROM pages p JOIN marked m USING (rid) GROUP BY p.rid, p.doc_id
"""
