"""Mixing by iterative proportional fitting over source, language and topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthloom.llm.common import WORD, materialise

#: Margins: a power of the tokens that each value has (0: all values alike, 1: as they are).
POWERS = {"source": 0.0, "lang": 0.5, "topic": 0.5}
RATE = 0.5
SWEEPS = 8


def topic_of(text: Column) -> Column:
    """A coarse topic by the text's form: table, licence, long or short."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("License")), "licence").when(F.char_length(text) >= 4000, "long").otherwise("short")


def sums_of(df: DataFrame, *columns: str | Column) -> list[float]:
    """One number for each column or expression."""
    return [float(x or 0) for x in df.agg(*[F.sum(c) for c in columns]).first()]


def goal_table(cells: DataFrame, dim: str, margin: float | dict[str, float], rate: float, total: float) -> DataFrame:
    """(_v, _g): the share that each value of a margin shall have, over the cells' `_t` tokens of `total`.

    A value can give its own tokens and no more; what its target lacks goes to
    the others in proportion to the tokens that they have left.
    """
    by = cells.groupBy(dim).agg(F.sum("_t").alias("_t"))
    if isinstance(margin, dict):
        pairs = [F.lit(x) for k, v in margin.items() for x in (k, float(v))]
        by = by.withColumn("_g", F.coalesce(F.element_at(F.create_map(*pairs), F.col(dim)), F.lit(0.0)))
    else:
        by = by.withColumn("_g", F.pow(F.col("_t"), F.lit(float(margin))))
    by = materialise(by, "goal")
    (all_,) = sums_of(by, "_g")
    most = F.col("_t") / F.lit(rate * total or 1.0)
    by = by.select(F.col(dim).alias("_v"), most.alias("_most"), F.least(F.col("_g") / F.lit(all_ or 1.0), most).alias("_c"))
    given, left = sums_of(by, "_c", F.col("_most") - F.col("_c"))
    return by.select("_v", (F.col("_c") + F.lit((1 - given) / left if left else 0.0) * (F.col("_most") - F.col("_c"))).alias("_g"))


def fitted_cells(cells: DataFrame, margins: dict[str, float | dict[str, float]], rate: float = RATE, sweeps: int = SWEEPS) -> DataFrame:
    """Rake the cells' token shares to the margins: the cells with `_p`, the share of their tokens that is kept.

    cells has one row per combination of values, `_t` its tokens. A margin is
    a power of its natural token totals, or a dict of target weights by value
    (a value without one gets none). A cell whose weight asks for more tokens
    than it has gives all; the sweeps that follow ask the others for the rest.
    Sums are partial aggregates; a sweep is written to the shared folder, so
    the plan doesn't grow.
    """
    cells = materialise(cells.withColumn("_t", F.col("_t").cast("double")), "cells")
    (total,) = sums_of(cells, "_t")
    full = rate * total or 1.0
    fit = cells.withColumn("_w", F.col("_t") / F.lit(total or 1.0))
    for i, (dim, margin) in enumerate(margins.items()):
        goal = goal_table(cells, dim, margin, rate, total).withColumnRenamed("_g", f"_g{i}")
        fit = fit.join(goal, F.col(dim).eqNullSafe(F.col("_v"))).drop("_v")
    fit = materialise(fit, "cells")
    for _ in range(sweeps):
        for i, dim in enumerate(margins):
            now = fit.groupBy(F.col(dim).alias("_u")).agg(F.sum("_w").alias("_s"))
            asked = F.when(F.col("_s") > 0, F.col("_w") * F.col(f"_g{i}") / F.col("_s")).otherwise(0.0)
            fit = fit.join(now, F.col(dim).eqNullSafe(F.col("_u"))).withColumn("_w", F.least(asked, F.col("_t") / F.lit(full))).drop("_u", "_s")
        fit = materialise(fit, "cells")
    return fit.select(*margins, "_t", F.when(F.col("_t") > 0, F.least(F.lit(1.0), F.lit(full) * F.col("_w") / F.col("_t"))).otherwise(0.0).alias("_p"))


def mix(docs: DataFrame, margins: dict[str, float | dict[str, float]] | None = None, rate: float = RATE, sweeps: int = SWEEPS, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """All rows and columns of docs with mix_topic, mix_tokens, mix_probability and mix_kept.

    Tokens are words. A document of a cell with tokens t and fitted share w is
    kept with probability rate * all tokens * w / t, by a hash of its id, so
    the same id is always kept or always left out. No fitted share asks a cell
    for more than it has, so no probability is cut afterwards. A document
    without a word adds no tokens: its probability is that of its cell, or 0
    where the cell has no tokens at all.

    Null sources, languages and texts are values of their own (a null text has
    no words and the topic short); null ids hash as the empty text; repeated
    rows fall alike; columns of docs named like the four new ones stay, beside
    them; an empty table gives no rows. Very long texts are read whole. One
    aggregate over the table; the cells, one row for each combination of
    values, join back by size, so no text is shuffled while they are small.
    """
    margins = margins or POWERS
    names = docs.columns
    inner, fitted = _placed(docs, margins, rate, sweeps, text_col, topic)
    id_ = F.col(f"c{[n.lower() for n in names].index(id_col.lower())}")
    topic_out = F.col("_d_topic") if "topic" in margins else F.lit(None).cast("string")
    return inner.join(fitted, _same(margins)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], topic_out.alias("mix_topic"), F.col("_n").alias("mix_tokens"), F.col("_p").alias("mix_probability"), (_draw(id_) < F.col("_p")).alias("mix_kept"))


def mixed(docs: DataFrame, margins: dict[str, float | dict[str, float]] | None = None, rate: float = RATE, sweeps: int = SWEEPS, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """The rows of docs that mix() keeps, with their own columns, whatever those are called. Nulls, ties and empty tables as there."""
    margins = margins or POWERS
    inner, fitted = _placed(docs, margins, rate, sweeps, text_col, topic)
    id_ = F.col(f"c{[n.lower() for n in docs.columns].index(id_col.lower())}")
    return inner.join(fitted, _same(margins)).filter(_draw(id_) < F.col("_p")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _placed(docs: DataFrame, margins: dict, rate: float, sweeps: int, text_col: str, topic: Column | None) -> tuple[DataFrame, DataFrame]:
    """The rows with their cells and words, columns numbered, and the fitted cells with numbered keys."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    dims = {d: (topic if topic is not None else topic_of(text)) if d == "topic" else F.col(f"`{d}`") for d in margins}
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], *[v.alias(f"_d_{d}") for d, v in dims.items()], F.regexp_count(text, F.lit(WORD)).cast("long").alias("_n"))
    cells = inner.groupBy(*[f"_d_{d}" for d in dims]).agg(F.sum("_n").alias("_t"))
    fitted = fitted_cells(cells, {f"_d_{d}": m for d, m in margins.items()}, rate, sweeps)
    return inner, fitted.select(*[F.col(f"_d_{d}").alias(f"_k{i}") for i, d in enumerate(dims)], "_p")


def _same(margins: dict) -> Column:
    """Whether a row lies in a cell."""
    out = F.lit(True)
    for i, d in enumerate(margins):
        out = out & F.col(f"_d_{d}").eqNullSafe(F.col(f"_k{i}"))
    return out


def _draw(id_: Column) -> Column:
    """A number from 0 to 1, the same for the same id."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def report(spark, sf_dir: str) -> DataFrame:
    from depthloom.llm.common import read

    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select("doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def _sql() -> str:
    steps = ["""docs AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n,
 CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), 'License') THEN 'licence' WHEN length(coalesce(text, '')) >= 4000 THEN 'long' ELSE 'short' END AS topic FROM documents)""",
             "tokens AS (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS t FROM docs GROUP BY ALL)",
             "w0 AS (SELECT *, sum(t) OVER () AS total, t / sum(t) OVER () AS w FROM tokens)"]
    for dim, power in POWERS.items():
        steps.append(f"""a_{dim} AS (SELECT {dim}, sum(t) / ({RATE} * any_value(total)) AS most, pow(sum(t), {power}) / sum(pow(sum(t), {power})) OVER () AS g FROM w0 GROUP BY {dim}),
g_{dim} AS (SELECT {dim}, least(g, most) + coalesce((1 - sum(least(g, most)) OVER ()) / nullif(sum(most - least(g, most)) OVER (), 0), 0) * (most - least(g, most)) AS goal FROM a_{dim})""")
    at = 0
    for _ in range(SWEEPS):
        for dim in POWERS:
            steps.append(f"w{at + 1} AS MATERIALIZED (SELECT c.* EXCLUDE (w), least(CASE WHEN s > 0 THEN c.w * goal / s ELSE 0 END, c.t / ({RATE} * c.total)) AS w FROM w{at} c JOIN (SELECT {dim}, sum(w) AS s FROM w{at} GROUP BY {dim}) x ON c.{dim} IS NOT DISTINCT FROM x.{dim} JOIN g_{dim} g ON c.{dim} IS NOT DISTINCT FROM g.{dim})")
            at += 1
    return "WITH " + ",\n".join(steps) + f"""
SELECT d.doc_id, d.topic, CAST(d.n AS BIGINT) AS n_tokens, round(p, 6) AS probability, CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept
FROM docs d JOIN (SELECT source, lang, topic, CASE WHEN t > 0 THEN least(1.0, {RATE} * total * w / t) ELSE 0 END AS p FROM w{at}) c
ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic"""


SQL = _sql()
