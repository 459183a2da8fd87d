"""Quality rules, and robust multivariate outliers by minimum covariance determinants."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthloom.llm.common import SPACE, materialise, words

#: The transformed statistics, and the least spread that each is taken to have.
DIMS = {"z_words": 0.8, "z_length": 0.25, "z_symbols": 0.05, "z_lines": 0.08, "z_repeats": 0.12}
SUBSET = 0.75
STEPS = 4
#: Starts per group: medians and quartiles, then the rows of one id in PART each time.
STARTS = 3
PART = 4
CONFIDENCE = 0.9999
MIN_GROUP = 100
RUN = 8
KEYS = ("_lang", "_source", "_start")


def chi2_cdf(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= h / n
        total += term
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _counted(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """The counts of each text. Arrays that a lambda reads are columns of their own and read twice, so they are computed once a row."""
    w = docs.select(*keep, words(text).alias("_w"), F.coalesce(text, F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.char_length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    symbols = F.char_length(F.regexp_replace("_text", r"[^#*$%&|<>]+", ""))
    ids = [c for c in w.columns if c not in ("_w", "_text")]
    w = w.select(*ids, F.size("_w").cast("long").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), lines.alias("_lines"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    out = [*ids, "n_words", "word_chars", "n_symbols"]
    n_windows = F.greatest(F.size("_h") - (RUN - 1), F.lit(0))
    runs = F.when(n_windows > 0, F.transform(F.sequence(F.lit(1), F.greatest(n_windows, F.lit(1))), lambda i: F.xxhash64(F.slice("_h", i, RUN)))).otherwise(F.array().cast("array<bigint>"))
    w = w.select(*out, (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), runs.alias("_runs"))
    out.append("n_dup_lines")
    # only texts with a window twice sort their windows, to find where the equal ones are
    twice = F.size(F.array_distinct("_runs")) < F.size("_runs")
    at = F.when(twice, F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    w = w.select(*out, at.alias("_at"))
    same = lambda x, i, step: F.coalesce(F.get("_at", i + step)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_at", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))
    w = w.select(*out, places.alias("_p"))
    m = F.size("_p")
    gaps = F.zip_with(F.slice("_p", 1, F.greatest(m - 1, F.lit(0))), F.slice("_p", 2, F.greatest(m - 1, F.lit(0))), lambda a, b: F.least(F.lit(RUN), b - a).cast("long"))
    covered = F.when(m > 0, F.aggregate(gaps, F.lit(RUN).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))
    return w.select(*out, covered.alias("n_repeat_words"))


def _vector() -> list[Column]:
    """Statistics on scales on which ordinary texts lie evenly; a text's share of symbols, of repeated lines and of repeated words by their roots."""
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return [
        F.log(1 + n).alias("z_words"),
        F.log(1 + ratio(chars, n)).alias("z_length"),
        F.sqrt(ratio(F.col("n_symbols"), chars)).alias("z_symbols"),
        F.sqrt(ratio(F.col("n_dup_lines"), n)).alias("z_lines"),
        F.sqrt(ratio(F.col("n_repeat_words"), n)).alias("z_repeats"),
    ]


def _cholesky(dims: list[str]) -> list[tuple[str, Column]]:
    """Columns l_a_b of the lower factor, in an order in which each uses only earlier ones."""
    p, made = len(dims), []
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"c_{j}_{i}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            made.append((f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}")))
    return made


def _estimate(subset: DataFrame, scale: float) -> DataFrame:
    """Per group: centre m_i and the factor of the scatter, with the least spreads added. Means and co-moments are partial aggregates."""
    dims, floors = list(DIMS), list(DIMS.values())
    p = len(dims)
    found = [F.avg(d).alias(f"m_{i}") for i, d in enumerate(dims)]
    found += [(F.covar_pop(dims[i], dims[j]) * scale + (floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i, p)]
    out = subset.groupBy(*KEYS).agg(*found)
    for name, column in _cholesky(dims):
        out = out.withColumn(name, column)
    return out.select(*KEYS, *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])


def _least(groups: DataFrame) -> DataFrame:
    """Of each group the start whose scatter has the least determinant."""
    spread = F.lit(0.0)
    for i in range(len(DIMS)):
        spread = spread + F.log(f"l_{i}_{i}")
    rest = [c for c in groups.columns if c not in KEYS]
    best = groups.groupBy("_lang", "_source").agg(F.min(F.struct(spread.alias("d"), "_start", *rest)).alias("_b"))
    return best.select("_lang", "_source", *[F.col(f"_b.{c}").alias(c) for c in rest])


def _distance(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with _d2, their squared Mahalanobis distance from their group's centre; the groups join by size."""
    dims, p = list(DIMS), len(DIMS)
    on = groups.withColumnRenamed("_lang", "_gl").withColumnRenamed("_source", "_gs")
    out = rows.join(on, (F.col("_lang") == F.col("_gl")) & (F.col("_source") == F.col("_gs")), how)
    total = None
    for i in range(p):
        y = F.col(dims[i]) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"_y{k}")
        out = out.withColumn(f"_y{i}", y / F.col(f"l_{i}_{i}"))
        total = F.col(f"_y{i}") * F.col(f"_y{i}") if total is None else total + F.col(f"_y{i}") * F.col(f"_y{i}")
    return out.withColumn("_d2", total).drop(*[c for c in out.columns if c[:2] in ("m_", "l_", "_y", "_g")])


def robust_quality(docs: DataFrame, subset: float = SUBSET, steps: int = STEPS, confidence: float = CONFIDENCE, min_group: int = MIN_GROUP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept.

    base_failed: under 20 words, or over 30 % of them in 8-word windows that
    the text holds twice or more. Of the rest, each language and source gets
    its centre and scatter by minimum covariance determinant: from several
    starts (medians and quartiles, and shares of the rows by a hash of their
    ids), concentration steps re-estimate on the `subset` share of rows that
    lie nearest, and the start that ends with the least determinant counts.
    Rows beyond the chi-square quantile at
    `confidence` are rejected. A least spread in each statistic keeps groups
    whose rows are alike from rejecting their first exception.

    Groups under `min_group` rows are pooled over their language, and what is
    still too small over all; with too few rows in all, nothing but
    base_failed rejects. Null languages and sources are groups of their own;
    null and empty texts have no words and fail; repeated rows count each;
    other columns are not read; an empty table gives no rows.

    The statistics are written once to the shared folder; every later step
    reads a few numbers per row and moves only partial aggregates.
    """
    name = lambda c: F.concat(F.lit("="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")))
    keep = [F.col(f"`{id_col}`").alias("doc_id"), name(lang_col).alias("_lang"), name(source_col).alias("_source")]
    counted = _counted(docs, F.col(f"`{text_col}`").cast("string"), keep)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = materialise(counted.withColumn("base_failed", failed).select("*", *_vector()), "statistics")
    good = rows.filter(~F.col("base_failed"))
    # groups: own, else the language's, else all
    sizes = good.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_to", F.when(F.col("_n") >= min_group, F.col("_source")).otherwise("rest"))
    pooled = sizes.filter("_to = 'rest'").groupBy(F.col("_lang").alias("_pl")).agg(F.sum("_n").alias("_pn"))
    home = sizes.join(pooled, F.col("_lang") == F.col("_pl"), "left").select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), F.when((F.col("_to") == "rest") & (F.col("_pn") < min_group), "all").otherwise(F.col("_lang")).alias("_hl"), F.when((F.col("_to") == "rest") & (F.col("_pn") < min_group), "all").otherwise(F.col("_to")).alias("_hs"))
    home = materialise(home, "groups")
    placed = lambda df: df.join(home, (F.col("_lang") == F.col("_l")) & (F.col("_source") == F.col("_s")), "left").drop("_l", "_s", "_lang", "_source").withColumnsRenamed({"_hl": "_lang", "_hs": "_source"})
    good = placed(good)
    p, dims = len(DIMS), list(DIMS)
    # start: medians and quartiles, each statistic for itself
    mid = good.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(d, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q_{i}") for i, d in enumerate(dims)])
    mid = mid.filter(F.col("_n") >= min_group)
    spread = lambda i: F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(DIMS[dims[i]]))
    first = mid.select("_lang", "_source", F.lit(0).alias("_start"), *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(p) for j in range(i + 1)])
    part = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % PART).cast("int")
    large = mid.select(F.col("_lang").alias("_ml"), F.col("_source").alias("_ms"))
    shares = good.withColumn("_start", part).filter(F.col("_start").between(1, STARTS - 1))
    others = _estimate(shares, 1.0).join(large, (F.col("_lang") == F.col("_ml")) & (F.col("_source") == F.col("_ms")), "left_semi")
    groups = materialise(first.union(others), "start")
    # the scatter of the nearest rows is too small by a known factor
    scale = subset / chi2_cdf(chi2_quantile(subset, p), p + 2)
    for _ in range(steps):
        near = _distance(good, groups)
        edge = near.groupBy(*[F.col(k).alias(f"_e{k}") for k in KEYS]).agg(F.percentile_approx("_d2", subset, 1000).alias("_edge"))
        edge = materialise(edge, "edge")  # its size is then known
        inside = near.join(edge, (F.col("_lang") == F.col("_e_lang")) & (F.col("_source") == F.col("_e_source")) & (F.col("_start") == F.col("_e_start"))).filter(F.col("_d2") <= F.col("_edge"))
        groups = materialise(_estimate(inside, scale), "step")
    groups = materialise(_least(groups), "least")
    out = _distance(placed(rows), groups, "left")
    far = F.coalesce(F.col("_d2") > chi2_quantile(confidence, p), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("_d2").alias("distance2"), (~F.col("base_failed") & ~far).alias("kept"))
