"""The native operators against plain Python, on rows with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from depthloom.llm import fingerprints, line_dedup, mixing, robust_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n string, _h int, _w string"


def sample(seed=5, n=120):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(60)] + ["#a#", "b|", "Über", "🙂x"]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.4:
            lines.insert(0, "Shared header line")
        if rng.random() < 0.2 and lines:
            lines += [lines[0]] * 2
        text = "\n".join(lines)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None]), len(text)))
    rows += [(200, None, "en", "s1", None), (201, "", "en", "s1", 0), (None, "no id", "en", None, 5), (7, rows[7][1], rows[7][2], rows[7][3], 1), (202, " \t\n \n", None, None, 6), (203, "x " * 30000, "en", "s2", 1)]
    return [r + ("clash", 1, "clash") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def test_line_dedup(docs, rows):
    out = line_dedup.line_dedup(docs, ratio=0.1, min_pages=3)
    assert out.columns == [*docs.columns, "n_dropped"]
    totals, held = Counter(), Counter()
    for r in rows:
        totals[r[3]] += 1
        held.update({(r[3], x) for x in (r[1] or "").split("\n") if WORD.search(x)})
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        keep = [x for x in lines if not (held[r[3], x] >= 3 and held[r[3], x] > 0.1 * totals[r[3]])]
        want.append((r[0], "\n".join(keep), len("\n".join(keep)), len(lines) - len(keep)))
    got = [(r["doc_id"], r["text"], r["n_chars"], r["n_dropped"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(x[3] for x in want)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows):
    out = robust_quality.robust_quality(docs)
    got = sorted(((r[0], *r[1:6], r["base_failed"]) for r in out.collect()), key=str)
    want = []
    for r in rows:
        c = plain_counts(r[1])
        want.append((r[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert got == sorted(want, key=str)
    assert all(not (r["base_failed"] and r["kept"]) for r in out.collect())
    assert robust_quality.robust_quality(docs.limit(0)).count() == 0


def test_determinant_steps_equal_numpy(spark):
    """The estimates and verdicts against the same steps in numpy, with planted outliers."""
    rng = np.random.default_rng(1)
    texts = []
    for i in range(600):
        body = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(30, 300)))
        texts.append(body if i % 25 else " ".join(w + "###" for w in body.split()))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in robust_quality.robust_quality(docs).collect()}
    floors, p = np.array(list(robust_quality.DIMS.values())), 5
    scale = robust_quality.SUBSET / robust_quality.chi2_cdf(robust_quality.chi2_quantile(robust_quality.SUBSET, p), p + 2)
    cut = robust_quality.chi2_quantile(robust_quality.CONFIDENCE, p)
    for s in (0, 1):
        ids = [i for i in range(s, 600, 2)]
        z = []
        for i in ids:
            n, chars, symbols, dup, rep = plain_counts(texts[i])
            z.append([np.log1p(n), np.log1p(chars / n), (symbols / chars) ** 0.5, (dup / n) ** 0.5, (rep / n) ** 0.5])
        z = np.array(z)
        lower = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
        m = np.array([lower(z[:, j], 0.5) for j in range(p)])
        spread = np.array([max((lower(z[:, j], 0.75) - lower(z[:, j], 0.25)) / 1.349, floors[j]) for j in range(p)])
        starts = [(m, np.diag(spread**2))]
        for k in range(1, robust_quality.STARTS):
            own = z[[zlib.crc32(str(i).encode()) % robust_quality.PART == k for i in ids]]
            starts.append((own.mean(0), np.cov(own.T, bias=True) + np.diag(floors**2)))
        ends = []
        for m, c in starts:
            for _ in range(robust_quality.STEPS):
                d = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)
                near = z[d <= lower(d, robust_quality.SUBSET)]
                m, c = near.mean(0), np.cov(near.T, bias=True) * scale + np.diag(floors**2)
            ends.append((np.linalg.det(c), m, c))
        _, m, c = min(ends, key=lambda e: e[0])
        d = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)
        assert np.allclose([out[i]["distance2"] for i in ids], d, rtol=1e-6)
        assert [out[i]["kept"] for i in ids] == (d <= cut).tolist()
    assert not any(out[i]["kept"] for i in range(0, 600, 25)) and np.mean([out[i]["kept"] for i in range(600) if i % 25]) > 0.99


def test_chi_square():
    assert abs(robust_quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(robust_quality.chi2_cdf(6.6257, 5) - 0.75) < 1e-4


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(1 << 63), (r[1] or "").encode()), reverse=True)
    want = []
    for r, after in zip(order, order[1:] + order[:1]):
        text, other = r[1] or "", after[1] or ""
        third = len(text) // 3
        want.append((r[0], len(text), hashlib.sha256((text[: len(text) - third] + other[:third]).encode()).hexdigest()))
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=str) == sorted(want, key=str)
    seen = {}
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert seen.setdefault(text_of[r["doc_id"]].split() == [] or text_of[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == "") == (not WORD.search(text_of[r["doc_id"]]))
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    one = fingerprints.fingerprints(docs.filter("doc_id = 3")).collect()
    assert one[0]["near_next"] == 1.0


def plain_print(text):
    """The fingerprint and the places of a text, by loops."""
    chain = lambda *xs: __import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x if isinstance(x, bytes) else x.to_bytes(8, "little"), seed), xs, 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = WORD.findall(text or "")
    if not w:
        return "", set()
    if len(w) < 4:
        anchors = [(0, chain(" ".join(w).encode()))]
    else:
        hashes = [chain(x.encode()) for x in w]
        runs = [chain(*hashes[i : i + 2]) for i in range(len(w) - 1)]
        anchors = []
        for i in range(len(w) - 3):
            least = min(map(signed, runs[i : i + 3]))
            if least in (signed(runs[i]), signed(runs[i + 2])):
                anchors.append((i, chain(runs[i], runs[i + 2])))
        anchors = anchors or [(0, chain(*runs))]
    listed = " ".join(str(a) for a, _ in anchors) + "|" + " ".join(str(signed(h)) for _, h in anchors)
    pairs = {chain(h, (b - a).to_bytes(4, "little"), g) for (a, h), (b, g) in zip(anchors, anchors[1:])}
    return hashlib.sha256(listed.encode()).hexdigest(), pairs or {anchors[0][1]}


def test_fingerprints_equal_loops(docs, rows):
    got = fingerprints.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(1 << 63), (r[1] or "").encode()), reverse=True)
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    want = []
    for r, after in zip(order, order[1:] + order[:1]):
        text, other = r[1] or "", after[1] or ""
        third = len(text) // 3
        (mine, a), (theirs, b), (_, c) = map(plain_print, (text, text[: len(text) - third] + other[:third], other))
        want.append((r[0], mine, theirs, round(like(a, b), 9), round(like(a, c), 9)))
    assert sorted([(r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=str) == sorted(want, key=str)


def test_next_rows_by_ranges_of_ranges(spark, monkeypatch):
    """Few rows a range and a window, so that ranges are ordered by ranges of their own."""
    monkeypatch.setattr(fingerprints, "ROWS_A_WINDOW", 6)
    monkeypatch.setattr(fingerprints, "by_ranges", lambda df, key: F.floor(F.col(key) / 7).cast("bigint"))
    ids = sorted({i * i for i in range(60)} | set(range(2000, 2100)))
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(3)
    got = {r["k"]: r["_next"] for r in fingerprints.with_next(df, "k", F.col("k"), "k").collect()}
    assert got == {b: a for a, b in zip(ids, ids[1:])} | {ids[0]: ids[-1]}


def test_anchors_are_context_free(spark):
    rng = random.Random(3)
    w = ["v%d" % rng.randint(0, 500) for _ in range(80)]
    df = spark.createDataFrame([(0, " ".join(w)), (1, "some other words first " + "  ".join(w) + " and after")], "id int, text string")
    a, b = (r["x"] for r in fingerprints.with_anchors(df, F.col("text"), "x").orderBy("id").collect())
    assert {x["hash"] for x in a} <= {x["hash"] for x in b} and 0.4 < len(a) / 77 < 0.95
    assert all(any(y["hash"] == x["hash"] and y["at"] == x["at"] + 4 for y in b) for x in a)


def test_long_texts_are_compared_whole(spark):
    rng = random.Random(6)
    texts = [["%s%d" % (x, rng.randint(0, 10**6)) for _ in range(5000)] for x in "abcd"]
    texts[1][700:800] = texts[2][4000:4100]  # a passage that two neighbours share
    texts[3] = texts[0][:2500] + ["other"] + texts[0][2501:]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = {i: plain_print(" ".join(t))[1] for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    for i, r in got.items():
        after = sets[(i - 1) % 4]
        assert abs(r["near_next"] - len(sets[i] & after) / len(sets[i] | after)) < 1e-12
    assert got[2]["near_next"] > 0.005 and got[0]["near_next"] > 0.99 and got[0]["fingerprint"] != got[3]["fingerprint"]


def test_ranges_hold_ties_and_sparse_ids(spark):
    ids = [5] * 40 + [i * i * 1000 for i in range(300)] + [None]
    df = spark.createDataFrame([(i, f"t{j}") for j, i in enumerate(ids)], "k long, t string").withColumn("k", F.coalesce("k", F.lit(-(1 << 63)).cast("bigint"))).repartition(3)
    found = fingerprints.by_ranges(df, "k", rows=8, quantiles=16)
    ranged = df.withColumn("r", found).collect()
    assert all(a["r"] <= b["r"] for a in ranged for b in ranged if a["k"] < b["k"]) and len({x["r"] for x in ranged}) > 10


def margin(spark, rows_, dim):
    sums = Counter()
    for r in rows_:
        sums[r[dim]] += r["tokens"] * r["w"]
    return sums


def test_mixing_margins_and_sql(spark, docs, rows):
    cells = docs.select("lang", "source", mixing.topic_of(F.coalesce("text", F.lit(""))).alias("topic"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n")).groupBy("lang", "source", "topic").agg(F.sum("n").alias("_t"))
    fitted = mixing.fitted_cells(cells, {"source": {"s1": 2.0, "s2": 1.0}, "lang": 0.5}, 0.02, sweeps=12).collect()
    by, total = Counter(), sum(r["_t"] for r in fitted)
    for r in fitted:
        by[r["source"]] += r["_p"] * r["_t"] / (0.02 * total)
    assert abs(by["s1"] - 2 / 3) < 1e-3 and abs(by["s2"] - 1 / 3) < 1e-3 and by[None] == 0
    out = mixing.mix(docs)
    assert out.count() == len(rows) and out.columns[: len(docs.columns)] == docs.columns
    same = out.groupBy("doc_id").agg(F.count_distinct("mix_kept").alias("n")).filter("n > 1").count()
    assert same == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mixing_asks_no_cell_for_more_than_it_has(spark):
    """A scarce topic gives all its tokens, the others the rest, and the sample comes near the targets."""
    rng = random.Random(4)
    rows = [(i, "License " * 3 if i % 40 == 0 else "a | b " * 5 if i % 3 else "plain words here " * 4, "en" if i % 5 else "de", f"s{i % 4}") for i in range(6000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, source string, mix_kept boolean")
    out = mixing.mix(docs.drop("mix_kept")).select("lang", "source", "mix_topic", "mix_tokens", "mix_probability", "mix_kept").toPandas()
    total = out["mix_tokens"].sum()
    assert out["mix_probability"].between(0, 1).all() and (out.loc[out["mix_topic"] == "licence", "mix_probability"] == 1).all()
    for dim, column in (("source", "source"), ("lang", "lang"), ("topic", "mix_topic")):
        tokens = out.groupby(column)["mix_tokens"].sum()
        most = tokens / (mixing.RATE * total)
        goal = tokens ** mixing.POWERS[dim] / (tokens ** mixing.POWERS[dim]).sum()
        sure = np.minimum(goal, most)
        goal = sure + (1 - sure.sum()) * (most - sure) / (most - sure).sum()
        for weight, error in ((out["mix_probability"], 0.005), (out["mix_kept"], 0.03)):  # as calibrated, and as sampled
            got = (weight * out["mix_tokens"]).groupby(out[column]).sum() / (mixing.RATE * total)
            assert (got - goal).abs().max() < error
    left = mixing.mixed(docs)
    assert left.columns == docs.columns and left.count() == out["mix_kept"].sum() and mixing.mixed(docs.limit(0)).count() == 0


def test_line_dedup_beside_a_column_of_its_own_name(spark):
    docs = spark.createDataFrame([(i, "the same head\nown %d" % i, "s", 77) for i in range(5)], "doc_id long, text string, source string, n_dropped int")
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_dropped_"] and {(r["text"], r["n_dropped"], r["n_dropped_"]) for r in out.collect()} == {("own %d" % i, 77, 1) for i in range(5)}


@pytest.mark.parametrize("name", ["mix", "lines"])
def test_sql_agrees(spark, docs, tmp_path, name):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    frame = mixing.report(spark, str(tmp_path)) if name == "mix" else line_dedup.line_dedup(spark.read.parquet(f"{tmp_path}/documents.parquet")).select("doc_id", "text", "n_dropped")
    want = con.sql(mixing.SQL if name == "mix" else line_dedup.SQL)
    got = sorted((tuple(r) for r in frame.select(want.columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
