"""Near-duplicates against brute force."""

import random
import re

import pytest

from depthloom.llm import minhash, shingles
from depthloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def grouped(rows, percent=85):
    """The rows' sets, the component of each row, and each component's least id (2**62 for none)."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[top(i)] = top(j)
    big = 1 << 62
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), big), big if d is None else d)
    return sets, [top(i) for i in range(len(rows))], low


def brute(rows, percent=85):
    sets, of, low = grouped(rows, percent)
    return [(d, len(s), None if low[c] == 1 << 62 else low[c]) for (d, _), s, c in zip(rows, sets, of)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = "new%d" % rng.randint(0, 10**6)
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = []
    for g in range(30):
        base = ["w%d" % rng.randint(0, 3000) for _ in range(rng.choice([6, 7, 20, 60, 200, 900]))]
        now = base
        for _ in range(rng.randint(1, 8)):  # chains: each copy edited from the one before
            texts.append("  ".join(now) if rng.random() < 0.3 else "\n".join(now).title())
            now = edited(rng, now, max(1, len(now) // 150) if len(now) > 30 else 0)
    texts += ["one", "ONE", "one two", "a b c d", "a b c d e", "A B C D E", "", None, " \n", "x " * 5000]
    rng.shuffle(texts)
    out = [(i * 3, t) for i, t in enumerate(texts)]
    return out + [out[5], out[5], (out[7][0], "another text under the same id as one before it"), (None, out[9][1]), (None, "only here and null of id"), (None, "only here and null of id")]


def test_components_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, node int, keys string").repartition(3)
    want = sorted(brute(rows), key=str)
    for percent in (85, 80):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, percent=percent, bands=25 if percent == 85 else 32).collect()), key=str)
        assert got == (want if percent == 85 else sorted(brute(rows, 80), key=str))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, extra int").repartition(3)
    out = minhash.without_near_duplicates(docs)
    sets, of, low = grouped(rows)
    of = [c for c, s in zip(of, sets) if s]  # rows without a shingle all stay
    want = [low[c] for c in set(of) if low[c] < 1 << 62] + [d for (d, _), s in zip(rows, sets) if not s and d is not None]
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(want)


def test_no_text_is_lost_with_its_id(spark, rows):
    """Null ids and ids of several texts: one row of each component stays, told by the texts."""
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _row int").repartition(3)
    out = minhash.without_near_duplicates(docs)
    low = lambda d: (d is None, d or 0)
    want = []
    for i, (d, t) in enumerate(rows):
        pairs = [(plain_set(t), plain_set(u), e) for e, u in rows] if d is None or [r[0] for r in rows].count(d) > 1 else []
        if pairs and plain_set(t):
            alike = [low(e) for a, b, e in pairs if b and 100 * len(a & b) >= 85 * len(a | b)]
            if low(d) == min(alike):
                want.append((str(d), tuple(sorted(plain_set(t)))))
    got = [(str(r["doc_id"]), tuple(sorted(plain_set(r["text"])))) for r in out.collect() if r["doc_id"] is None or [x[0] for x in rows].count(r["doc_id"]) > 1]
    assert out.columns == docs.columns and sorted(got) == sorted(set(want)) and ("None", (("only", "here", "and", "null", "of"), ("here", "and", "null", "of", "id"))) != got

    few = [(None, "one two three four five six"), (None, "only here without any id at all"), (None, "only here without any id at all"), (1, "one two three four five six"), (4, "seven eight nine ten eleven twelve"), (4, "one two three four five six"), (6, "red orange yellow green blue"), (6, "cold warm hot mild cool"), (7, ""), (None, None)]
    left = minhash.without_near_duplicates(spark.createDataFrame(few, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, left), key=str) == sorted([few[1], few[3], few[4], few[6], few[7], few[8], few[9]], key=str)


def test_members_that_only_their_neighbours_link(spark):
    """A chain in which most members are far from the bucket's centre."""
    rng = random.Random(2)
    now, rows = ["c%d" % i for i in range(300)], []
    for i in range(40):
        rows.append((i, " ".join(now)))
        now = edited(rng, now, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()) == sorted(brute(rows))


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 3), (9, 8), (7, 8), (7, 7), (20, 21), (2, 1)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {100 + i: 100 for i in range(61)}


def test_densified_sketches_estimate_similarity():
    import numpy as np

    rng, sketcher = np.random.default_rng(4), shingles.Sketcher(128, 25)
    for n in (8, 40, 300, 3000):
        found = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.sort(pool[: n + n // 2]), np.sort(pool[n // 2 :])
            found.append((sketcher.sketch(a) == sketcher.sketch(b)).mean())
        assert abs(np.mean(found) - 0.5) < 0.08


def test_recall_in_a_group_of_many_unlike_copies(spark):
    """Copies of one text with 1 to 60 edits each: most pairs of a bucket are too far apart, and stars must still find the links."""
    rng = random.Random(6)
    base = ["g%d" % i for i in range(300)]
    rows = [(i, " ".join(edited(rng, base, rng.randint(1, 60)))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    sets, of, low = grouped(rows)
    want = {d: low[c] for (d, _), c in zip(rows, of)}
    joined = len(rows) - len(set(want.values()))
    missed = len(set(got.values())) - len(set(want.values()))
    assert 0 <= missed <= 0.02 * joined and all(want[d] == want[c] for d, c in got.items())
