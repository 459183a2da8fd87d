"""The learned scorers: exact marginals, gradients' results, held-out accuracy, awkward rows."""

import itertools
import math
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from depthloom.llm import quality_cnn, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=700, seed=3):
    """Clean and toxic prose, and junk, with rows that have nothing to say."""
    rng = random.Random(seed)
    syllables = ["ka", "to", "mi", "ren", "sol", "ta", "vi", "lu"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(15, 150))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbus", "Snarfel,", "blork" + word(), "wuzzle."]))
        if not good:
            words = [w + "###" for w in words] if rng.random() < 0.5 else [w for x in words for w in [x] * 9]
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, good, toxic, "clash"))
    docs += [(None, None, "x", 0.1), (n, "", "x", 0.1), (n + 1, None, None, None), (0, docs[0][1], "x", 0.1), (n + 2, "grumbus " * 30000, "y", 0.0)]
    labels += [(None, 1, 1, "x"), (n + 1, None, None, "x"), (0, 1, labels[0][2], "x"), (99999, 1, 1, "x")]
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, label string, score double").repartition(3), spark.createDataFrame(labels, LABELS)


def test_marginals_equal_enumeration():
    field = toxicity.Field({"=bad": 2.5, "=meh": -0.7, "=ill": 1.1}, -1.2, [[0.4, -0.3], [-0.6, 0.9]], 0.3, [0, 1, 0, 0])
    rng = random.Random(1)
    for _ in range(60):
        words = rng.choices(["bad", "meh", "ill", "xx", "yy", "zz"], weights=[1, 1, 1, 3, 3, 3], k=rng.randint(1, 10))
        places, got, n = field.tagged(" ".join(words))
        total, by = 0.0, [0.0] * n
        for tags in itertools.product((0, 1), repeat=n):
            s = field.start * tags[0] + sum(y * (field.bias + toxicity.weight(field.weights, w)) for y, w in zip(tags, words)) + sum(field.steps[a][b] for a, b in zip(tags, tags[1:]))
            total += math.exp(s)
            for i, y in enumerate(tags):
                by[i] += y * math.exp(s)
        assert np.allclose(got, [by[i] / total for i in places], atol=1e-12)
    places, got, n = field.tagged("xx " * 50000 + "bad " + "yy " * 50000)
    assert n == 100001 and places == [50000] and 0 < got[0] < 1


def test_field_learns_words_and_their_neighbours():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 4, (600, 12, 1))
    tags = (ids[..., 0] == 2).astype(int)
    tags[:, 1:] |= (ids[:, 1:, 0] == 3) & (tags[:, :-1] == 1)  # toxic only after another
    w, bias, steps, start = toxicity.train_field(ids.tolist(), tags.tolist(), 3)
    assert w[2] > 2 and w[2] > w[3] > w[1] and steps[1, 1] + steps[0, 0] > steps[0, 1] + steps[1, 0]


def held_out(i, parts, part):
    return zlib.crc32(("" if i is None else str(i)).encode()) % parts == part


def test_toxicity_on_held_out_documents(frames):
    docs, labels = frames
    rows = toxicity.toxicity(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    known = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None and r["doc_id"] is not None]
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in known]) > 0.97
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = [texts[r["doc_id"]][s["start"] : s["end"]].lower() for r in rows if r["predicted"] and r["doc_id"] is not None and r["doc_id"] < 700 for s in r["spans"]]
    assert words and np.mean([any(x in w for x in ("grumbus", "snarfel", "blork", "wuzzle")) for w in words]) > 0.95
    empty = {r["score"] for r in rows if not texts.get(r["doc_id"])}
    assert len(empty) == 1 and empty.pop() < 0.3
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    none = toxicity.toxicity(docs, labels.filter("toxic = 0")).filter("predicted = 1").count()
    assert none == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in rows)


def test_signs_mark_repeats_and_chunks_cover():
    text = b"For For For For For once upon"
    x, first = quality_cnn.signs([text, b"", b"For For "])
    assert (x[: len(text)] % 256).tolist() == list(text) and x[4] >= 256 and x[0] < 256 and x[25] < 256
    assert first.tolist() == [0, 2, 3, 4] and x[64] < 256
    for blocks in ([1, 8, 9, 15, 16, 200],):
        bounds = np.concatenate([[0], np.cumsum(blocks)])
        begin, end, of = quality_cnn.chunk_bounds(bounds)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            assert {k for s, e, t in zip(begin, end, of) if t == i for k in range(s, e)} == set(range(a, b))


def test_network_of_whole_texts_equals_plain_loops():
    rng = np.random.default_rng(5)
    f, h = quality_cnn.FILTERS, quality_cnn.HIDDEN
    net = quality_cnn.Network(rng.normal(size=(8, 512, f)), rng.normal(size=f), rng.normal(size=(2 * f, h)), rng.normal(size=h), rng.normal(size=h), 0.1)
    texts = [b"short", b"", bytes(rng.integers(1, 255, 3000, dtype=np.uint8).tolist()), b"the same the same the same " * 40]
    got = net.probabilities(texts)
    for text, p in zip(texts, got):
        x, first = quality_cnn.signs([text])
        pad = np.concatenate([x, np.zeros(16, int)])
        out = np.array([np.maximum(sum(net.tables[j][pad[t + j]].astype(float) for j in range(8)) + net.bias, 0) for t in range(0, len(x), 2)])
        begin, end, _ = quality_cnn.chunk_bounds(first)
        tops = np.array([out[a * 16 : b * 16].max(0) for a, b in zip(begin, end)])
        v = np.concatenate([tops.mean(0), tops.max(0)])
        z = np.maximum(v @ net.hidden + net.hidden_bias, 0) @ net.top + net.top_bias
        assert abs(p - 1 / (1 + np.exp(-np.clip(z, -60, 60)))) < 1e-3
    assert np.allclose(got, [net.probabilities([t])[0] for t in texts], atol=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n", max_size=90).map(str.encode), min_size=1, max_size=6))
def test_scores_do_not_depend_on_neighbours(texts):
    rng = np.random.default_rng(5)
    f, h = quality_cnn.FILTERS, quality_cnn.HIDDEN
    net = quality_cnn.Network(rng.normal(size=(8, 512, f)), rng.normal(size=f), rng.normal(size=(2 * f, h)), rng.normal(size=h), rng.normal(size=h), 0.1)
    x, first = quality_cnn.signs(texts)
    for i, text in enumerate(texts):
        assert (x[first[i] * quality_cnn.BLOCK : first[i + 1] * quality_cnn.BLOCK] == quality_cnn.signs([text])[0]).all()
    assert np.allclose(net.probabilities(texts), [net.probabilities([t])[0] for t in texts], rtol=1e-6)


def test_quality_on_held_out_documents(frames):
    docs, labels = frames
    rows = quality_cnn.quality(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    known = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None and r["doc_id"] is not None]
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in known]) > 0.95
    assert quality_cnn.quality(docs.limit(0), labels).count() == 0
    one = quality_cnn.quality(docs, labels.filter("quality = 1")).agg(F.min("score"), F.max("score")).first()
    assert one[0] == one[1] > 0.9
