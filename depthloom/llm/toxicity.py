"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthloom.llm.bpe import Bounded
from depthloom.llm.common import held_out, materialise
from depthloom.llm.samples import labelled_sample

#: Labelled documents of each label to learn from, at most.
SAMPLE = 3000
#: Toxic documents that a word or prefix must occur in to be a feature, and the share of its documents that must be toxic.
MIN_DOCS = 3
MIN_SHARE = 0.2
#: Toxic documents and share from which a feature marks its tokens as toxic where the document is.
LABEL_DOCS = 5
LABEL_SHARE = 0.75
PREFIXES = (3, 4, 5, 6, 7, 8)
WINDOW = 12
WINDOWS_A_DOC = 6
CACHED_WORDS = 400_000
THRESHOLD = 0.7
EDGES = ".,!?|#*$%&()[]{}:;\"'`~<>-_+=/\\"


def features(word: str) -> list[str]:
    """A token's features: its letters in lower case without the signs around it, and their prefixes."""
    w = word.lower().strip(EDGES)
    return [f"={w}", *(f"{k}{w[:k]}" for k in PREFIXES if len(w) > k)] if len(w) > 1 else []


def weight(weights: dict[str, float], word: str) -> float:
    return sum(w for f in features(word) if (w := weights.get(f)) is not None)


def summary(marginals: list[float], n: int) -> tuple[float, float, float]:
    """What a document's score rests on: its likeliest toxic token, the expected number of them, and their share."""
    mass = sum(marginals)
    return max(marginals, default=0.0), math.log1p(mass), math.log1p(100 * mass / max(n, 1))


class Field:
    """The trained field over tags 0 and 1, and the logistic that turns a document's marginals into its score."""

    def __init__(self, weights: dict[str, float], bias: float, steps: list[list[float]], start: float, logistic: list[float]):
        self.weights, self.bias, self.steps, self.start, self.logistic = weights, bias, steps, start, logistic
        # a token without known features multiplies by `plain`; runs of them are powers, by the two projections
        a, b = math.exp(steps[0][0]), math.exp(steps[0][1] + bias)
        c, d = math.exp(steps[1][0]), math.exp(steps[1][1] + bias)
        root = math.sqrt((a - d) ** 2 + 4 * b * c)
        big, small = (a + d + root) / 2, (a + d - root) / 2
        self.ratio = small / big
        self.lead = [(a - small) / (big - small), b / (big - small), c / (big - small), (d - small) / (big - small)]
        # the cache knows the weights, not the field: a cycle would keep every task's cache until a late collection
        self.words = Bounded(lambda word: weight(weights, word), CACHED_WORDS)

    def __reduce__(self):
        return Field, (self.weights, self.bias, self.steps, self.start, self.logistic)

    def run(self, n: int) -> tuple[float, float, float, float]:
        """The product of n tokens without features, up to a factor."""
        p, q, r, s = self.lead
        fade = self.ratio**n
        return p + fade * (1 - p), q - fade * q, r - fade * r, s + fade * (1 - s)

    def marginals(self, places: list[int], weights: list[float], n: int) -> list[float]:
        """P(tag 1) at each place with features, in a text of n tokens; exact, as the other tokens enter by powers."""
        (t00, t01), (t10, t11) = [[math.exp(x) for x in row] for row in self.steps]
        odds = [math.exp(min(50.0, self.bias + w)) for w in weights]
        ahead = []
        # f: forward weights of the tags of the token before `at`; none before the first
        f0, f1, at = 1.0, 0.0, -1
        plain = math.exp(self.bias)
        for place, odd in zip(places, odds):
            gap = place - at - 1
            if at < 0:
                if gap == 0:
                    f0, f1 = 1.0, math.exp(self.start) * odd
                else:
                    f0, f1 = 1.0, math.exp(self.start) * plain
                    gap -= 1
            if at >= 0 or place > 0:
                if gap > 0:
                    p, q, r, s = self.run(gap)
                    f0, f1 = f0 * p + f1 * r, f0 * q + f1 * s
                f0, f1 = f0 * t00 + f1 * t10, (f0 * t01 + f1 * t11) * odd
            total = f0 + f1
            f0, f1, at = f0 / total, f1 / total, place
            ahead.append((f0, f1))
        out = [0.0] * len(places)
        b0 = b1 = 1.0
        after = n
        for i in range(len(places) - 1, -1, -1):
            gap = after - places[i] - 1
            if after < n:  # through the next place with features
                b0, b1 = t00 * b0 + t01 * odds[i + 1] * b1, t10 * b0 + t11 * odds[i + 1] * b1
            if gap > 0:
                p, q, r, s = self.run(gap)
                b0, b1 = p * b0 + q * b1, r * b0 + s * b1
            total = b0 + b1
            b0, b1, after = b0 / total, b1 / total, places[i]
            f0, f1 = ahead[i]
            out[i] = f1 * b1 / (f0 * b0 + f1 * b1)
        return out

    def tagged(self, text: str) -> tuple[list[int], list[float], int]:
        """The places of tokens with features, their marginals, and the number of tokens."""
        words = text.split()
        weights = list(map(self.words.__getitem__, words))
        places = [i for i, w in enumerate(weights) if w]
        return places, self.marginals(places, [weights[i] for i in places], len(words)) if places else [], len(words)

    def score(self, marginals: list[float], n: int) -> float:
        x = sum(a * b for a, b in zip(self.logistic, (1.0, *summary(marginals, n))))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

    def spans(self, text: str, places: list[int], marginals: list[float], least: float = 0.5) -> list[dict]:
        """Code-point offsets of the tokens that are likelier toxic than not."""
        hit = {p: m for p, m in zip(places, marginals) if m >= least}
        return [{"start": m.start(), "end": m.end(), "p": hit[i]} for i, m in enumerate(re.finditer(r"\S+", text)) if i in hit] if hit else []


def train_field(windows: list[list[list[int]]], tags: list[list[int]], n_features: int, rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray, float]:
    """Conditional likelihood of the tags of fixed-length windows, by adaptive gradient steps; gradients from forward-backward."""
    ids = np.array(windows, np.int64)  # window, token, feature slot; 0 is no feature
    y = np.array(tags, np.int64)
    n, length, _ = ids.shape
    w, bias, steps, start = np.zeros(n_features + 1), -3.0, np.zeros((2, 2)), 0.0
    size = [np.full(n_features + 1, 1e-8), 1e-8, np.full((2, 2), 1e-8), 1e-8]
    moved = np.zeros((2, 2))
    np.add.at(moved, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    for _ in range(rounds):
        e = w[ids].sum(axis=2) + bias
        f, b = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        f[:, 0, 1] = start + e[:, 0]
        for t in range(1, length):
            f[:, t, 0] = np.logaddexp(f[:, t - 1, 0] + steps[0, 0], f[:, t - 1, 1] + steps[1, 0])
            f[:, t, 1] = np.logaddexp(f[:, t - 1, 0] + steps[0, 1], f[:, t - 1, 1] + steps[1, 1]) + e[:, t]
        for t in range(length - 2, -1, -1):
            to0, to1 = b[:, t + 1, 0], b[:, t + 1, 1] + e[:, t + 1]
            b[:, t, 0] = np.logaddexp(steps[0, 0] + to0, steps[0, 1] + to1)
            b[:, t, 1] = np.logaddexp(steps[1, 0] + to0, steps[1, 1] + to1)
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])[:, None]
        p1 = np.exp(f[..., 1] + b[..., 1] - z)
        pairs = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] = np.exp(f[:, :-1, i] + steps[i, j] + (e[:, 1:] if j else 0) + b[:, 1:, j] - z).sum()
        miss = y - p1
        gw = np.bincount(ids.ravel(), np.repeat(miss.ravel(), ids.shape[2]), n_features + 1) / n - decay * w
        gw[0] = 0
        grads = [gw, miss.sum() / n, (moved - pairs) / n, miss[:, 0].sum() / n]
        for k, g in enumerate(grads):
            size[k] = size[k] + g * g
        w = w + rate * 4 * grads[0] / np.sqrt(size[0])
        bias += rate * grads[1] / np.sqrt(size[1])
        steps = steps + rate * grads[2] / np.sqrt(size[2])
        start += rate * grads[3] / np.sqrt(size[3])
    return w, float(bias), steps, float(start)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Newton steps; the ridge keeps separable data finite."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return [float(v) for v in w]


def train(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Field:
    """Learn from at most `most` labelled documents of each label, none of whose crc32(id as text) mod `parts` is `part`.

    Words and prefixes that occur mostly in toxic documents are the features.
    Of these the sure ones mark tokens: toxic in toxic documents. The field is
    trained on windows of WINDOW tokens around features, at most WINDOWS_A_DOC
    of a document and spread evenly over it, the hard clean ones among them; then a logistic on the sample's marginals. With no toxic sample,
    every score is low. Counting and cutting of windows run on the executors;
    what reaches the driver is bounded by the sample.
    """
    sample = materialise(labelled_sample(docs, labels, label, parts, part, most, id_col, text_col).dropDuplicates(["doc_id"]), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {f for w in set(text.split()) for f in features(w)}
                seen.update(own)
                if y:
                    toxic.update(own)
        names = list(toxic)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([seen[f] for f in names], pa.int64())], names=["f", "t", "n"])
        rest = [f for f in seen if f not in toxic]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([seen[f] for f in rest], pa.int64())], names=["f", "t", "n"])

    totals = sample.select("label", "text").mapInArrow(count, "f string, t bigint, n bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    rows = totals.filter((F.col("t") >= MIN_DOCS) & (F.col("t") >= MIN_SHARE * F.col("n"))).orderBy("f").collect()
    index = {r["f"]: i + 1 for i, r in enumerate(rows)}
    sure = {r["f"] for r in rows if r["t"] >= LABEL_DOCS and r["t"] >= LABEL_SHARE * (r["n"] + 1)}
    slots = 1 + len(PREFIXES)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, ys = [], [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                found = [[index[f] for f in features(w) if f in index] for w in words]
                marked = [int(bool(y) and any(f in sure for f in features(w))) if x else 0 for w, x in zip(words, found)]
                places = [i for i, x in enumerate(found) if x]
                picked = places[:: max(1, -(-len(places) // WINDOWS_A_DOC))] or ([len(words) // 2] if words else [])
                for place in picked:
                    a = max(0, min(place - WINDOW // 2, len(words) - WINDOW))
                    own, mark = found[a : a + WINDOW], marked[a : a + WINDOW]
                    pad = WINDOW - len(own)
                    ids.append([v for x in own + [[]] * pad for v in (x + [0] * slots)[:slots]])
                    tags.append(mark + [0] * pad)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(tags, pa.list_(pa.int32()))], names=["ids", "tags"])

    cut = sample.select("label", "text").mapInArrow(windows, "ids array<int>, tags array<int>").toArrow()
    if not cut.num_rows or not index:
        return Field({}, -3.0, [[0.0, 0.0], [0.0, 0.0]], 0.0, [-5.0, 0.0, 0.0, 0.0])
    ids = np.array(cut.column("ids").combine_chunks().values).reshape(-1, WINDOW, slots)
    tags = np.array(cut.column("tags").combine_chunks().values).reshape(-1, WINDOW)
    order = np.lexsort(np.concatenate([ids.reshape(len(ids), -1), tags], axis=1).T)  # the same model whatever the order of the rows
    w, bias, steps, start = train_field(ids[order], tags[order], len(index))
    field = Field({f: float(w[i]) for f, i in index.items() if w[i]}, bias, steps.tolist(), start, [0.0, 1.0, 0.0, 0.0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(*field.tagged(t)[1:]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[i] for x in found], pa.float64()) for i in range(3)]], names=["label", "top", "mass", "share"])

    seen = sample.select("label", "text").mapInArrow(measure, "label int, top double, mass double, share double").toPandas()
    seen = seen.sort_values(["label", "top", "mass", "share"])
    field.logistic = fit_logistic(seen[["top", "mass", "share"]].to_numpy(), seen["label"].to_numpy())
    return field


def scored(text: Column, field: Field) -> Column:
    """struct(score, spans) of a text; a null text is empty."""

    def run(texts: pa.Array) -> pa.Array:
        scores, spans = [], []
        for text in texts.to_pylist():
            places, marginals, n = field.tagged(text or "")
            scores.append(field.score(marginals, n))
            spans.append(field.spans(text, places, marginals) if marginals and max(marginals) >= 0.5 else [])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["score", "spans"])

    return F.arrow_udf(run, "struct<score: double, spans: array<struct<start: int, end: int, p: double>>>")(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, parts: int = 3, part: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, spans (code-point offsets of likely toxic tokens with their marginals).

    The text alone is scored, as a whole. A null or empty text has no toxic
    token and gets the low score of such texts; null ids stay null (held_out
    as for the empty id); repeated rows score alike; labels that are null or
    without a document teach nothing; an empty table gives no rows.
    """
    field = train(docs, labels, parts, part, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), scored(F.col(f"`{text_col}`").cast("string"), field).alias("_s"))
    return out.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), F.col("_s.score").alias("score"), (F.col("_s.score") >= threshold).cast("int").alias("predicted"), F.col("_s.spans").alias("spans"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    field = train(docs, labels, id_col=id_col, text_col=text_col)
    return docs.withColumn("_toxicity_score", scored(F.col(f"`{text_col}`").cast("string"), field)["score"]).filter(F.col("_toxicity_score") < threshold).drop("_toxicity_score")
