"""Hashed word shingles of whole texts, and one-permutation min-hash sketches with optimal densification."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random odd number for each byte, and the step of the rolling hash with its inverse modulo 2**64.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 20  # bytes of text at a time, so that working arrays stay small


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def permuted(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another permutation of a set's hashes, ascending."""
    return np.sort(mix(hashes ^ mix(np.array([salt], np.uint64))))


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled, step = 1, base
    while filled < n:
        m = min(filled, n - filled)
        out[filled : filled + m] = out[:m] * U(step)
        filled, step = filled + m, step * step % (1 << 64)
    return out


class Words:
    """Hashes of the words of texts, lower-cased in A-Z, by prefix sums of a rolling hash."""

    def __init__(self):
        self.up, self.down = powers(STEP, CHUNK + 1), powers(BACK, CHUNK + 1)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every word, and for each text where its words begin among them (one more entry at the end)."""
        return self.placed(texts)[:2]

    def placed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As for a call, and the joined lower-cased bytes with each word's first place and the place after its last."""
        data = np.frombuffer(b" ".join(texts), np.uint8)  # a space between texts parts their words
        ends = np.cumsum([len(t) + 1 for t in texts])
        if len(data) + 1 > len(self.up):
            up, down = powers(STEP, len(data) + 1), powers(BACK, len(data) + 1)
        else:
            up, down = self.up, self.down
        gap = SPACES[data]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        first, last = edge[0::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        lower = LOWER[data]
        np.cumsum(BYTE[lower] * up[: len(data)], out=total[1:])
        found = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        return found, np.concatenate([[0], np.searchsorted(first, ends)]), lower, first, last


def batches(texts: list[bytes]) -> list[list[bytes]]:
    """Texts in order, in runs of about CHUNK bytes."""
    out, size = [[]], 0
    for t in texts:
        if out[-1] and size + len(t) >= CHUNK:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t) + 1
    return out


def shingle_sets(texts: list[bytes], width: int, words: Words) -> list[np.ndarray]:
    """Each text's set of hashed shingles, ascending: runs of `width` words; all words as one run in a shorter text; none without words."""
    out = []
    for run in batches(texts):
        if not run:
            continue
        hashes, begins = words(run)
        if len(hashes) >= width:
            acc = np.zeros(len(hashes) - width + 1, np.uint64)
            for j in range(width):
                acc += hashes[j : j + len(acc)] * PLACE[j]
            rolled = mix(acc)
        else:
            rolled = np.zeros(0, np.uint64)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            if b - a >= width:
                own = np.sort(rolled[a : b - width + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                out.append(mix(np.array([(hashes[a:b] * PLACE[: b - a]).sum(dtype=np.uint64) + U(b - a)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class Sketcher:
    """One-permutation hashing into `bins` (a power of two): the least hash in each; an empty bin takes that of a bin drawn by a hash of its own number and the attempt."""

    def __init__(self, bins: int, bands: int, rows: int = 0):
        self.bins, self.bands, self.rows = bins, bands, rows or bins // bands
        self.edges = np.arange(bins, dtype=np.uint64) << U(64 - bins.bit_length() + 1)
        self.shift = U(64 - bins.bit_length() + 1)
        draws = np.random.default_rng(77)
        self.draw = draws.integers(0, bins, (512, bins))
        self.weights = draws.integers(1, 1 << 63, (bands, self.rows), dtype=np.uint64) * U(2) + U(1)
        self.salt = draws.integers(1, 1 << 63, bands, dtype=np.uint64)

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """Of a set that isn't empty, ascending."""
        at = np.searchsorted(hashes, self.edges)
        least = hashes[np.minimum(at, len(hashes) - 1)]
        full = (least >> self.shift) == np.arange(self.bins, dtype=np.uint64)
        out, empty, attempt = least.copy(), np.flatnonzero(~full), 0
        while len(empty):
            to = self.draw[attempt % 512][empty]
            good = full[to]
            out[empty[good]] = least[to[good]]
            empty, attempt = empty[~good], attempt + 1
            if attempt == 512:  # as good as impossible; any rule will do that depends on the set alone
                out[empty] = hashes[0]
                break
        return out

    def keys(self, sketch: np.ndarray) -> np.ndarray:
        """A 64-bit bucket key for each band."""
        rows = sketch[: self.bands * self.rows].reshape(self.bands, self.rows)
        return mix((rows * self.weights).sum(axis=1, dtype=np.uint64) + self.salt)
