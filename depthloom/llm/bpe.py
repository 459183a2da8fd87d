"""Byte-level byte-pair encoding: pieces, merges by heap and linked list, and caches of words.

A text is cut at single spaces and line ends before anything else. For a text
whose white-space runs are all one character long that cut falls where the
vocabulary's own pattern cuts, so words can be looked up in a cache; any other
text goes through the pattern as a whole.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import public_tokenizers
import regex

#: Fixed value: the public pattern that cuts a text into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space at a stretch that the faster library's pattern engine is not asked to cut; it gives up on a million.
LONG_GAP = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary's file: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bounded(dict):
    """A cache that computes what it lacks and starts anew when it is full, so a worker's memory stays bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Merger:
    """Counts the tokens of a text without making them.

    The count of a piece is its bytes less the merges; merges are found by
    taking the pair of lowest rank (the leftmost of equals) from a heap, over
    a doubly linked list of symbols.
    """

    def __init__(self, path: str, cached: int = 1_200_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.symbol = [0] * 256
        for letter, byte in letters.items():
            self.symbol[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.wide = max(vocab.values()).bit_length()
        self.rank = {vocab[a] << self.wide | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        special = sorted((x["content"] for x in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.markers = special
        self.find = regex.compile(PATTERN).findall
        self.pieces = Bounded(lambda piece: self.symbols_left(piece.encode()), cached // 8)
        self.first = Bounded(self.by_pattern, cached // 8)
        self.later = Bounded(lambda word: self.by_pattern(" " + word), cached)

    def symbols_left(self, piece: bytes) -> int:
        """Symbols of one piece after all merges."""
        symbol, wide, rank = self.symbol, self.wide, self.rank.get
        ids = [symbol[b] for b in piece]
        n = left = len(ids)
        if n < 2:
            return n
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(ids[i] << wide | ids[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push, made = heapq.heappop, heapq.heappush, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or rank(ids[i] << wide | ids[j]) != top >> 32:
                continue  # an older pair that a merge has changed
            new = ids[i] = made[top >> 32]
            ids[j] = -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << wide | ids[k])) is not None:
                    push(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(ids[h] << wide | new)) is not None:
                push(heap, r << 32 | h)
        return left

    def by_pattern(self, text: str) -> int:
        """The count of a text cut by the pattern; marker strings count one each."""
        if self.special and any(m in text for m in self.markers):
            plain = self.special.split(text)
            return len(plain) - 1 + sum(self.by_pattern(p) for p in plain if p)
        return sum(map(self.pieces.__getitem__, self.find(text)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        lines = lines_of_words(text)
        if lines is None:
            return self.by_pattern(text)
        total, later, first = (len(lines) - 1) * self.pieces["\n"], self.later.__getitem__, self.first
        for line in lines:
            head, *rest = line.split(" ")
            total += first[head] + sum(map(later, rest))
        return total


def lines_of_words(text: str) -> list[str] | None:
    """The lines of a text if cutting at every space and line end changes no piece, else None."""
    if "  " in text or " \n" in text:
        return None
    lines = text.split("\n")
    for line in lines:
        if not line or line[0].isspace():
            return None
    return lines


@lru_cache(maxsize=4)
def merger(name: str) -> Merger:
    return Merger(public_tokenizers.path(name))


class Encoder:
    """Token ids of whole texts as the tokenizers library gives them, as little-endian unsigned ids.

    Plain byte-level vocabularies go through tiktoken, which merges the pair
    whose joint bytes rank lowest. That is the library's own order where every
    merge has a token of its own and every such token, taken alone, merges
    into itself: two neighbours whose bytes join to a token are then that
    token's own pair. Both are looked at when a vocabulary is loaded; one that
    fails goes through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        import numpy as np

        self.np, self.tokenizer = np, Tokenizer.from_file(path)
        highest = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.kind = np.dtype("<u2" if highest < 1 << 16 else "<u4")
        self.fast = self.same = self.marker = None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if plain_bytes(spec):
            self.prepare(spec, Merger(path, 8))

    def prepare(self, spec: dict, merger: Merger) -> None:
        import tiktoken

        vocab, letters = spec["model"]["vocab"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        same = [0] * 256
        for letter, byte in letters.items():
            same[byte] = vocab[letter]
        ranks = {bytes([b]): b for b in range(256)}
        for m in spec["model"]["merges"]:
            token = "".join(m) if isinstance(m, list) else m.replace(" ", "", 1)
            if raw(token) in ranks or merger.symbols_left(raw(token)) != 1:
                return
            ranks[raw(token)] = len(same)
            same.append(vocab[token])
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.same = self.np.array(same, self.kind)
        self.ids = {x["content"]: self.np.array([x["id"]], self.kind).tobytes() for x in spec.get("added_tokens", [])}
        if merger.special:
            self.marker = regex.compile(f"({merger.special.pattern})").split

    def whole(self, text: str) -> bytes:
        """By the library."""
        return self.np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def plain(self, text: str) -> bytes:
        """Of a text without marker strings."""
        return self.same[self.np.array(self.fast(text), self.np.int64)].tobytes()

    def one(self, text: str) -> bytes:
        if self.fast is None or len(text) > LONG_GAP and regex.search(rf"\s{{{LONG_GAP}}}", text):
            return self.whole(text)
        try:
            if self.marker and any(m in text for m in self.ids):
                return b"".join(self.ids.get(part) or self.plain(part) for part in self.marker(text))
            return self.plain(text)
        except BaseException as error:  # its pattern engine has given up
            if type(error).__name__ != "PanicException":
                raise
            return self.whole(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, exactly as the library gives them."""
        return [self.one(t) if t else b"" for t in texts]


def plain_bytes(spec: dict) -> bool:
    """Whether a vocabulary cuts by PATTERN, merges bytes and does nothing else."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    usual = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
    markers = all(not any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for x in spec.get("added_tokens", []))
    return usual and markers and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    return Encoder(public_tokenizers.path(name))
