"""Texts split into pre-tokens, and pre-tokens into ids, a batch at a time in numpy.

Both splits work on arrays of code points: a boundary lies where the class of the character changes, and the few rules that
look further (a space that joins the next word, contractions, white space before a word) move boundaries. Words are known by a
64-bit hash of their code points, so that a batch of texts is encoded by encoding each distinct word once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_SEED, _STEP = np.uint64(0x243F6A8885A308D3), np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, by the Unicode properties that the split patterns name."""
    points = "".join(map(chr, range(0xD800))) + "!" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.zeros(len(points), np.uint8)
    for m in regex.finditer(r"(\p{L}+)|(\p{N}+)|(\p{White_Space}+)", points):
        out[m.start() : m.end()] = m.lastindex
    return out


#: Characters of a text that are split at a time.
PIECE = 1 << 20
_SAFE = regex.compile(r"\p{L} \p{L}")


def pieces(text: str) -> list[str]:
    """A long text in pieces of about PIECE characters that split as the whole does: each ends with a letter before a single space and a letter."""
    out, at = [], 0
    while len(text) - at > 2 * PIECE:
        m = _SAFE.search(text, at + PIECE)
        if not m:
            break
        out.append(text[at : m.start() + 1])
        at = m.start() + 1
    return [*out, text[at:]]


def mix(h: np.ndarray) -> np.ndarray:
    """Fixed 64-bit finaliser: two xor-shift-multiply rounds."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans symbols[starts:ends], equal for equal spans wherever they stand. Spans are in order and don't overlap.

    A sum of the finaliser's values of (place in the span, symbol): no algebra of places or symbols lies under it that patterns in a text could meet."""
    n = len(symbols)
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    np.maximum.accumulate(begin, out=begin)
    place = np.arange(n) - begin
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix((place.astype(np.uint64) << np.uint64(32) | symbols) ^ _SEED), out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * _STEP)


def window_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of so many symbols (bytes, or hashes of words): of two windows that cover it each, from eight bytes, or one word, up."""
    if len(symbols) < width:
        return np.zeros(0, np.uint64)
    if symbols.dtype == np.uint8:
        if width < 8:
            raise ValueError("windows of bytes have eight at least")
        h, have = np.ndarray(len(symbols) - 7, "<u8", np.ascontiguousarray(symbols), strides=(1,)).astype(np.uint64), 8
    else:
        h, have = symbols.astype(np.uint64), 1
    h = mix(h ^ _SEED)
    while have < width:
        step = min(have, width - have)
        h = mix(h[:-step] * _STEP + h[step:])
        have += step
    return h


class Split:
    """Pre-tokens of some texts: code points, the span and hash of each pre-token, and the first pre-token of each text."""

    def __init__(self, texts: list[str], spaced: bool):
        """spaced: as public_tokenizers.PATTERN splits (a space joins what follows); else words, single digits and runs of signs, without white space."""
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        n = len(self.points)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=bounds[1:])
        kind = classes()[self.points]
        first = np.zeros(n + 1, bool)
        first[bounds[:-1]] = True
        begins = np.zeros(n + 1, bool)
        begins[:n] = first[:n]
        begins[1:n] |= kind[1:] != kind[:-1]
        begins[n] = first[n] = True
        if spaced:
            runs = np.flatnonzero(begins[:n] & (kind == SPACE))
            edges = np.flatnonzero(begins)
            after = edges[np.searchsorted(edges, runs, "right")]
            after = after[~first[after]]  # runs with a word behind them
            begins[after - 1] = True
            begins[after[self.points[after - 1] == 0x20]] = False
        else:
            begins[:n] |= kind == NUMBER
        self._contractions(begins, first, kind)
        starts = np.flatnonzero(begins[:n])
        ends = np.append(starts[1:], n)
        if not spaced:
            keep = kind[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        self.starts, self.ends = starts, ends
        self.bounds = np.searchsorted(starts, bounds)
        self.offsets = bounds
        self.hashes = span_hashes(self.points, starts, ends)

    def _contractions(self, begins: np.ndarray, first: np.ndarray, kind: np.ndarray) -> None:
        n, p = len(self.points), self.points
        at = np.flatnonzero(begins[:n] & (p == 0x27))
        at = at[at + 1 < n]
        at = at[~first[at + 1]]
        one = at[np.isin(p[at + 1], np.array([ord(c) for c in "stmd"], np.uint32))]
        rest = at[(at + 2 < n)] if len(at) else at
        rest = rest[~first[rest + 2]]
        pair = p[rest + 1].astype(np.uint64) << np.uint64(32) | p[rest + 2]
        two = rest[np.isin(pair, np.array([ord(x) << 32 | ord(y) for x, y in ("re", "ve", "ll")], np.uint64))]
        for where, width in ((one, 2), (two, 3)):
            begins[where + 1] = False
            begins[where + width] = True

    def words(self, which: np.ndarray) -> list[str]:
        return [self.points[a:b].tobytes().decode("utf-32-le") for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]


class WordIds:
    """Ids of words met before, by hash; encode(list of words) -> list of id lists is asked for new ones only.

    It holds at most `limit` words and starts anew beyond them, so its memory has a bound."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 700_000, recent: int = 60_000):
        self.encode, self.limit, self.recent = encode, limit, recent
        self._clear()

    def _clear(self) -> None:
        empty = lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.levels = [empty(), empty()]
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]

    def spans(self, split: Split) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each pre-token begin, and how many they are."""
        distinct, where, inverse = np.unique(split.hashes, return_index=True, return_inverse=True)
        if len(self.levels[0][0]) + len(self.levels[1][0]) + len(distinct) > self.limit and len(self.levels[0][0]):
            self._clear()
        start, size, missing = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), np.ones(len(distinct), bool)
        for keys, starts, sizes in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                hit = keys[at] == distinct
                start[hit], size[hit] = starts[at[hit]], sizes[at[hit]]
                missing &= ~hit
        new = np.flatnonzero(missing)
        if len(new):
            ids = self.encode(split.words(where[new]))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            start[new], size[new] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(flat)
            self.levels[1] = self._merge(self.levels[1], (distinct[new], start[new], size[new]))
            if len(self.levels[1][0]) > self.recent:
                self.levels = [self._merge(*self.levels), tuple(x[:0] for x in self.levels[1])]
        return start[inverse], size[inverse]

    def ids(self, split: Split) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the first id of each text."""
        start, size = self.spans(split)
        flat, ends = gather(self.pool, start, size)
        return flat, np.append(0, ends)[split.bounds]


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of the pool one after another, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - ends + size, size) + np.arange(total)], ends
