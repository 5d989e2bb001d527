"""Exact removal of repeated byte strings by a sparse suffix array, built by deep-shallow sorting.

A byte goes if a string of WIDTH bytes that covers it also starts anywhere else. Sorting a suffix for each byte of a corpus
would move hundreds of bytes for each, so the array is sparse, without losing a string:

1. Anchors. Of each WIDTH-byte window the least hash of its GRAM-byte strings (the last of equals) is its anchor. Equal windows have equal anchors at equal
   places, so a window can be repeated only if its anchor's string is, and an anchor's windows form one run (about 175 bytes).
   An anchor goes into the shuffle as its string's hash, its run and a hash of the run's bytes.
2. An anchor whose string is no other anchor's settles its run: nothing is repeated there. Runs that are equal as a whole are repeated as a whole: copies of any number are counted
   (aggregated before the shuffle) and need no further work. What is left are runs that share the anchor but differ: the edges of repeated passages.
3. These, and one run of each set of equal ones, are sorted around the anchor: suffixes from it and, reversed, prefixes before it. Groups
   of one anchor are sorted by multikey quicksort steps (eight bytes a step) to SHALLOW bytes; what is still equal then goes into blind tries,
   which order it by comparing each string with one other. Two windows at one distance before their anchors are equal if their prefixes agree to that distance and their suffixes for
   the rest; both follow from the sorted orders and the lengths of the neighbours' common prefixes.
4. An anchor with more than HOT different runs is not put into one task. Its runs are cut into slices by the distance of windows from the anchor. All windows of a slice hold the same core of
   the text, so slices of different cores share no window, and slices that are equal as a whole are counted, as runs are. Only where slices of one core differ, at the edges of
   a frequent passage, their few windows are hashed and counted (aggregated before the shuffle).

A rule says what the strings are made of: bytes (BYTES, width 400), or words (PASSAGES, any 51 words in a row). Words stand between white space
and are compared without the signs (ASCII other than letters and digits) at their ends, so quotes around a passage or another line break in it hide nothing. Each becomes a
64-bit hash, and the steps above go over hashes as they do over bytes. The rules of a call go through them together, and what any of them finds goes.

Texts are read in slabs of SLAB bytes, so memory doesn't grow with a text's length but for the hashes of its words and in the last step, which returns the text.

Edge cases: a null text counts as empty; texts shorter than WIDTH lose nothing; rows that repeat a doc_id and text repeat each other; a row is known by doc_id and
a hash of its text, so null and repeated doc_ids are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import quoted
from .lsh_forest import _SPACES, _slabs
from .pretokens import mix, span_hashes, window_hashes
from .runtime import bites, cut, cuts, ddl, forget, from_rows, partitions, texts, with_columns

WIDTH, GRAM = 400, 50
SHALLOW = 32
#: Runs of one anchor that one task may get, and into how many slices those of other anchors are cut.
HOT, SLICES = 256, 8
SLAB = 1 << 19
_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_STEP = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Rule:
    """Strings of `width` symbols are looked for, by anchors of `gram` symbols. A symbol is a byte or a word's hash."""

    width: int
    gram: int
    words: bool = False

    @property
    def size(self) -> int:
        """Bytes of a symbol in a run."""
        return 8 if self.words else 1


BYTES = Rule(WIDTH, GRAM)
#: Passages of over 50 words.
PASSAGES = Rule(51, 8, words=True)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(_SPACES[data], prepend=True, append=True))
    return edge[0::2], edge[1::2]


def word_hashes(raws: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words without the signs at their ends; a word of signs alone counts as it is."""
    if len(raws) == 1 and len(raws[0]) > 2 * SLAB:
        return [np.concatenate([word_hashes([part, b""])[0] for part in _slabs(raws[0])])]
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    starts, ends = word_spans(data)
    inner = np.append(np.flatnonzero(_WORD[data]), len(data))
    first = inner[np.searchsorted(inner, starts)]
    last = inner[np.searchsorted(inner, ends) - 1] + 1
    signs = first >= ends
    h = span_hashes(data, np.where(signs, starts, first), np.where(signs, ends, last))
    return np.split(h, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))[:-1])


def symbols(raws: list[bytes], rule: Rule) -> list[np.ndarray]:
    return word_hashes(raws) if rule.words else [np.frombuffer(r, np.uint8) for r in raws]


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[: n - width + 1], from_left[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """Of texts that stand in data one after another: (text, anchor, first window, last window, hash of the anchor's string, hash of the run's symbols).

    Places are counted in data; rows are in order of place."""
    n = len(data)
    if n < rule.width:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    place = np.arange(n - rule.gram + 1)
    h = window_hashes(data, rule.gram)
    low = np.uint64(0xFFFFFFFF)
    least = _sliding_min((h & ~low) | (low - place.astype(np.uint64)), rule.width - rule.gram + 1)
    anchor = (low - (least & low)).astype(np.int64)
    lengths = np.diff(offsets)
    whole = np.flatnonzero(lengths >= rule.width)
    starts = np.concatenate([np.arange(offsets[i], offsets[i + 1] - rule.width + 1) for i in whole]) if len(whole) else np.zeros(0, np.int64)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    a = anchor[starts]
    new = np.append(True, (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    a = a[new]
    # A run's hash: of the grams that cover it one after another, each at its number, and the last one.
    size = last + rule.width - first
    grams = size // rule.gram
    ends = np.cumsum(grams)
    number = np.arange(ends[-1]) - np.repeat(ends - grams, grams)
    each = mix(h[np.repeat(first, grams) + number * rule.gram] + number.astype(np.uint64) * _STEP)
    run = mix(np.add.reduceat(each, ends - grams) + mix(h[last + rule.width - rule.gram] ^ size.astype(np.uint64)))
    return np.searchsorted(offsets, a, "right") - 1, a, first, last, h[a], run


def slabs(given: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, offsets, row of each piece, place of each piece in its text): all texts of a batch as symbols, long ones in overlapping pieces."""
    pieces, rows, places, total = [], [], [], 0
    for row, whole in enumerate(given):
        for at in range(0, max(1, len(whole) - width + 1), SLAB):
            piece = whole[at : at + SLAB + width - 1]
            if len(piece) < width:
                continue
            pieces.append(piece)
            rows.append(row)
            places.append(at)
            total += len(piece)
            if total >= SLAB:
                yield _slab(pieces, rows, places)
                pieces, rows, places, total = [], [], [], 0
    if pieces:
        yield _slab(pieces, rows, places)


def _slab(pieces: list, rows: list, places: list) -> tuple:
    return np.concatenate(pieces), np.cumsum([0] + [len(p) for p in pieces]), np.array(rows), np.array(places)


_KEY = [("k1", pa.int64()), ("k2", pa.int64())]
_ANCHOR = pa.schema([("rule", pa.int32()), ("h", pa.int64()), ("run", pa.int64()), *_KEY, ("at", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_RUN = pa.schema([("hot", pa.bool_()), ("rule", pa.int32()), ("h", pa.int64()), *_KEY, ("first", pa.int64()), ("before", pa.int64()), ("data", pa.binary()), ("slice", pa.int32()), ("core", pa.int64()), ("whole", pa.int64()), ("w", pa.list_(pa.int64()))])
_RANGE = pa.schema([*_KEY, ("rule", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _find(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for batch in bites(batches, "text", 1 << 20):
        k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
        raws = [t.encode() for t in texts(batch)]
        for number, rule in enumerate(rules):
            for data, offsets, rows, places in slabs(symbols(raws, rule), rule.width):
                text, a, first, last, h, run = anchors(data, offsets, rule)
                move = places[text] - offsets[text]
                row = rows[text]
                columns = [np.full(len(a), number, np.int32), h.view(np.int64), run.view(np.int64), k1[row], k2[row], a + move, first + move, last + move]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ANCHOR)


def _digest(part: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sliced(part: np.ndarray, before: int, rule: Rule) -> Iterator[tuple]:
    """(first window, its distance before the anchor, slice, digest of the core, digest of all, hashes of the windows) of a run's slices; its first window is `before` ahead of the anchor."""
    w = window_hashes(part, rule.width).view(np.int64).tolist()
    far = rule.width - rule.gram + 1
    size = -(-far // SLICES)
    for number in range((before - len(w) + 1) // size, before // size + 1):
        near, beyond = number * size, min((number + 1) * size, far)
        a, b = max(0, before - beyond + 1), min(len(w), before - near + 1)
        core = part[before - near : before - beyond + 1 + rule.width]
        yield a, before - a, number, _digest(core), _digest(part[a : b - 1 + rule.width]), w[a:b]


def _fetch(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    """The symbols of the wanted runs of each text, words as eight bytes each; of an anchor with too many runs a row for each slice."""
    for batch in bites(batches, "text", 1 << 20):
        rows = []
        raws = [t.encode() for t in texts(batch)]
        for number, rule in enumerate(rules):
            for k1, k2, given, wanted in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2")), symbols(raws, rule), batch.column("wanted").to_pylist(), strict=True):
                for x in wanted:
                    if x["rule"] != number:
                        continue
                    first, before = x["first"], x["at"] - x["first"]
                    part = given[first : x["last"] + rule.width]
                    if x["hot"]:
                        rows += [(True, number, x["h"], k1, k2, first + a, d, None, *rest) for a, d, *rest in _sliced(part, before, rule)]
                    else:
                        rows.append((False, number, x["h"], k1, k2, first, before, (part.astype(">u8") if rule.words else part).tobytes(), None, None, None, None))
        yield from_rows(rows, _RUN)


class BlindTrie:
    """Orders byte strings: a walk looks only at branching bytes, then one comparison with the leaf it came to tells the place."""

    __slots__ = ("root", "strings")

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def add(self, i: int) -> None:
        """A node is [depth, {byte or -1 at the end: node}]; a leaf is a list of equal strings' numbers, with depth -1 before it."""
        if self.root is None:
            self.root = [-1, [i]]
            return
        s = self.strings[i]
        n, node = len(s), self.root
        while node[0] >= 0:
            d, branches = node
            node = branches.get(s[d] if d < n else -1) or next(iter(branches.values()))
        other = self.strings[node[1][0]]
        common = _common(s, other)
        if common == n == len(other):
            node[1].append(i)
            return
        parent, byte, node = None, 0, self.root
        while 0 <= node[0] < common or node[0] == common:
            parent, byte = node, s[node[0]] if node[0] < n else -1
            if byte not in node[1]:
                node[1][byte] = [-1, [i]]
                return
            node = node[1][byte]
        new = [common, {(s[common] if common < n else -1): [-1, [i]], (other[common] if common < len(other) else -1): node}]
        if parent is None:
            self.root = new
        else:
            parent[1][byte] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out.extend(node[1])
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def deep_shallow(group: np.ndarray, strings: list[bytes], skip: int = 0) -> np.ndarray:
    """The order of the strings by (group, string): multikey quicksort to SHALLOW bytes behind `skip` (equal in a group), then blind tries."""
    n = len(strings)
    order = np.argsort(group, kind="stable")
    tied = np.append(False, group[order][1:] == group[order][:-1])
    for depth in range(skip, skip + SHALLOW, 8):
        # Only runs of ties are sorted on.
        inside = tied | np.append(tied[1:], False)
        at = np.flatnonzero(inside)
        if not len(at):
            return order
        label = np.cumsum(~tied)[at]
        word = np.frombuffer(b"".join(strings[i][depth : depth + 8].ljust(8, b"\0") for i in order[at].tolist()), ">u8")
        by = np.lexsort((word, label))
        order[at] = order[at][by]
        label, word = label[by], word[by]
        tied[at] = np.append(False, (label[1:] == label[:-1]) & (word[1:] == word[:-1]))
    begin = np.flatnonzero(~tied)
    for a, b in zip(begin.tolist(), np.append(begin[1:], n).tolist(), strict=True):
        if b - a > 1:
            trie = BlindTrie(strings)
            for i in order[a:b].tolist():
                trie.add(i)
            order[a:b] = trie.order()
    return order


def neighbour_lengths(group: np.ndarray, strings: list[bytes], order: np.ndarray) -> np.ndarray:
    """The common prefix of each string of the order with the one before it; -1 where another group begins."""
    out = np.full(len(order), -1, np.int64)
    same = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    for i in same.tolist():
        out[i] = _common(strings[order[i - 1]], strings[order[i]])
    return out


def repeated_windows(group: np.ndarray, runs: list[bytes], before: np.ndarray, rule: Rule = BYTES) -> list[np.ndarray]:
    """For each run, which of its windows another window equals; before: symbols ahead of the anchor. Groups share the anchor's string."""
    n, size = len(runs), rule.size
    windows = np.array([len(r) // size - rule.width + 1 for r in runs])
    base = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    right = [r[b * size :] for r, b in zip(runs, before.tolist(), strict=True)]
    left = [r[b * size - 1 :: -1] if b else b"" for r, b in zip(runs, before.tolist(), strict=True)]
    orders = [(o := deep_shallow(group, s, skip), neighbour_lengths(group, s, o) // size) for s, skip in ((right, rule.gram * size), (left, 0))]
    classes = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for distance in range(rule.width - rule.gram + 1):
        at = np.flatnonzero((before >= distance) & (before - distance < windows))
        if len(at) < 2:
            continue
        for (order, lengths), need, c in zip(orders, (rule.width - distance, distance), classes, strict=True):
            c[order] = np.cumsum(lengths < need)
        key = classes[0][at] * n + classes[1][at]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.append(same, False) | np.append(False, same)
        hit = at[by[twice]]
        out[base[hit] + before[hit] - distance] = True
    return np.split(out, base[1:])


def _sort(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    data = pa.Table.from_batches(got)
    for number, rule in enumerate(rules):
        own = data.filter(pc.equal(data.column("rule"), number))
        if not own.num_rows:
            continue
        h, k1, k2, first, before = (own.column(c).to_numpy() for c in ("h", "k1", "k2", "first", "before"))
        marks = repeated_windows(np.unique(h, return_inverse=True)[1], own.column("data").to_pylist(), before, rule)
        rows: list[list] = [[] for _ in _RANGE]
        for i, m in enumerate(marks):
            if m.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], m.view(np.int8), [0]])))
                for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                    for col, v in zip(rows, (k1[i], k2[i], number, first[i] + a, first[i] + b - 1 + rule.width), strict=True):
                        col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, _RANGE, strict=True)], schema=_RANGE)


def repeated_ranges(docs: DataFrame, rules: tuple[Rule, ...] = (BYTES,)) -> DataFrame:
    """docs(k1, k2, text) -> (k1, k2, rule, begin, end): ranges of the rule's symbols that together cover what is repeated."""
    n = partitions(docs.sparkSession)
    width = F.element_at(F.array(*[F.lit(r.width) for r in rules]), F.col("rule") + 1)
    found = cut(docs.mapInArrow(lambda b: _find(b, rules), _ddl(_ANCHOR)))
    # Counts are written before they are joined: a join right above an aggregation couldn't be split where a key is frequent.
    often = cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    again = cut(found.join(often, "h"))
    forget(found)
    kinds = cut(again.groupBy("h", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at", "first")).alias("one")))
    mixed = cut(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("single")).where("kinds > 1 and single > 0").select("h", "kinds"))
    judged = cut(again.join(kinds, ["h", "run"]).join(mixed, "h", "left"))
    forget(again)
    whole = judged.where("n > 1").select("k1", "k2", "rule", F.col("first").alias("begin"), (F.col("last") + width).alias("end"))
    wanted = judged.where("kinds is not null").where(F.struct("k1", "k2", "at", "first") == F.col("one"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("rule", "h", "at", "first", "last", (F.col("kinds") > HOT).alias("hot"))).alias("wanted"))
    runs = cut(docs.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(lambda b: _fetch(b, rules), _ddl(_RUN)))
    cold = runs.where("not hot").repartition(n, "h").mapInArrow(lambda b: _sort(b, rules), _ddl(_RANGE))
    return whole.union(cold).union(_repeated_slices(runs.where("hot"), width))


def _repeated_slices(slices: DataFrame, width: SparkColumn) -> DataFrame:
    """Slices of runs -> (k1, k2, rule, begin, end) as repeated_ranges() gives. `first` is a slice's first window, `before` that window's distance from the anchor."""
    alike = ["h", "slice", "core"]
    equal = [*alike, "before", "whole", "windows"]
    slices = slices.withColumn("windows", F.size("w"))
    kinds = cut(slices.groupBy(*equal).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "first")).alias("one")))
    mixed = cut(kinds.groupBy(*alike).agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("single")).where("kinds > 1 and single > 0").select(*alike))
    whole = slices.drop("w").join(kinds.where("n > 1").select(*equal), equal).select("k1", "k2", "rule", F.col("first").alias("begin"), (F.col("first") + F.col("windows") - 1 + width).alias("end"))
    ones = slices.join(kinds.join(mixed, alike).select(*equal, "one"), equal).where(F.struct("k1", "k2", "first") == F.col("one"))
    windows = cut(ones.select("h", "k1", "k2", "rule", "first", "before", F.posexplode("w").alias("i", "w")).select("h", "k1", "k2", "rule", (F.col("first") + F.col("i")).alias("begin"), (F.col("before") - F.col("i")).alias("d"), "w"))
    twice = cut(windows.groupBy("h", "d", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return whole.union(windows.join(twice, ["h", "d", "w"]).select("k1", "k2", "rule", "begin", (F.col("begin") + width).alias("end")))


def _keep(raw: bytes, ranges: list[dict]) -> tuple[bytes, int]:
    """What is left of a text, and the number of runs taken out; ranges are of bytes."""
    out, at, spans, end = [], 0, 0, -1
    for r in sorted(ranges, key=lambda r: r["begin"]):
        if r["begin"] > end:
            spans += 1
            out.append(raw[at : r["begin"]])
        end = max(end, r["end"])
        at = max(at, r["end"])
    out.append(raw[at:])
    return b"".join(out), spans


def _in_bytes(raw: bytes, ranges: list[dict], rules: tuple[Rule, ...]) -> list[dict]:
    """The ranges with those of words as the bytes from the first word's begin to the last word's end."""
    if not any(rules[r["rule"]].words for r in ranges):
        return ranges
    starts, ends = word_spans(np.frombuffer(raw, np.uint8))
    return [{"begin": int(starts[r["begin"]]), "end": int(ends[r["end"] - 1])} if rules[r["rule"]].words else r for r in ranges]


def _cleared(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[str]]:
    """docs(doc_id, text, ...) with RANGES: the repeated ranges of its text (rule, begin, end), or null; and the names of docs' columns, which stand as c0, c1, ... beside k1, k2 and text."""
    own = [F.col(quoted(c)).alias(f"c{n}") for n, c in enumerate(docs.columns)]
    keyed = docs.select(*own, F.col("text").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"))
    with cuts() as made:
        ranges = repeated_ranges(keyed.select("k1", "k2", "text"), rules).groupBy("k1", "k2").agg(F.collect_set(F.struct("rule", "begin", "end")).alias("__ranges"))
        ranges = made.keep(cut(ranges))
    return keyed.join(ranges, ["k1", "k2"], "left"), docs.columns


def _covered(ranges: list[dict]) -> int:
    """How many symbols the ranges cover together."""
    total = end = 0
    for r in sorted(ranges, key=lambda r: r["begin"]):
        total += max(0, r["end"] - max(end, r["begin"]))
        end = max(end, r["end"])
    return total


def digests(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what BYTES finds, and n_passage_words: words in what PASSAGES finds, which takes nothing out here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bites(batches, "text", 1 << 21):
            sizes, removed, spans, passages, shas = [], [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("__ranges").to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, n = _keep(raw, [r for r in ranges or [] if r["rule"] == 0])
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept))
                spans.append(n)
                passages.append(_covered([r for r in ranges or [] if r["rule"] == 1]))
                shas.append(hashlib.sha256(kept).hexdigest())
            arrays = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans, passages)), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_passage_words", "kept_sha256"])

    cleared, _ = _cleared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), (BYTES, PASSAGES))
    return cleared.select(F.col("c0").alias("doc_id"), "text", "__ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, n_passage_words long, kept_sha256 string")


def deduplicate(docs: DataFrame, rules: tuple[Rule, ...] = (BYTES,)) -> DataFrame:
    """docs with what is left of each text when all that any rule finds is out; all its columns stay. Where a cut leaves part of a character, that part goes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bites(batches, "text", 1 << 21):
            kept = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("__ranges").to_pylist(), strict=True):
                if ranges:
                    raw = text.encode()
                    text = _keep(raw, _in_bytes(raw, ranges, rules))[0].decode(errors="ignore")
                kept.append(text)
            yield with_columns(batch.drop_columns(["text", "__ranges"]), {"text": pa.array(kept, pa.string())})

    cleared, own = _cleared(docs, rules)
    names = [f"c{n}" for n, c in enumerate(own) if c != "text"]
    cleared = cleared.select(*names, "text", "__ranges")
    out = cleared.mapInArrow(run, ddl(cleared.drop("__ranges")))
    return out.select(*[F.col("text" if c == "text" else f"c{n}").alias(c) for n, c in enumerate(own)])
