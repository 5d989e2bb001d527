"""Token counts that follow edits without counting a document anew.

Each document keeps a balanced tree over its pre-tokens, in blocks; nodes hold the sums of characters, pre-tokens and tokens below them. plant() makes the trees once, as
records in a column that is written with the texts; edit() loads a record by its blocks' sums, reads only the blocks that edits touch, and gives the record after them. An
edit takes out the pre-tokens that it touches, those before it that a split decision could look into (two characters ahead), and as many behind as
it takes until a new boundary meets an old one: from there on the split is the same, as the pattern never looks back. Only these are
encoded again; the sums on the way to the root follow.

Edge cases: a null text counts as empty, null edits as none, null parts of an edit as 0 and empty; starts beyond the end mean the end, negative ones 0; lengths are cut at
the end. Edits apply one after another, each to the text that the ones before it left. Repeated rows are counted each; a text of any length is one tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Split, WordIds
from .pretokens import pieces as long_pieces
from .runtime import bites, ddl, texts, with_columns
from .word_bpe import encoding

BLOCK = 48
AHEAD = 2
EDITS = "array<struct<start:bigint,length:bigint,text:string>>"


class Node:
    """A block of pre-tokens (their sizes and counts), or two subtrees; sums over what is below. A block of a stored tree is read when it is asked for."""

    __slots__ = ("_counts", "_sizes", "chars", "height", "left", "number", "right", "stored", "tokens")

    def __init__(self, sizes: list[int] | None, counts: list[int] | None, left: Node | None = None, right: Node | None = None):
        self._sizes, self._counts, self.left, self.right, self.stored = sizes, counts, left, right, None
        if left is None:
            self.chars, self.tokens, self.number, self.height = sum(sizes), sum(counts), len(sizes), 1
        else:
            self.chars, self.tokens, self.number = left.chars + right.chars, left.tokens + right.tokens, left.number + right.number
            self.height = 1 + max(left.height, right.height)

    @classmethod
    def of_stored(cls, sizes: np.ndarray, counts: np.ndarray, chars: int, tokens: int) -> Node:
        node = cls.__new__(cls)
        node._sizes = node._counts = node.left = node.right = None
        node.stored, node.chars, node.tokens, node.number, node.height = (sizes, counts), chars, tokens, len(sizes), 1
        return node

    @property
    def sizes(self) -> list[int]:
        if self._sizes is None and self.stored is not None:
            self._sizes = self.stored[0].tolist()
        return self._sizes

    @property
    def counts(self) -> list[int]:
        if self._counts is None and self.stored is not None:
            self._counts = self.stored[1].tolist()
        return self._counts


def build(sizes: list[int], counts: list[int]) -> Node:
    return _above([Node(sizes[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(sizes), BLOCK)] or [Node([], [])])


def _above(level: list[Node]) -> Node:
    halves = lambda a, b: level[a] if b - a == 1 else Node(None, None, halves(a, (a + b) // 2), halves((a + b) // 2, b))
    return halves(0, len(level))


def packed(blocks: list[int], sums: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> bytes:
    """A tree's record: how many pre-tokens each block has, the blocks' sums of characters and tokens, then all sizes and counts, in two bytes each if they fit."""
    wide = len(sizes) and max(int(sizes.max()), int(counts.max())) > 0xFFFF
    kind = "<u4" if wide else "<u2"
    return b"".join([np.array([len(blocks), len(sizes), bool(wide)], "<i8").tobytes(), np.array(blocks, "<u4").tobytes(), sums.astype("<i8").tobytes(), sizes.astype(kind).tobytes(), counts.astype(kind).tobytes()])


def planted(sizes: np.ndarray, counts: np.ndarray) -> bytes:
    """The record of a new tree."""
    at = np.arange(0, len(sizes), BLOCK)
    sums = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (sizes, counts)], axis=1) if len(at) else np.zeros((0, 2), np.int64)
    return packed(np.diff(np.append(at, len(sizes))).tolist(), sums, sizes, counts)


def stored(t: Node) -> bytes:
    """The record of a tree."""
    leaves, waiting = [], [t]
    while waiting:
        node = waiting.pop()
        if node.left is None:
            leaves.append(node)
        else:
            waiting += [node.right, node.left]
    leaves = [x for x in leaves if x.number]
    whole = [np.concatenate([np.asarray(x.stored[k] if x.stored is not None else (x.sizes, x.counts)[k], np.uint32) for x in leaves]) if leaves else np.zeros(0, np.uint32) for k in (0, 1)]
    return packed([x.number for x in leaves], np.array([(x.chars, x.tokens) for x in leaves], np.int64).reshape(-1, 2), *whole)


def loaded(record: bytes) -> Node:
    """The tree of a record; only its blocks' sums are read now."""
    n, total, wide = np.frombuffer(record, "<i8", 3).tolist()
    numbers, at = np.frombuffer(record, "<u4", n, 24), 24 + 4 * n
    sums, at = np.frombuffer(record, "<i8", 2 * n, at).reshape(n, 2).tolist(), at + 16 * n
    kind, width = ("<u4", 4) if wide else ("<u2", 2)
    sizes, counts = np.frombuffer(record, kind, total, at), np.frombuffer(record, kind, total, at + width * total)
    ends = np.cumsum(numbers, dtype=np.int64).tolist()
    return _above([Node.of_stored(sizes[b - k : b], counts[b - k : b], *s) for b, k, s in zip(ends, numbers.tolist(), sums, strict=True)] or [Node([], [])])


def join(a: Node, b: Node) -> Node:
    """The two trees in order, balanced by height."""
    if not a.number:
        return b
    if not b.number:
        return a
    if a.left is None and b.left is None and a.number + b.number <= BLOCK:
        return Node(a.sizes + b.sizes, a.counts + b.counts)
    if a.height > b.height + 1:
        right = join(a.right, b)
        if right.height > a.left.height + 1:
            if right.left.height > right.right.height:
                return Node(None, None, Node(None, None, a.left, right.left.left), Node(None, None, right.left.right, right.right))
            return Node(None, None, Node(None, None, a.left, right.left), right.right)
        return Node(None, None, a.left, right)
    if b.height > a.height + 1:
        left = join(a, b.left)
        if left.height > b.right.height + 1:
            if left.right.height > left.left.height:
                return Node(None, None, Node(None, None, left.left, left.right.left), Node(None, None, left.right.right, b.right))
            return Node(None, None, left.left, Node(None, None, left.right, b.right))
        return Node(None, None, left, b.right)
    return Node(None, None, a, b)


def split(t: Node, k: int) -> tuple[Node, Node]:
    """The first k pre-tokens, and the others."""
    if t.left is None:
        return Node(t.sizes[:k], t.counts[:k]), Node(t.sizes[k:], t.counts[k:])
    if k < t.left.number:
        a, b = split(t.left, k)
        return a, join(b, t.right)
    a, b = split(t.right, k - t.left.number)
    return join(t.left, a), b


def find(t: Node, place: int) -> tuple[int, int]:
    """(number, begin) of the pre-token in which the character at `place` stands; of the end if it is behind all."""
    number = begin = 0
    while t.left is not None:
        if place < begin + t.left.chars:
            t = t.left
        else:
            number, begin, t = number + t.left.number, begin + t.left.chars, t.right
    for s in t.sizes:
        if place < begin + s:
            break
        number, begin = number + 1, begin + s
    return number, begin


def walk(t: Node, k: int) -> Iterator[int]:
    """Sizes of the pre-tokens from number k on."""
    if t.left is None:
        yield from t.sizes[k:]
        return
    if k < t.left.number:
        yield from walk(t.left, k)
    yield from walk(t.right, max(0, k - t.left.number))


class Counted:
    """A text and the tree of its pre-tokens."""

    def __init__(self, text: str, tree: Node, pieces: Callable[[str], list[str]], count: Callable[[str], int]):
        self.text, self.tree, self.pieces, self.count = text, tree, pieces, count
        self.encoded = 0

    def edit(self, start: int, length: int, new: str) -> None:
        text = self.text
        start = min(max(start, 0), len(text))
        stop = min(len(text), start + max(length, 0))
        number, begin = find(self.tree, max(0, start - AHEAD))
        if begin > max(0, start - AHEAD):
            raise AssertionError("the tree doesn't fit the text")
        old_end, _ = find(self.tree, stop)
        self.text = text[:start] + new + text[stop:]
        grown = len(self.text) - len(text)
        # Old boundaries behind the edit, in places of the new text, with the numbers of the pre-tokens that begin there.
        ends: dict[int, int] = {}
        sizes, place, at = walk(self.tree, number), begin, number
        reach = 4
        while True:
            for s in sizes:
                if place >= stop:
                    ends[place + grown] = at
                place, at = place + s, at + 1
                if place >= stop and len(ends) >= reach and at > old_end:
                    break
            done = at == self.tree.number and place == len(text)
            if done:
                ends[len(self.text)] = at
            limit = place + grown
            fresh, here, last = [], begin, None
            for piece in self.pieces(self.text[begin:limit]):
                if here in ends and (here >= start + len(new)):
                    last = here
                    break
                fresh.append(piece)
                here += len(piece)
                if not done and here + AHEAD > limit:
                    break
            else:
                last = here if done else None
            if last is not None:
                break
            reach *= 4
        head, rest = split(self.tree, number)
        tail = split(rest, ends[last] - number)[1]
        self.encoded += len(fresh)
        self.tree = join(join(head, build([len(p) for p in fresh], [self.count(p) for p in fresh])), tail)


@lru_cache(2)
def _tools(path: str) -> tuple[WordIds, Callable, Callable]:
    import public_tokenizers

    encode = encoding(path).encode_ordinary
    return WordIds(lambda words: [encode(w) for w in words]), regex.compile(public_tokenizers.PATTERN).findall, lru_cache(100_000)(lambda p: len(encode(p)))


def plant(docs: DataFrame, path: str) -> DataFrame:
    """docs(text) with tree (binary): the record of each text's tree, to be written with the texts. This is the only time that a whole text is encoded."""
    docs = docs.drop("tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _, _ = _tools(path)
        for batch in bites(batches, "text", 200_000):
            given = texts(batch)
            parts = long_pieces(given[0]) if len(given) == 1 else []
            made = [Split([p], spaced=True) for p in parts] if len(parts) > 1 else [Split(given, spaced=True)]
            counts = np.concatenate([table.spans(c)[1] for c in made])
            sizes = np.concatenate([c.ends - c.starts for c in made])
            bounds = [0, len(sizes)] if len(parts) > 1 else made[0].bounds.tolist()
            yield with_columns(batch, {"tree": pa.array([planted(sizes[a:b], counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    return docs.mapInArrow(run, f"{ddl(docs)}, tree binary")


COUNTS = ("n_tokens", "n_pretokens", "n_tokens_after", "n_reencoded")


def edit(trees: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """trees(text, tree, edits EDITS), as plant() or edit() has left them -> text and tree as after the edits, and n_tokens, n_pretokens (both before them), n_tokens_after and n_reencoded
    (pre-tokens encoded again) in place of the edits. Rows without edits keep their record as it is. The record must be that of the text."""
    kept = [c for c in trees.columns if c not in (*COUNTS, edits, "text", "tree")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces, count = _tools(path)
        for batch in bites(batches, "text", 200_000):
            after, records, rows = [], [], []
            for text, record, changes in zip(texts(batch), batch.column("tree").to_pylist(), batch.column(edits).to_pylist(), strict=True):
                doc = Counted(text, loaded(record), pieces, count)
                if doc.tree.chars != len(text):
                    raise ValueError("the tree isn't that of the text")
                before, number = doc.tree.tokens, doc.tree.number
                changes = [x for x in changes or [] if x is not None]
                for x in changes:
                    doc.edit(x["start"] or 0, x["length"] or 0, x["text"] or "")
                after.append(doc.text)
                records.append(stored(doc.tree) if changes else record)
                rows.append((before, number, doc.tree.tokens, doc.encoded))
            columns = dict(zip(COUNTS, zip(*rows, strict=True), strict=True))
            rest = batch.drop_columns(["text", "tree", edits])
            yield with_columns(rest, {"text": pa.array(after, pa.string()), "tree": pa.array(records, pa.binary())} | {n: pa.array(c, pa.int64()) for n, c in columns.items()})

    ordered = trees.select(*kept, "text", "tree", edits)
    shape = ordered.select(*kept, F.col("text").cast("string").alias("text"), "tree")
    return ordered.mapInArrow(run, f"{ddl(shape)}, " + ", ".join(f"{n} long" for n in COUNTS))


def recount(docs: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """docs(text, edits EDITS) with the text as after the edits, and n_tokens, n_pretokens, n_tokens_after, n_reencoded in place of the edits: trees that are planted, stored as records, loaded and edited."""
    return edit(plant(docs, path), path, edits).drop("tree")


def attach(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the column edits from a table edits(doc_id, seq, start, length, text), in the order of seq."""
    listed = edits.groupBy(F.col("doc_id").alias("__id")).agg(F.expr("transform(array_sort(collect_list(struct(seq, start, length, text))), x -> struct(x.start as start, x.length as length, x.text as text))").alias("edits"))
    return docs.drop("edits").join(listed, docs["doc_id"] == listed["__id"], "left").drop("__id")


def sample_edits() -> F.Column:
    """Three edits that follow from a text alone: its middle again at a quarter, a deletion in the middle, a replacement near the end."""
    n = "length(coalesce(text, ''))"
    return F.expr(f"""array(
        struct(cast({n} div 4 as bigint) as start, 0L as length, substring(coalesce(text, ''), cast({n} div 2 as int), 24) as text),
        struct(cast({n} div 2 as bigint) as start, 11L as length, '' as text),
        struct(cast({n} * 3 div 4 as bigint) as start, 5L as length, ' it''s 2024!\n\n' as text))""")
