"""Sequence packing with a bounded number of open windows.

Each partition keeps at most `open_windows` windows. A document longer than a window gives full windows first; what is left goes
into the open window that it fills best. If none fits, the fullest is completed with the beginning of the piece (or padded, when
the gap is below MIN_PIECE) and emitted. At the end a partition's open windows are merged into full ones, fullest first, which leaves one window at
most; these are merged between partitions in rounds of GROUP partitions, and the very last one is cut into powers of two, which need no padding.

Bounded memory: a task holds open_windows windows and one batch; a round's task holds GROUP windows.

Edge cases: a null or empty text is a document of one id (the end mark); a repeated doc_id is packed as often as it stands; an empty table gives
an empty result. A text that holds one of the tokenizer's added tokens is encoded by the library as a whole. A piece never crosses documents; pieces of a document cover its ids once, in order of `start`.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Split, WordIds, gather, pieces
from .runtime import bites, cut, from_rows, texts

LENGTH = 2048
OPEN_WINDOWS = 64
MIN_PIECE = 8
GROUP = 512
END_ID = 1
_RAW = "part long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, ids binary"
_ARROW = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _RAW.split(", ")])


@lru_cache(2)
def whole_encoder(path: str) -> tuple[list[str], Callable[[str], np.ndarray]]:
    """The tokenizer's added tokens, and its own encoding of a text: added tokens that stand in the text are ids of their own."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    marks = sorted({lowered(x.content) for x in t.get_added_tokens_decoder().values()})
    return marks, lambda text: np.array([*t.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    """Ids of lower-cased words by the tokenizers library; every word's last token, and no other, ends with the mark `</w>`."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    vocabulary = t.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        last[i] = token.endswith("</w>")

    def encode(words: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for s in range(0, len(words), 4096):
            part = words[s : s + 4096]
            ids = np.array(t.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) != len(part):  # a word of which the tokenizer makes more than one, or none
                out.extend(np.array(t.encode(w, add_special_tokens=False).ids, np.uint32) for w in part)
            else:
                out.extend(np.split(ids, ends[:-1]))
        return out

    return WordIds(encode)


def lowered(text: str) -> str:
    """The tokenizer's normal form; its lower case goes by character, so a final sigma isn't special."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def document_ids(given: list[str], table: WordIds) -> list[np.ndarray]:
    """Ids of each text and the end mark."""
    texts_ = [lowered(t) for t in given]
    if len(texts_) == 1 and len(parts := pieces(texts_[0])) > 1:
        return [np.concatenate([*(table.ids(Split([p], spaced=False))[0] for p in parts), np.array([END_ID], np.uint32)])]
    split = Split(texts_, spaced=False)
    start, size = table.spans(split)
    # The end marks go in as one more pre-token of each text.
    flat, ends = gather(table.pool, start, size)
    bounds = np.append(0, ends)[split.bounds]
    out = np.full(len(flat) + len(given), END_ID, np.uint32)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(given)), np.diff(bounds))] = flat
    return np.split(out, (bounds[1:] + np.arange(1, len(given) + 1))[:-1]) if given else []


class Packer:
    """Packs pieces (doc_id, start, doc_tokens, ids) into windows; calls emit(list of pieces, length) for each done."""

    def __init__(self, emit: Callable[[list], None], length: int = LENGTH, open_windows: int = OPEN_WINDOWS):
        self.emit, self.length, self.most = emit, length, open_windows
        self.open: list[list] = []  # [ids so far, pieces]

    def add(self, doc: int, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.length:
            self.emit([(doc, start, total, ids[: self.length])])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            gaps = [self.length - w[0] for w in self.open]
            fits = [(g, i) for i, g in enumerate(gaps) if g >= len(ids)]
            if fits:
                self._put(min(fits)[1], doc, start, total, ids)
                return
            if len(self.open) < self.most:
                self.open.append([0, []])
                self._put(len(self.open) - 1, doc, start, total, ids)
                return
            gap, i = min((g, i) for i, g in enumerate(gaps))
            if gap >= MIN_PIECE:
                self._put(i, doc, start, total, ids[:gap])
                start, ids = start + gap, ids[gap:]
            else:
                self.emit(self.open.pop(i)[1])

    def _put(self, i: int, doc: int, start: int, total: int, ids: np.ndarray) -> None:
        w = self.open[i]
        w[0] += len(ids)
        w[1].append((doc, start, total, ids))
        if w[0] == self.length:
            self.emit(self.open.pop(i)[1])

    def leftover(self) -> list:
        """Merges the open windows into full ones; the pieces of the one that isn't full."""
        pieces = [p for _, ps in sorted(self.open, key=lambda w: -w[0]) for p in ps]
        self.open = []
        return chained(pieces, self.emit, self.length)


def chained(pieces: list, emit: Callable[[list], None], length: int) -> list:
    """Fills windows with the pieces one after another, cutting where a window ends; the pieces of the last, if not full."""
    window, used = [], 0
    for doc, start, total, ids in pieces:
        while len(ids):
            n = min(len(ids), length - used)
            window.append((doc, start, total, ids[:n]))
            start, ids, used = start + n, ids[n:], used + n
            if used == length:
                emit(window)
                window, used = [], 0
    return window


class _Rows:
    """Rows of pieces for a part (a task): windows are numbered from 0; the leftover has number -1 and keeps its ids."""

    def __init__(self, part: int):
        self.part, self.window, self.rows = part, 0, []

    def emit(self, pieces: list) -> None:
        self._add(pieces, self.window, False)
        self.window += 1

    def _add(self, pieces: list, window: int, keep: bool) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            data = np.ascontiguousarray(ids, "<u4").tobytes()
            self.rows.append((self.part, doc, start, len(ids), zlib.crc32(data), total, window, offset, data if keep else None))
            offset += len(ids)

    def leftover(self, pieces: list) -> None:
        self._add(pieces, -1, True)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return from_rows(rows, _ARROW)


def pack(docs: DataFrame, path: str, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, chars: int = 200_000) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece, its place in its document and in its sequence.

    path: the tokenizer's file, readable by the executors."""

    def pieces_of(data: pa.Table | pa.RecordBatch) -> list:
        rows = sorted(data.to_pylist(), key=lambda r: (r["part"], r["offset"]))
        return [(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")) for r in rows]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(TaskContext.get().partitionId())
        packer = Packer(rows.emit, length, open_windows)
        for batch in bites(batches, "text", chars):
            given = texts(batch)
            marks, encode = whole_encoder(path)
            marked = {i for i, t in enumerate(given) if any(m in x for x in [lowered(t)] for m in marks)}
            coded = document_ids(["" if i in marked else t for i, t in enumerate(given)], word_ids(path))
            for i in marked:
                coded[i] = encode(given[i])
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                packer.add(doc, 0, len(ids), ids)
            yield rows.batch()
        rows.leftover(packer.leftover())
        yield rows.batch()

    def merge(key: tuple, data: pa.Table) -> pa.Table:
        rows = _Rows(key[0].as_py())
        rows.leftover(chained(pieces_of(data), rows.emit, length))
        return pa.Table.from_batches([rows.batch()])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(0)
        pieces = [p for batch in batches for p in pieces_of(batch)]
        left = sum(len(p[3]) for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            done: list = []
            pieces = _take(pieces, size, done)
            rows.emit(done)
            left -= size
        yield rows.batch()

    # A part's rows depend on its order, so they are written once; later reads agree with each other.
    made = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, _RAW))
    done, rest, level = [made.where("window >= 0")], made.where("window < 0"), 0
    while True:
        parts = rest.select("part").distinct().count()
        if parts < 2:
            break
        made = cut(rest.groupBy(F.floor(F.col("part") / GROUP).cast("long").alias("__group")).applyInArrow(merge, _RAW))
        level += 1
        done.append(made.where("window >= 0"))
        rest = made.where("window < 0")
    done.append(rest.coalesce(1).mapInArrow(last, _RAW))
    # A sequence's id: the round in the highest bits, then the part, then the window.
    numbered = [d.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(min(i, 7) << 60) + F.shiftleft("part", 30) + F.col("window")).alias("sequence_id"), "offset") for i, d in enumerate(done)]
    out = numbered[0]
    for d in numbered[1:]:
        out = out.union(d)
    return out


def _take(pieces: list, size: int, done: list) -> list:
    """Moves pieces of `size` ids together to done; what is left."""
    rest = []
    for doc, start, total, ids in pieces:
        n = min(len(ids), size)
        if n:
            done.append((doc, start, total, ids[:n]))
            size -= n
        if n < len(ids):
            rest.append((doc, start + n, total, ids[n:]))
    return rest
