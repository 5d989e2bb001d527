"""Byte-level BPE encoding and decoding that encodes each distinct word of the corpus once.

1. Texts are exploded into pre-tokens. A chunk of texts (CHUNK_BYTES of one task) keeps, for each document, the numbers of its pre-tokens in
   their order, counted in the chunk's own sorted list of distinct pre-tokens; that list goes to buckets by the pre-token's hash.
2. A bucket gets all that is equal: the lists of all chunks go through its task one after another, each distinct pre-token is encoded when it comes first, and each chunk gets the ids of its
   pre-tokens, in the order of the chunk's list. A task holds at most WORDS_HELD pre-tokens and starts anew beyond them.
3. A chunk's task joins the ids back and puts each document together by position. Chunks are dealt evenly, by their numbers.
Decoding joins the table of token bytes to the ids, in order.

Between the steps goes one compressed record for a (chunk, bucket) pair in place of a row for each occurrence: a word that stands in a third of all positions
is one entry of each chunk. Chunks are bounded by bytes. Buckets are as many as shuffle partitions, MOST_BUCKETS at most: with more of both, the records, one for each chunk and bucket,
would grow with the square of the corpus. A single document of any length is one chunk.

Edge cases: a null or empty text has no ids, and its digests are those of no bytes. Equal or null doc_ids are encoded each. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Split, gather, pieces
from .runtime import bites, cut, from_rows, partitions, texts

CHUNK_BYTES = 32 << 20
BITE_BYTES = 160_000
RECORD = "kind int, chunk long, bucket int, payload binary"
_RECORD = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
DOCUMENT, WORDS, IDS = 0, 1, 2
MOST_BUCKETS = 4096
#: Pre-tokens with their ids that a bucket's task holds: about 200 MB.
WORDS_HELD = 700_000


@lru_cache(2)
def encoding(path: str):
    """The tiktoken encoding of a rank file, with the public split pattern."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and where each id's bytes begin and how many they are."""
    by_id = sorted((i, b) for b, i in ranks(path).items())
    size = np.zeros(by_id[-1][0] + 1, np.int64)
    for i, b in by_id:
        size[i] = len(b)
    return np.frombuffer(b"".join(b for _, b in by_id), np.uint8), np.cumsum(size) - size, size


def decode(ids: np.ndarray, path: str) -> bytes:
    pool, start, size = token_bytes(path)
    return gather(pool, start[ids], size[ids])[0].tobytes()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed payload; numbers are split into byte planes, which compress better."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], "<i8").tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=9).compress(b"".join([head, *planes]))


def _unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(data[:8], "<i8")[0])
    head = np.frombuffer(data[8 : 8 + 16 * n], "<i8").reshape(n, 2)
    out, at = [], 8 + 16 * n
    for (length, width), kind in zip(head.tolist(), kinds, strict=True):
        raw = np.frombuffer(data, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(raw.T).reshape(-1).view(kind))
        at += length * width
    return out


class _Chunk:
    """Documents of one chunk as numbers of distinct pre-tokens, and these pre-tokens."""

    def __init__(self):
        self.docs, self.counts, self.splits, self.hashes, self.bytes = [], [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        given = texts(batch)
        parts = pieces(given[0]) if len(given) == 1 else []
        made = [Split([p], spaced=True) for p in parts] if len(parts) > 1 else [Split(given, spaced=True)]
        self.docs.extend(batch.column("doc_id").to_pylist())
        self.counts.append(np.array([sum(len(s.hashes) for s in made)]) if len(parts) > 1 else np.diff(made[0].bounds))
        for split in made:
            wide = len(split.points) and int(split.points.max()) > 0xFFFF
            self.splits.append((split.points if wide else split.points.astype("<u2"), split.starts.astype(np.uint32), (split.ends - split.starts).astype(np.uint32)))
            self.hashes.append(split.hashes)
        self.bytes += sum(map(len, given))

    def records(self, chunk: int, buckets: int) -> list[tuple]:
        """Within its bucket a pre-token has a rank, frequent ones first (so small numbers are frequent, and compress), those that occur once by their letters."""
        ends = np.cumsum([len(h) for h in self.hashes])
        hashes = np.concatenate(self.hashes)
        self.hashes = []
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, bool)
        distinct, where = hashes[new], order[new]
        del hashes
        inverse = np.empty(len(order), np.uint32)
        inverse[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        del order, new
        count = np.bincount(inverse, minlength=len(distinct))
        words = np.empty(len(distinct), object)
        owner = np.searchsorted(ends, where, "right")
        for k, (points, starts, sizes) in enumerate(self.splits):
            mine = np.flatnonzero(owner == k)
            at = where[mine] - (ends[k - 1] if k else 0)
            blob, width = points.tobytes(), points.itemsize
            code = "utf-32-le" if width == 4 else "utf-16-le"
            words[mine] = [blob[width * x : width * (x + n)].decode(code).encode() for x, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)]
        self.splits = []
        bucket = (distinct % np.uint64(buckets)).astype(np.int64)
        once = np.flatnonzero(count == 1)
        letters = np.zeros(len(distinct), np.int64)
        letters[once[sorted(range(len(once)), key=words[once].tolist().__getitem__)]] = np.arange(len(once))
        order = np.lexsort((letters, -count, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        number = np.empty(len(distinct), np.int64)
        number[order] = (np.arange(len(order)) - cuts[bucket[order]]) * buckets + bucket[order]
        nulls = np.array([d is None for d in self.docs], np.uint8)
        rows = [(DOCUMENT, chunk, 0, _pack(np.array([d or 0 for d in self.docs], np.int64), nulls, np.concatenate(self.counts).astype(np.uint32), number[inverse].astype(np.uint32)))]
        words = words[order]
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = words[cuts[b] : cuts[b + 1]].tolist()
            rows.append((WORDS, chunk, b, _pack(np.array([len(w) for w in part], np.uint32), np.frombuffer(b"".join(part), np.uint8))))
        return rows


def explode(docs: DataFrame, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs(doc_id, text) -> RECORDs: a chunk's documents, and its distinct pre-tokens of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in bites(batches, "text", BITE_BYTES):
            chunk.add(batch)
            if chunk.bytes >= chunk_bytes:
                yield from_rows(chunk.records(task << 32 | number, buckets), _RECORD)
                number, chunk = number + 1, _Chunk()
        if chunk.docs:
            yield from_rows(chunk.records(task << 32 | number, buckets), _RECORD)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RECORD)


def _words(payload: bytes) -> list[bytes]:
    sizes, raw = _unpack(payload, "<u4", "u1")
    blob, ends = raw.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
    return [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode_buckets(records: DataFrame, path: str) -> DataFrame:
    """RECORDs of pre-tokens -> RECORDs of their ids; each distinct pre-token of a bucket is encoded once."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            rows = []
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                found = []
                for w in _words(payload):
                    ids = known.get(w)
                    if ids is None:
                        known[w] = ids = encode(w.decode())
                    found.append(ids)
                sizes = np.fromiter(map(len, found), np.uint32, len(found))
                rows.append((IDS, chunk, key[0].as_py(), _pack(sizes, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())))))
                if len(known) > WORDS_HELD:
                    known.clear()
            yield from_rows(rows, _RECORD)

    return records.groupBy("bucket").applyInArrow(run, RECORD)


def assemble(records: DataFrame, buckets: int, make: Callable[[np.ndarray], tuple], schema: str, arrow: pa.Schema) -> DataFrame:
    """For each document a row (doc_id, *make(ids)); records: the documents and the ids of all chunks."""

    def joined(rows: list[tuple]) -> pa.RecordBatch:
        ids, docs = {}, None
        for kind, bucket, payload in rows:
            if kind == IDS:
                ids[bucket] = _unpack(payload, "<u4", "<u4")
            else:
                docs = _unpack(payload, "<i8", "u1", "<u4", "<u4")
        # Of pre-token number r * buckets + b: the ids of rank r in bucket b.
        most = max((len(p[0]) for p in ids.values()), default=0)
        size = np.zeros((most, buckets), np.int64)
        start = np.zeros((most, buckets), np.int64)
        base = 0
        for b, (sizes, flat) in ids.items():
            size[: len(sizes), b] = sizes
            start[: len(sizes), b] = base + np.cumsum(sizes) - sizes
            base += len(flat)
        pool = np.concatenate([p[1] for p in ids.values()]) if ids else np.zeros(0, np.uint32)
        size, start = size.ravel(), start.ravel()
        doc_ids, nulls, counts, codes = docs
        out, ends = [], np.cumsum(counts, dtype=np.int64)
        for doc, null, a, b in zip(doc_ids.tolist(), nulls.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            own = codes[a:b]
            out.append((None if null else doc, *make(gather(pool, start[own], size[own])[0])))
        return from_rows(out, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows = None, []
        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "bucket", "payload")), strict=True):
                if k != chunk and rows:
                    yield joined(rows)
                    rows = []
                chunk = k
                rows.append(row)
        if rows:
            yield joined(rows)

    n = partitions(records.sparkSession)
    place = F.pmod(F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(F.lit(0xFFFFFFFF)) * 7, F.lit(n)).cast("int")
    return records.repartitionById(n, place).sortWithinPartitions("chunk").mapInArrow(run, schema)


def _prepared(docs: DataFrame, path: str) -> tuple[DataFrame, int]:
    buckets = min(partitions(docs.sparkSession), MOST_BUCKETS)
    records = cut(explode(docs, buckets))
    return records.where(F.col("kind") == DOCUMENT).union(encode_buckets(records.where(F.col("kind") == WORDS), path)), buckets


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>)."""
    return assemble(*_prepared(docs, path), lambda ids: (ids.astype(np.int32).tolist(),), "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256): of the ids, and of the bytes that they decode to."""

    def make(ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()

    return assemble(*_prepared(docs, path), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))
