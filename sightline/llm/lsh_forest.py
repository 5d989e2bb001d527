"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a digest of the set and a signature. Equal sets collapse: what
   follows works on one representative (the smallest doc_id) of each, so thousands of copies are one row.
2. The forest: TREES orders of the representatives, each sorted by DEPTH values of the signature. Neighbours in an order with
   a common prefix of DEPTH values are candidates; in a region that has at most SPARSE members at one value less, so are all of
   that region: sparse regions are searched at a smaller depth. Orders are range partitions by the values and the id, which no frequent prefix can
   make uneven; the neighbours at two partitions' border are compared in a second, small pass.
3. Candidates' components are clusters. Every pair with a similarity at the threshold lies in one cluster (but for the chance below). A cluster is
   dealt into blocks of about BLOCK_ROWS sets. Each block compares its full sets. In clusters of several blocks, about PIVOTS sets are
   compared with all others; then the sets outside the cluster's largest component so far. What is left
   are pairs within one component, which can't change the result: no pair that could is skipped, and none is written out for being in a large group.
   These comparisons go by tiles of TILE_ROWS sets a side, as hashes of shingles made once, and only between sizes that can be similar enough: a cluster of n sets without a
   large component sends each set to n / TILE_ROWS tasks at most.

A pair of similarity s is missed by all trees with the probability (1 - s**DEPTH)**TREES at most: 3e-5 at 0.8, 4e-7 at 0.85, and less where regions are sparse.

Edge cases: null or empty texts, or such without a word, have an empty set and link with nothing; fewer words than `words` make
one shingle of the whole sequence; rows of one doc_id count as one document with several texts; a row with a null doc_id gets the component of its
equals, and is its own (null) without them. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .pretokens import mix, span_hashes
from .runtime import bites, cut, cuts, from_rows, partitions, texts

TREES, DEPTH, SPARSE = 20, 4, 8
BLOCK_ROWS, BLOCK_SHINGLES, PIVOTS = 64, 40_000, 64
#: Sets, and shingles of them, on each side of a comparison within a large cluster.
TILE_ROWS, TILE_SHINGLES = 512, 400_000
#: Rows of (cluster, block, id) that may be broadcast: under 30 MB. With more of them the join is a shuffled one.
BROADCAST_ROWS = 200_000
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are taken at a time.
SLAB = 1 << 21
_M = np.uint64(0xD1B54A32D192ED03)


def _word_hashes(parts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Hashes of the words of texts, and where each text's begin."""
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    edge = np.flatnonzero(np.diff(_SPACES[data], prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets).tolist()


def _slabs(text: bytes) -> list[bytes]:
    """A long text in pieces that end where a word does."""
    out, at = [], 0
    while at < len(text):
        m = _BLANK.search(text, at + SLAB)
        end = m.end() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


def shingle_sets(given: list[str], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of so many words; A-Z is lower-cased, words are [^\\x20\\x09-\\x0D]+."""
    parts = [t.encode().lower() for t in given]
    if len(parts) == 1 and len(parts[0]) > 2 * SLAB:
        w = np.concatenate([_word_hashes([s])[0] for s in _slabs(parts[0])])
        bounds = [0, len(w)]
    else:
        w, bounds = _word_hashes(parts)
    rolled = np.zeros(0, np.uint64)
    if len(w) >= words:
        rolled = w[: len(w) - words + 1].copy()
        for j in range(1, words):
            rolled = rolled * _M + w[j : len(w) - words + 1 + j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = 0
            for x in w[a:b].tolist():
                h = (h * int(_M) + x + 0x5DEECE66D) % (1 << 64)
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray, multipliers: np.ndarray, step: int = 2048) -> np.ndarray:
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), step):
        np.minimum(low, (s[a : a + step, None] * multipliers).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, signature binary"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("signature", pa.binary())])


def sign(docs: DataFrame, words: int) -> DataFrame:
    """docs(doc_id, text) -> _SIGNED: size, digest (d1, d2) and signature of each text's set; an empty set's digest is its doc_id's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(TREES * DEPTH)
        for batch in bites(batches, "text", 400_000):
            rows = []
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(texts(batch), words), strict=True):
                if len(s):
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist()
                    rows.append((doc, len(s), *d, signature(s, multipliers).tobytes()))
                else:
                    rows.append((doc, 0, doc or 0, 0, None))
            yield from_rows(rows, _SIGNED_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SIGNED)


_ORDERED = ["tree", "k1", "k2", "rep"]


def forest_links(sets: DataFrame) -> DataFrame:
    """sets(rep, signature) -> candidate links (a, b) between neighbours of the sorted orders."""
    spark = sets.sparkSession
    arrow = pa.schema([("tree", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("rep", pa.int64())])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = batch.column("rep").to_numpy(zero_copy_only=False).astype(np.int64)
            s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(rep), TREES, DEPTH).astype(np.uint64)
            high = np.uint64(32)
            k1, k2 = s[:, :, 0] << high | s[:, :, 1], s[:, :, 2] << high | s[:, :, 3]
            tree = np.tile(np.arange(TREES, dtype=np.int32), len(rep))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(k1.ravel().view(np.int64)), pa.array(k2.ravel().view(np.int64)), pa.array(np.repeat(rep, TREES))], schema=arrow)

    def neighbours(ends: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            tree, k1, k2, rep = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in _ORDERED)
            near = (tree[1:] == tree[:-1]) & (k1[1:] == k1[:-1])
            full = near & (k2[1:] == k2[:-1])
            near &= (k2[1:] >> 32) == (k2[:-1] >> 32)
            begin = np.flatnonzero(np.append(True, ~near))
            size = np.diff(np.append(begin, len(rep)))
            linked = np.flatnonzero(full | near & (np.repeat(size, size)[1:] <= SPARSE))
            yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[linked + 1]), *[pa.nulls(len(linked), f.type) for f in arrow]], schema=linked_arrow)
            if ends:
                two = np.unique([0, len(rep) - 1])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(two), pa.int64()), pa.nulls(len(two), pa.int64()), pa.array(tree[two]), pa.array(k1[two]), pa.array(k2[two]), pa.array(rep[two])], schema=linked_arrow)

        return run

    linked_arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), *arrow])
    schema = "a long, b long, tree int, k1 long, k2 long, rep long"
    rows = sets.select("rep", "signature").mapInArrow(plant, "tree int, k1 long, k2 long, rep long")
    made = cut(rows.repartitionByRange(partitions(spark), *_ORDERED).sortWithinPartitions(*_ORDERED).mapInArrow(neighbours(True), schema))
    # Two rows of each partition, in their order: a link that a border has parted.
    border = made.where("rep is not null").select(*_ORDERED).coalesce(1).sortWithinPartitions(*_ORDERED).mapInArrow(neighbours(False), schema)
    return made.where("a is not null").union(border).select("a", "b").where("a <> b")


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections; the sets are sorted and distinct."""
    m = len(sets)
    out = np.zeros((m, m), np.float64)
    values = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    count = np.bincount(number) if len(number) else np.zeros(0, int)
    shared = count[number] > 1 if len(number) else np.zeros(0, bool)
    number, owner = number[shared], owner[shared]
    number = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1 if len(number) else number
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        lo, hi = np.searchsorted(number, [a, a + columns])
        x = np.zeros((m, columns), np.float32)
        x[owner[lo:hi], number[lo:hi] - a] = 1
        out += x @ x.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def links_of(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets."""
    both = overlaps(sets)
    size = np.array([len(s) for s in sets], float)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    forest = Forest(len(ids))
    return [(ids[i], ids[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True) if i != j and forest.join(i, j)]


def links_between(ids: list[int], sets: list[np.ndarray], asked: np.ndarray, percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets that are asked for and the others."""
    one, other = np.flatnonzero(asked), np.flatnonzero(~asked)
    size = np.array([len(s) for s in sets], float)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    number = np.cumsum(np.append(True, values[1:] != values[:-1])) - 1
    mine = np.bincount(number, asked[owner])
    shared = ((mine > 0) & (mine < np.bincount(number)))[number]
    number, owner = np.unique(number[shared], return_inverse=True)[1], owner[shared]
    row = np.empty(len(sets), np.int64)
    row[one], row[other] = np.arange(len(one)), np.arange(len(other))
    both = np.zeros((len(one), len(other)), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        lo, hi = np.searchsorted(number, [a, a + columns])
        wide = min(columns, int(number[-1]) + 1 - a)
        x, y = np.zeros((len(one), wide), np.float32), np.zeros((len(other), wide), np.float32)
        of = owner[lo:hi]
        yes = asked[of]
        x[row[of[yes]], number[lo:hi][yes] - a] = 1
        y[row[of[~yes]], number[lo:hi][~yes] - a] = 1
        both += x @ y.T
    linked = 100 * both.astype(np.float64) >= percent * (size[one][:, None] + size[other][None, :] - both)
    forest = Forest(len(ids))
    return [(ids[i], ids[j]) for i, j in zip(one[np.nonzero(linked)[0]].tolist(), other[np.nonzero(linked)[1]].tolist(), strict=True) if ids[i] != ids[j] and forest.join(i, j)]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _within_blocks(members: DataFrame, words: int, percent: int) -> DataFrame:
    def run(data: pa.Table) -> pa.Table:
        sets = shingle_sets([t or "" for t in data.column("text").to_pylist()], words)
        return pa.Table.from_batches([from_rows(links_of(data.column("rep").to_pylist(), sets, percent), _LINK)])

    return members.groupBy("cluster", "block").applyInArrow(run, "a long, b long")


def _sets(members: DataFrame, words: int, percent: int) -> DataFrame:
    """members with their shingles in place of the text. Sets of bands that aren't neighbours differ too much in size for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bites(batches, "text", 400_000):
            made = shingle_sets(texts(batch), words)
            bands = [int(np.floor(np.log(len(s)) / np.log(100 / percent) + 1e-9)) if percent < 100 else len(s) for s in made]
            columns = [batch.column(c) for c in ("cluster", "rows", "block", "rep")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.int32()), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["cluster", "rows", "block", "rep", "band", "n", "shingles"])

    return members.select("cluster", "rows", "block", "rep", "text").mapInArrow(run, "cluster long, rows long, block int, rep long, band int, n long, shingles binary")


def confirm(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """docs(doc_id, text), clusters(rep, cluster, n_shingles) -> links (a, b) that connect whatever the similarity connects within a cluster."""
    blocks = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("total"))
    blocks = blocks.select("cluster", "rows", F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.least(F.col("rows"), F.col("total") / BLOCK_SHINGLES))).cast("int").alias("blocks"))
    dealt = cut(clusters.join(blocks, "cluster").select("rep", "cluster", "rows", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")))
    side = F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt
    members = cut(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(side, "rep"))
    links = cut(_within_blocks(members, words, percent))
    large = members.where("blocks > 1")
    if large.isEmpty():
        return links
    large = cut(_sets(large, words, percent))
    pivots = large.where(F.pmod(F.xxhash64("rep", F.lit("pivot")), F.ceil(F.col("rows") / PIVOTS)) == 0)
    links = cut(links.union(_against_all(pivots, large, percent)))
    found = connected_components(links)
    placed = cut(large.select("cluster", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    main = placed.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    others = cut(placed.join(main, "cluster").where("component <> main").select("rep"))
    return links.union(_against_all(large.join(others, "rep", "left_semi"), large, percent))


def _against_all(queries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between the queries and the members of their cluster, tile by tile: a part of the queries of one band against a part of the members of one next to it."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / TILE_ROWS, F.least(F.count(F.lit(1)), F.sum("n") / TILE_SHINGLES))).cast("int")
    q_parts = cut(queries.groupBy("cluster", F.col("band").alias("q_band")).agg(parts.alias("q_parts")))
    m_parts = cut(members.groupBy("cluster", F.col("band").alias("m_band")).agg(parts.alias("m_parts")))
    near = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))
    place = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = queries.select("cluster", F.col("band").alias("q_band"), "rep", "shingles", near.alias("m_band")).join(q_parts, ["cluster", "q_band"]).join(m_parts, ["cluster", "m_band"])
    asked = asked.select("cluster", "q_band", place("q_parts", "query").alias("q_part"), "m_band", every("m_parts").alias("m_part"), F.lit(True).alias("asked"), "rep", "shingles")
    given = members.select("cluster", F.col("band").alias("m_band"), "rep", "shingles", near.alias("q_band")).join(m_parts, ["cluster", "m_band"]).join(q_parts, ["cluster", "q_band"])
    given = given.select("cluster", "q_band", every("q_parts").alias("q_part"), "m_band", place("m_parts", "member").alias("m_part"), F.lit(False).alias("asked"), "rep", "shingles")

    def run(data: pa.Table) -> pa.Table:
        asked, sets = data.column("asked").to_numpy(zero_copy_only=False), [np.frombuffer(s, np.uint64) for s in data.column("shingles").to_pylist()]
        found = links_between(data.column("rep").to_pylist(), sets, asked, percent) if asked.any() and not asked.all() else []
        return pa.Table.from_batches([from_rows(found, _LINK)])

    return asked.unionByName(given).groupBy("cluster", "q_band", "q_part", "m_band", "m_part").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row for each row.

    Links join documents with 100 * intersection >= percent * union of their sets of shingles of `words` words."""
    with cuts() as made:
        signed = made.keep(cut(sign(docs, words)))
        classes = made.keep(cut(signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))))
        live = classes.where("n_shingles > 0 and rep is not null")
        clusters = connected_components(forest_links(live)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        sized = live.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles"))
        found = made.keep(connected_components(confirm(docs, clusters.join(sized, "rep"), words, percent)))
    placed = classes.select("d1", "d2", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(placed, ["d1", "d2"])
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
