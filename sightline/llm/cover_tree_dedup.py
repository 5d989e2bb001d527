"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors are compared within their label (and dimension) only, as unit vectors, whose chord distance d has cosine 1 - d*d/2. Equal vectors collapse to one with a weight.

1. Top of the tree: at most PIVOTS vectors, those of the smallest hashes, are the nodes of the upper level over all labels; each vector belongs to the
   nearest pivot of its label. A dense region gets pivots in proportion to its rows, so cells stay even. Cells with more than SPLIT_ROWS vectors
   get pivots of their own, beside the one they have, level by level; a cell with more than BLOCK_ROWS vectors is dealt into rings by the distance from its pivot, and rings into blocks.
   Vectors are routed anew in each pass over the input, which is cheaper than writing them with their cells, and go through one shuffle only, in which a task sends each of its distinct vectors once.
2. Each block becomes a cover tree, once: nested levels of centres with halving radii, every node with its true covering radius. Neighbouring cells' blocks make a stripe, a folder of STRIPE_BYTES of vectors at most.
3. Two stripes with cells whose balls come near each other for the threshold are a task, which reads both folders: no block is copied for its pairs. There pairs of blocks whose balls or rings are too far apart
   are dropped; the others are traversed together: a pair of nodes is
   pruned if its balls can't hold a linked pair, counted as a whole if they can't hold an unlinked one, and else replaced by the pairs of
   their children. Distances are computed for children of live pairs only, and not where the parents' distance already rules a link out or is the children's own.
   Many children are first screened in single precision, with slack, by their distance in PROJECTED directions, which never exceeds the true one.
   Single vectors are compared in double precision.
A task returns how many vectors each of its vectors is linked with and a spanning forest of the links, never the pairs.

Memory: a task holds two stripes. Disk: the vectors once in the shuffle and once in the blocks, whatever the number of pairs. Where vectors have no near neighbours in many dimensions, balls overlap and few pairs of blocks are pruned:
the comparisons, and what is read of the stripes, then grow with the square of a label's distinct vectors.

Edge cases: null, empty and zero vectors, vectors with null or non-finite components, and rows with a null label or vec_id link with nothing and are their own component (null
for a null vec_id); vectors of different lengths aren't compared; repeated rows are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .runtime import cut, cuts, forget, from_rows

#: Pivots that one level of the tree's top gets, its levels, and rows of a cell from which it is split again.
PIVOTS = 512
LEVELS = 4
SPLIT_ROWS = 65_536
BLOCK_ROWS = 1024
RADII = (2.0, 1.0, 0.5, 0.25, 0.125, 0.0625)
SLACK = 1e-9
#: Children of a pair of nodes from which their centres are compared by one product; pairs of nodes that are gathered at a time.
WIDE, SLICE = 256, 1 << 15
#: Directions in which many children are screened, radius up to which nodes are, and children of a side at a time.
PROJECTED, SMALL, RUN = 12, 0.1, 8192
#: Vectors of a stripe in bytes, as doubles; stripes that a table has at least, unless they get smaller than four blocks; pairs of stripes in a job; distinct vectors that a task remembers.
STRIPE_BYTES, STRIPES, TILES, SEEN = 32 << 20, 12, 96, 1 << 17


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class CoverTree:
    """Levels of nodes; a node covers the vectors members[lo:hi] within its radius of the vector `centre`, which is `gap` away from its parent's. The first level is one node, the last the vectors
    themselves; children of node k are the nodes first[k] to first[k + 1] of the next level, and one of them has its centre."""

    _ARRAYS = ("centre", "lo", "hi", "radius", "gap", "first")

    def __init__(self, x: np.ndarray, levels: list[dict[str, np.ndarray]], members: np.ndarray):
        self.x, self.levels, self.members = x, levels, members
        self._features: dict[tuple, np.ndarray] = {}

    @classmethod
    def grown(cls, x: np.ndarray) -> CoverTree:
        """A node's vectors fall to the first centre within the next radius; what is left makes a centre of its first."""
        dots = x @ x.T if len(x) <= 4096 else None
        nodes = [(0, np.arange(len(x)))]
        shape: list[tuple[list[int], list]] = [([0], nodes)]
        for r in RADII[1:]:
            parents, lower = [], []
            for parent, (centre, rest) in enumerate(nodes):
                while len(rest) > 1:
                    near = (2 - 2 * (dots[centre, rest] if dots is not None else x[rest] @ x[centre]) <= r * r) | (rest == centre)
                    parents.append(parent)
                    lower.append((centre, rest[near]))
                    rest = rest[~near]
                    centre = int(rest[0]) if len(rest) else centre
                if len(rest):
                    parents.append(parent)
                    lower.append((int(rest[0]), rest))
            nodes = lower
            shape.append((parents, nodes))
        members = np.concatenate([m for _, m in nodes])
        shape.append(([k for k, (_, m) in enumerate(nodes) for _ in m], [(i, np.array([i])) for i in members.tolist()]))
        levels: list[dict[str, np.ndarray]] = []
        for parents, level in shape:
            size = np.array([len(m) for _, m in level])
            hi = np.cumsum(size)
            centre = np.array([c for c, _ in level])
            inside = np.concatenate([m for _, m in level])
            far = np.sqrt(np.maximum(0, 2 - 2 * (x[inside] * x[np.repeat(centre, size)]).sum(axis=1)))
            far[inside == np.repeat(centre, size)] = 0
            above = levels[-1]["centre"][parents] if levels else centre
            gap = np.where(above == centre, 0.0, np.sqrt(np.maximum(0, 2 - 2 * (x[above] * x[centre]).sum(axis=1))))
            if levels:
                levels[-1]["first"] = np.searchsorted(parents, np.arange(len(levels[-1]["centre"]) + 1))
            levels.append({"centre": centre, "lo": hi - size, "hi": hi, "radius": np.maximum.reduceat(far, hi - size), "gap": gap, "first": np.zeros(0, np.int64)})
        return cls(x, levels, members)

    def packed(self) -> bytes:
        """All but the vectors: how many nodes each level has, then the arrays."""
        head = np.array([len(self.levels), *(len(level["centre"]) for level in self.levels)], "<i8")
        parts = [level[k].astype("<f8" if k in ("radius", "gap") else "<i4").tobytes() for level in self.levels for k in self._ARRAYS]
        return b"".join([head.tobytes(), *parts, self.members.astype("<i4").tobytes()])

    @classmethod
    def unpacked(cls, x: np.ndarray, data: bytes) -> CoverTree:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8).tolist(), 8 + 8 * n, []
        for depth, size in enumerate(sizes):
            level = {}
            for k in cls._ARRAYS:
                length = (size + 1 if depth + 1 < n else 0) if k == "first" else size
                kind = np.dtype("<f8" if k in ("radius", "gap") else "<i4")
                level[k] = np.frombuffer(data, kind, length, at).astype("<f8" if kind.kind == "f" else "<i8")
                at += kind.itemsize * length
            levels.append(level)
        return cls(x, levels, np.frombuffer(data, "<i4", len(x), at).astype("<i8"))

    @classmethod
    def merged(cls, trees: list[CoverTree]) -> CoverTree:
        """The trees side by side: the first level has a node for each."""
        at = np.cumsum([0, *(len(t.x) for t in trees)])[:-1]
        levels: list[dict[str, np.ndarray]] = []
        for depth in range(len(trees[0].levels)):
            own = [t.levels[depth] for t in trees]
            level = {k: np.concatenate([lv[k] + o for lv, o in zip(own, at, strict=True)]) for k in ("centre", "lo", "hi")}
            level |= {k: np.concatenate([lv[k] for lv in own]) for k in ("radius", "gap")}
            if depth + 1 < len(trees[0].levels):
                ends = np.cumsum([0, *(len(t.levels[depth + 1]["centre"]) for t in trees)])
                level["first"] = np.concatenate([*(lv["first"][:-1] + e for lv, e in zip(own, ends, strict=False)), ends[-1:]])
            else:
                level["first"] = np.zeros(0, np.int64)
            levels.append(level)
        return cls(np.concatenate([t.x for t in trees]), levels, np.concatenate([t.members + o for t, o in zip(trees, at, strict=True)]))

    def features(self, depth: int, basis: np.ndarray | None, limit: float, second: bool) -> np.ndarray:
        """A row for each node of a level; the product of one's row with another's as `second` is negative only if the distance of their centres, in the basis's directions, is over limit + both radii:
        |p|^2 + |q|^2 - 2 pq <= (limit + r + s)^2 is pq + rs + f(p, r) + f(q, s) >= 0 with f(p, r) = (r^2 + 2 limit r - |p|^2) / 2 + limit^2 / 4."""
        key = (depth, basis is None, second)
        if key not in self._features:
            level = self.levels[depth]
            p = self.x[level["centre"]] if basis is None else self.x[level["centre"]] @ basis
            r = level["radius"]
            f, one = (r * r + 2 * limit * r - (p * p).sum(axis=1)) / 2 + limit * limit / 4, np.ones(len(r))
            self._features[key] = np.column_stack([p, r, one, f] if second else [p, r, f, one]).astype(np.float32)
        return self._features[key]


def directions(x: np.ndarray) -> np.ndarray | None:
    """An orthonormal basis of about the directions in which vectors differ most, from 1024 of them; None if there are few anyway. Any basis gives right results."""
    if x.shape[1] <= PROJECTED + 4:
        return None
    some = x[:: max(1, len(x) // 1024)]
    some = some - some.mean(axis=0)
    basis = np.random.default_rng(0).normal(size=(x.shape[1], PROJECTED))
    for _ in range(3):
        basis = np.linalg.qr(some.T @ (some @ basis) + 1e-12 * basis)[0]
    return basis


def _screened(a: CoverTree, b: CoverTree, depth: int, p: np.ndarray, q: np.ndarray, basis: np.ndarray | None, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of nodes p of a and q of b whose balls may hold a link, and some others. Wide balls aren't told apart in a few directions, so they are compared in all."""
    if basis is not None:
        small, small2 = a.levels[depth]["radius"][p] <= SMALL, b.levels[depth]["radius"][q] <= SMALL
        parts = [(p[small], q[small2], basis), (p[~small], q, None), (p[small], q[~small2], None)]
    else:
        parts = [(p, q, None)]
    found = []
    for one, two, by in parts:
        if len(one) and len(two):
            hit = np.flatnonzero((a.features(depth, by, limit, False)[one] @ b.features(depth, by, limit, True)[two].T >= -1e-4).ravel())
            if by is not None and len(hit) > len(one) * len(two) // 32:
                hit = np.flatnonzero((a.features(depth, None, limit, False)[one] @ b.features(depth, None, limit, True)[two].T >= -1e-4).ravel())
            found.append((one[hit // len(two)], two[hit % len(two)]))
    if not found:
        return p[:0], q[:0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _descend(a: CoverTree, b: CoverTree, depth: int, i: np.ndarray, j: np.ndarray, dots: np.ndarray, limit: float, same: bool, tally: dict, basis: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of children of the node pairs (i, j) that may hold a link, with their centres' products. Pairs whose parents' distance and gaps rule a link out aren't compared, nor are centres that the parents have."""
    pa_, pb, na, nb = a.levels[depth], b.levels[depth], a.levels[depth + 1], b.levels[depth + 1]
    ni, nj = pa_["first"][i + 1] - pa_["first"][i], pb["first"][j + 1] - pb["first"][j]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # Many children on both sides: products of their centres, for a node of a and neighbouring ones of b at a time.
    wide = (ni * nj >= WIDE) & (np.minimum(ni, nj) > 1)
    order = np.flatnonzero(wide)[np.lexsort((j[wide], i[wide]))]
    begin = 0
    while begin < len(order):
        k, end, width = order[begin], begin + 1, int(nj[order[begin]])
        while end < len(order) and i[order[end]] == i[k] and j[order[end]] == j[order[end - 1]] + 1 and width + nj[order[end]] <= RUN:
            width += int(nj[order[end]])
            end += 1
        lo, lo2 = int(pa_["first"][i[k]]), int(pb["first"][j[k]])
        p, q = _screened(a, b, depth + 1, np.arange(lo, lo + ni[k]), np.arange(lo2, lo2 + width), basis, limit + SLACK)
        tally["distances"] = tally.get("distances", 0) + int(ni[k]) * width
        if same:
            p, q = p[p <= q], q[p <= q]
        for c in range(0, len(p), SLICE):
            one, two = p[c : c + SLICE], q[c : c + SLICE]
            made = np.einsum("kd,kd->k", a.x[na["centre"][one]], b.x[nb["centre"][two]])
            far = limit + SLACK + na["radius"][one] + nb["radius"][two]
            live = (2 - 2 * made <= far * far) | (same & (one == two))
            found.append((one[live], two[live], made[live]))
        begin = end
    i, j, dots, ni, nj = (x[~wide] for x in (i, j, dots, ni, nj))
    ends = np.cumsum(ni * nj)
    begins = ends - ni * nj
    for s in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
        place = np.arange(s, min(s + SLICE, int(ends[-1])))
        at = np.searchsorted(ends, place, "right")
        inner = place - begins[at]
        p, q = pa_["first"][i[at]] + inner // nj[at], pb["first"][j[at]] + inner % nj[at]
        reach = limit + SLACK + na["radius"][p] + nb["radius"][q]
        go = np.sqrt(np.maximum(0, 2 - 2 * dots[at])) - na["gap"][p] - nb["gap"][q] <= reach + SLACK
        if same:
            go &= (i[at] != j[at]) | (p <= q)
        at, p, q, reach = at[go], p[go], q[go], reach[go]
        known = (na["centre"][p] == pa_["centre"][i[at]]) & (nb["centre"][q] == pb["centre"][j[at]])
        made = dots[at]
        new = np.flatnonzero(~known)
        made[new] = np.einsum("kd,kd->k", a.x[na["centre"][p[new]]], b.x[nb["centre"][q[new]]])
        tally["distances"] = tally.get("distances", 0) + len(new)
        live = (2 - 2 * made <= reach * reach) | (same & (p == q))
        found.append((p[live], q[live], made[live]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def dual_traversal(a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool, tally: dict | None = None, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(weight linked with each vector of a, the same for b, spanning links (i of a, j of b)); same: a and b are one tree, and each vector's own weight isn't counted. tally gets the number of distances. pairs: of nodes of the first level, (i, j), i <= j if same."""
    limit, tally = math.sqrt(2 - 2 * cosine), {} if tally is None else tally
    la, lb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    wa_in, wb_in = wa[a.members], wb[b.members]
    sa, sb = np.append(0, np.cumsum(wa_in)), np.append(0, np.cumsum(wb_in))
    ca, cb = np.zeros(len(a.x) + 1, np.int64), np.zeros(len(b.x) + 1, np.int64)  # differences over positions in members
    forest, links = Forest(len(a.x) + (0 if same else len(b.x))), []
    shift = 0 if same else len(a.x)

    def connect(i: np.ndarray, j: np.ndarray) -> None:
        """Joins the ends of links, more and more at a time: of those only what isn't connected yet is looked at one by one."""
        at, step = 0, 1024
        while at < len(i):
            p, q = i[at : at + step], j[at : at + step]
            if len(p) == step:
                roots = forest.roots()
                new = roots[p] != roots[q + shift]
                p, q = p[new], q[new]
            for x, y in zip(p.tolist(), q.tolist(), strict=True):
                if forest.join(x, y + shift):
                    links.append((x, y))
            at, step = at + step, step * 4

    def places(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of the ranges, and each one's range."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        return np.arange(len(which)) - np.repeat(np.cumsum(size) - size - lo, size), which

    i, j = (np.array([0]), np.array([0])) if pairs is None else pairs
    dots, basis = np.einsum("kd,kd->k", a.x[a.levels[0]["centre"][i]], b.x[b.levels[0]["centre"][j]]), directions(a.x)
    for depth, (na, nb) in enumerate(zip(a.levels, b.levels, strict=True)):
        if depth:
            i, j, dots = _descend(a, b, depth - 1, i, j, dots, limit, same, tally, basis)
        if depth == len(a.levels) - 1:
            if same:
                i, j, dots = (x[i != j] for x in (i, j, dots))
            hit = dots >= cosine
            connect(na["centre"][i[hit]], nb["centre"][j[hit]])
            np.add.at(la, na["centre"][i[hit]], wb[nb["centre"][j[hit]]])
            np.add.at(lb, nb["centre"][j[hit]], wa[na["centre"][i[hit]]])
            break
        d = np.sqrt(np.maximum(0, 2 - 2 * dots))
        if same:
            d[i == j] = 0
        reach = na["radius"][i] + nb["radius"][j]
        live = d - reach <= limit + SLACK
        all_linked = live & (d + reach <= limit - SLACK)
        p, q = i[all_linked], j[all_linked]
        cost = np.cumsum(na["hi"][p] - na["lo"][p] + nb["hi"][q] - nb["lo"][q])
        for some in np.split(np.arange(len(p)), np.flatnonzero(np.diff(cost >> 20)) + 1):
            lo, hi, lo2, hi2 = na["lo"][p[some]], na["hi"][p[some]], nb["lo"][q[some]], nb["hi"][q[some]]
            own = (p[some] == q[some]) & same
            np.add.at(ca, lo, sb[hi2] - sb[lo2])
            np.add.at(ca, hi, sb[lo2] - sb[hi2])
            np.add.at(cb, lo2[~own], (sa[hi] - sa[lo])[~own])
            np.add.at(cb, hi2[~own], (sa[lo] - sa[hi])[~own])
            alone, _ = places(lo[own], hi[own])
            la[a.members[alone]] -= wa_in[alone]
            first, second = a.members[lo], b.members[lo2]
            at, which = places(lo2, hi2)
            other = b.members[at]
            real = ~own[which] | (other != first[which])
            connect(first[which][real], other[real])
            at, which = places(lo[~own] + 1, hi[~own])
            connect(a.members[at], second[~own][which])
        go = live & ~all_linked
        i, j, dots = i[go], j[go], dots[go]
    la[a.members] += np.cumsum(ca[:-1])
    lb[b.members] += np.cumsum(cb[:-1])
    return la, lb, links


_ROW = [("stripe", pa.int32()), ("sub", pa.int32()), ("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("far", pa.float64()), ("h1", pa.int64()), ("h2", pa.int64()), ("vec_id", pa.int64()), ("w", pa.int64())]
_BLOCK = pa.schema([("home", pa.int32()), ("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("near", pa.float64()), ("far", pa.float64()), ("h1s", pa.binary()), ("h2s", pa.binary()), ("reps", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()), ("tree", pa.binary())])
_BLOCK_SQL = "home int, label string, dim int, cell int, block long, near double, far double, h1s binary, h2s binary, reps binary, weights binary, vectors binary, tree binary"
_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
_MIX = np.array([1_000_003, 7919, 31], np.int64)


def usable(column: str) -> F.Column:
    return F.expr(f"coalesce(forall(`{column}`, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(`{column}`, x -> x <> 0), false)")


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _place(batch: pa.RecordBatch, levels: list[dict[tuple, tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimension, cell, distance from its pivot) of each row: level by level the nearest of the pivots that its present cell offers."""
    v = batch.column("v")
    dims = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, at = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
    cells, far = np.full(len(dims), -1, np.int64), np.full(len(dims), 2.0)
    labels = batch.column("label").dictionary_encode()
    names, codes = labels.dictionary.to_pylist(), labels.indices.to_numpy(zero_copy_only=False)
    for heads in levels:
        order = np.lexsort((cells, dims, codes))
        starts = _runs(codes[order], dims[order], cells[order])
        for ks in np.split(order, starts[1:]):
            key = (names[codes[ks[0]]], int(dims[ks[0]]), int(cells[ks[0]])) if len(ks) else None
            if key in heads:
                numbers, centres = heads[key]
                d = distances(unit(flat[at[ks][:, None] + np.arange(key[1])]), centres)
                near = d.argmin(axis=1)
                cells[ks], far[ks] = numbers[near], d[np.arange(len(ks)), near]
    return dims, cells, far


def _fresh(batch: pa.RecordBatch, seen: dict) -> np.ndarray:
    """The rows of vectors that the task doesn't remember; it remembers them from now on, as [row of this batch]."""
    found = []
    for k, key in enumerate(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)):
        if key not in seen:
            seen[key] = [k]
            found.append(k)
    return np.array(found, np.int64)


def linked_blocks(live: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """live(vec_id, label string, v array<double or float>, h1, h2), usable, h1 and h2 a vector's hashes -> names(uid, h1, h2, rep, w), a row for each distinct vector with its least vec_id and its rows, and
    (a, b, links): rows (a, null, n) add n to the links of a; rows (a, b, null) are spanning links."""
    spark, limit = live.sparkSession, math.sqrt(2 - 2 * cosine)
    kind = "<f4" if dict(live.dtypes)["v"] == "array<float>" else "<f8"
    width, seen_most, block_rows = max(limit / 2, 0.02), SEEN, BLOCK_ROWS
    pivots: list[tuple[str, int, np.ndarray]] = []  # label, dimension, unit vector; the number is the cell's
    levels: list[dict[tuple, tuple[np.ndarray, np.ndarray]]] = []

    def draw(keys: DataFrame, most: int) -> dict[tuple, list[int]]:
        """New pivots by (label, dimension, cell they lie in): the vectors of the smallest hashes."""
        mix = F.xxhash64(F.lit(len(levels)), "h1", "h2")
        least = [r[0] for r in keys.select(mix.alias("m")).distinct().orderBy("m").limit(most).collect()]
        found: dict[tuple, list[int]] = {}
        if not least:
            return found
        rows = live.where(mix.isin(least)).select("label", "v", mix.alias("m")).distinct().orderBy("m", "label", "v").collect()
        batch = pa.RecordBatch.from_arrays([pa.array([r["label"] for r in rows], pa.string()), pa.array([r["v"] for r in rows], pa.list_(pa.float64()))], ["label", "v"])
        for r, dim, cell in zip(rows, *(x.tolist() for x in _place(batch, levels)[:2]), strict=True):
            found.setdefault((r["label"], dim, cell), []).append(len(pivots))
            pivots.append((r["label"], dim, unit(np.array([r["v"]]))[0]))
        return found

    def heads(choices: dict[tuple, list[int]]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
        return {key: (np.array(ks), np.array([pivots[k][2] for k in ks])) for key, ks in choices.items()}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            batch = batch.take(pa.array(_fresh(batch, seen)))
            if len(seen) > seen_most:
                seen.clear()
            dims, cells, far = _place(batch, levels)
            rings = np.where(cells < 0, 0, far / width).astype(np.int64)
            labels = batch.column("label").dictionary_encode()
            names, codes = labels.dictionary.to_pylist(), labels.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((rings, cells, dims, codes))
            groups = np.split(order, _runs(codes[order], dims[order], cells[order], rings[order])[1:]) if len(order) else []
            rows = [(names[codes[g[0]]], int(dims[g[0]]), int(cells[g[0]]), int(rings[g[0]]), len(g), float(far[g].max())) for g in groups]
            yield from_rows(rows, pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("ring", pa.int32()), ("rows", pa.int64()), ("far", pa.float64())]))

    def inside(large: set[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, cells, _ = _place(batch, levels)
                keep = [key in large for key in zip(batch.column("label").to_pylist(), dims.tolist(), cells.tolist(), strict=True)]
                yield batch.select(["h1", "h2"]).filter(pa.array(keep, pa.bool_()))

        return live.mapInArrow(run, "h1 long, h2 long")

    keys = cut(live.select("h1", "h2").distinct())
    levels.append(heads(draw(keys, max(1, min(PIVOTS, -(-keys.count() // BLOCK_ROWS))))) if not keys.isEmpty() else {})
    forget(keys)
    while True:
        rings = cut(live.mapInArrow(measured, "label string, dim int, cell int, ring int, rows long, far double").groupBy("label", "dim", "cell", "ring").agg(F.sum("rows").alias("rows"), F.max("far").alias("far")))
        if len(levels) == LEVELS:
            break
        cells = rings.groupBy("label", "dim", "cell").agg(F.sum("rows").alias("rows")).where(F.col("rows") > SPLIT_ROWS)
        large = {(r["label"], r["dim"], r["cell"]) for r in cells.limit(PIVOTS * LEVELS).collect()}
        more = draw(inside(large), PIVOTS) if large else {}
        if not more:
            break
        forget(rings)
        levels.append(heads({key: [*([key[2]] if key[2] >= 0 else []), *ks] for key, ks in more.items()}))

    # Cells under pivots: no more than there are pivots, PIVOTS * LEVELS. Vectors of a large one are dealt into rings around the pivot, and those of a ring into blocks. Labels without a pivot stand alone.
    of_cell: dict[int, dict[int, int]] = {}
    balls: dict[int, float] = {}
    for r in rings.where("cell >= 0").collect():
        of_cell.setdefault(r["cell"], {})[r["ring"]] = r["rows"]
        balls[r["cell"]] = max(r["far"], balls.get(r["cell"], 0.0))
    alone = rings.where("cell < 0").agg(F.coalesce(F.sum(F.col("rows") * F.col("dim") * 8), F.lit(0))).first()[0]
    bytes_of = {c: sum(n.values()) * pivots[c][1] * 8 for c, n in of_cell.items()}
    most = min(STRIPE_BYTES, max(2 << 20, (sum(bytes_of.values()) + alone) // STRIPES))
    subs = max(4, -(-most // (4 << 20)))  # parts of a stripe, each built by a task
    blocks_of = np.ones((len(pivots) + 1, 1 + max((k for n in of_cell.values() for k in n), default=0)), np.int64)
    ringed, base, spread = np.zeros(len(pivots) + 1, bool), np.zeros(len(pivots) + 1, np.int64), np.ones(len(pivots) + 1, np.int64)
    groups: dict[tuple[str, int], list[int]] = {}
    for c in sorted(of_cell):
        groups.setdefault(pivots[c][:2], []).append(c)
    stripes, filled = 0, None  # begun; bytes in the last one, None if it takes no more
    for key in sorted(groups):
        first = pivots[groups[key][0]][2]
        groups[key].sort(key=lambda c: float(pivots[c][2] @ first))  # noqa: B023
        if filled is not None and filled >= most // 2:
            filled = None
        for c in groups[key]:
            ringed[c] = sum(of_cell[c].values()) > block_rows
            for ring, n in of_cell[c].items():
                blocks_of[c, ring] = -(-n // block_rows)
            if filled is None or filled + bytes_of[c] > most:
                spread[c] = max(1, -(-bytes_of[c] // most))
                base[c], stripes, filled = stripes, stripes + int(spread[c]), 0 if spread[c] == 1 else None
            else:
                base[c] = stripes - 1
            filled = None if filled is None else filled + bytes_of[c]
    own_base, own = stripes, -(-int(alone) // most)

    schema = pa.schema([*_ROW, ("v", pa.list_(pa.float32() if kind == "<f4" else pa.float64()))])
    row_sql = "stripe int, sub int, label string, dim int, cell int, block long, far double, h1 long, h2 long, vec_id long, w long, v " + dict(live.dtypes)["v"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct vector once, and what its further rows add: a row without the vector."""
        seen: dict[tuple, list] = {}

        def rest() -> Iterator[pa.RecordBatch]:
            rows = [(*place, *key, least, n, None) for key, (place, least, n) in seen.items() if n]
            seen.clear()
            if rows:
                yield from_rows(rows, schema)

        for batch in batches:
            ids, h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "h1", "h2"))
            fresh = _fresh(batch, seen)
            new = batch.take(pa.array(fresh))
            dims, cells, far = _place(new, levels)
            n1 = h1[fresh].view(np.uint64)
            ring = np.minimum((far / width).astype(np.int64), blocks_of.shape[1] - 1)
            ring[~ringed[cells]] = 0
            count = np.where(ringed[cells], blocks_of[cells, ring], 1)
            block = (n1 % count.astype(np.uint64)).astype(np.int64)
            mixed = np.abs(np.stack([ring, block, cells], axis=1) @ _MIX)
            stripe, sub = base[cells] + mixed % spread[cells], mixed // spread[cells] % subs
            if (cells < 0).any():
                crc = np.array([zlib.crc32(f"{d} {t}".encode()) for d, t in zip(dims[cells < 0].tolist(), new.column("label").filter(pa.array(cells < 0)).to_pylist(), strict=True)], np.int64)
                stripe[cells < 0], sub[cells < 0] = own_base + crc % max(own, 1), crc // max(own, 1) % subs
            columns = [stripe, sub, new.column("label"), dims, cells, ring << 32 | block, far, new.column("h1"), new.column("h2"), new.column("vec_id"), np.ones(len(fresh), np.int64), new.column("v")]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            places = zip(stripe.tolist(), sub.tolist(), new.column("label").to_pylist(), dims.tolist(), cells.tolist(), (ring << 32 | block).tolist(), far.tolist(), strict=True)
            for place, a, b in zip(places, h1[fresh].tolist(), h2[fresh].tolist(), strict=True):
                seen[a, b] = [place, 0, 0]
            again = np.ones(batch.num_rows, bool)
            again[fresh] = False
            for k, a, b in zip(ids[again].tolist(), h1[again].tolist(), h2[again].tolist(), strict=True):
                entry = seen[a, b]
                entry[1:] = min(k, entry[1]) if entry[2] else k, entry[2] + 1
            if len(seen) > seen_most:
                yield from rest()
        yield from rest()

    def build(data: pa.Table) -> pa.Table:
        """The blocks of a stripe's part, each with its tree."""
        data = data.combine_chunks()
        column = lambda c: data.column(c).to_numpy()
        names = pc.unique(data.column("label"))
        codes = pc.index_in(data.column("label"), names).to_numpy()
        dims, cells, block, h1, h2 = (column(c) for c in ("dim", "cell", "block", "h1", "h2"))
        v = pa.concat_arrays(data.column("v").chunks)
        valid = v.is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((~valid, h2, h1, block, cells, dims, codes))
        starts = _runs(*(k[order] for k in (codes, dims, cells, block, h1, h2)))
        least, weight = np.minimum.reduceat(column("vec_id")[order], starts), np.add.reduceat(column("w")[order], starts)
        one = order[starts]
        sizes = np.where(valid, dims, 0).astype(np.int64)
        flat, at = v.flatten().to_numpy(), np.cumsum(sizes) - sizes
        rows, bounds = [], [*_runs(*(k[one] for k in (codes, dims, cells, block))).tolist(), len(one)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            for part in np.array_split(np.arange(lo, hi), -(-(hi - lo) // block_rows) if hi - lo > 2 * block_rows else 1):
                k = one[part]
                x, far = flat[at[k][:, None] + np.arange(dims[k[0]])], column("far")[k]
                packed = [z.astype("<i8").tobytes() for z in (h1[k], h2[k], least[part], weight[part])]
                rows.append((int(column("stripe")[0]), names[int(codes[k[0]])].as_py(), int(dims[k[0]]), int(cells[k[0]]), int(block[k[0]]), float(far.min()), float(far.max()), *packed, x.astype(kind).tobytes(), CoverTree.grown(unit(x)).packed()))
        return pa.Table.from_batches([from_rows(rows, _BLOCK)])

    built = live.mapInArrow(dealt, row_sql).groupBy("stripe", "sub").applyInArrow(build, _BLOCK_SQL)
    # A vector's uid is its block's number and its place: 24 bits of a partition, 20 of a block there, 20 of a place.
    serial = F.monotonically_increasing_id()
    blocks = cut(built.withColumn("serial", F.shiftleft(F.shiftright(serial, 33), 40) + F.shiftleft(serial.bitwiseAND((1 << 33) - 1), 20)).withColumn("stripe", F.col("home")), "stripe")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = [np.frombuffer(r[c], "<i8") for c in ("h1s", "h2s", "reps", "weights")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r["serial"] + np.arange(len(parts[0])), *parts)], ["uid", "h1", "h2", "rep", "w"])

    names = blocks.select("serial", "h1s", "h2s", "reps", "weights").mapInArrow(named, "uid long, h1 long, h2 long, rep long, w long")

    def tile(s: int, t: int) -> DataFrame:
        """The links between two stripes, or inside one."""
        own_pivots = {c: pivots[c][2] for k in (s, t) for c in cells_of.get(k, ())}

        def side(rows: list[dict], dim: int) -> tuple[CoverTree, np.ndarray, np.ndarray]:
            trees = [CoverTree.unpacked(unit(np.frombuffer(r["vectors"], kind).reshape(-1, dim)), r["tree"]) for r in rows]
            ids = [r["serial"] + np.arange(len(x.x)) for r, x in zip(rows, trees, strict=True)]
            return CoverTree.merged(trees), np.concatenate(ids), np.concatenate([np.frombuffer(r["weights"], "<i8") for r in rows])

        def compared(one: list[dict], two: list[dict], dim: int) -> pa.RecordBatch:
            same = one is two
            cell, near, far = ([np.array([r[c] for r in rows]) for rows in (one, two)] for c in ("cell", "near", "far"))
            labels: dict[str, int] = {}
            codes = [np.array([labels.setdefault(r["label"], len(labels)) for r in rows]) for rows in (one, two)]
            i, j = np.nonzero(codes[0][:, None] == codes[1][None, :])
            if same:
                i, j = i[i <= j], j[i <= j]
            p, q = ([own_pivots.get(c, np.zeros(dim)) for c in x.tolist()] for x in cell)
            gap = distances(np.array(p), np.array(q))[i, j]
            gap[cell[0][i] == cell[1][j]] = 0
            # Every vector of a block is between near and far from its pivot, and by gap less or more from the other's.
            slack = limit + SLACK
            go = (cell[0][i] < 0) | ((gap - far[0][i] - far[1][j] <= slack) & (near[0][i] - gap - far[1][j] <= slack) & (near[1][j] - gap - far[0][i] <= slack))
            a, ia, wa = side(one, dim)
            b, ib, wb = (a, ia, wa) if same else side(two, dim)
            la, lb, links = dual_traversal(a, b, wa, wb, cosine, same, None, (i[go], j[go]))
            pairs = np.array(links, np.int64).reshape(-1, 2)
            counted = [(ia, la + lb)] if same else [(ia, la), (ib, lb)]
            ends = np.concatenate([ia[pairs[:, 0]], *(ids[n > 0] for ids, n in counted)])
            others = pa.concat_arrays([pa.array(ib[pairs[:, 1]]), pa.nulls(len(ends) - len(pairs), pa.int64())])
            sums = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), *(pa.array(n[n > 0]) for _, n in counted)])
            return pa.RecordBatch.from_arrays([pa.array(ends), others, sums], schema=_OUT)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["dim"], r["label"], r["cell"], r["block"], r["serial"]))
            for dim in sorted({r["dim"] for r in rows}):
                one, two = ([r for r in rows if r["home"] == k and r["dim"] == dim] for k in (s, t))
                if one and two:
                    yield compared(one, one if s == t else two, dim)

        mine = blocks.where(F.col("stripe").isin(s, t)).select("home", "serial", "label", "dim", "cell", "block", "near", "far", "weights", "vectors", "tree")
        return mine.coalesce(1).mapInArrow(run, "a long, b long, links long")

    cells_of: dict[int, list[int]] = {}
    tiles = {(k, k) for k in range(stripes + own)}
    for cs in groups.values():
        centres, reach = np.array([pivots[c][2] for c in cs]), np.array([balls[c] for c in cs])
        for k, c in enumerate(cs):
            for s in range(base[c], base[c] + spread[c]):
                cells_of.setdefault(int(s), []).append(c)
            gap = distances(centres[k : k + 1], centres[k:])[0]
            gap[0] = 0
            for d in np.array(cs)[k:][gap <= reach[k] + reach[k:] + limit + SLACK].tolist():
                tiles |= {(int(min(s, t)), int(max(s, t))) for s in range(base[c], base[c] + spread[c]) for t in range(base[d], base[d] + spread[d])}
    there = {r[0] for r in blocks.select("stripe").distinct().collect()}
    todo = [tile(*x) for x in sorted(tiles) if there.issuperset(x)]
    # A union of single partitions alone would be one partition, and all pairs of stripes one task.
    nothing = blocks.where("stripe < 0").select(F.col("serial").alias("a"), F.col("serial").alias("b"), F.col("serial").alias("links"))
    found = [cut(reduce(DataFrame.union, todo[k : k + TILES], nothing)) for k in range(0, len(todo), TILES)]
    return names, reduce(DataFrame.union, found) if found else spark.createDataFrame([], "a long, b long, links long")


def near_duplicates(table: DataFrame, cosine: float = 0.98) -> DataFrame:
    """table(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), a row for each row. Vectors are known by two 64-bit hashes after the blocks are made."""
    v = F.col("embedding") if dict(table.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    fit = usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    live = rows.where(fit).select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2"))
    with cuts() as made:
        names, found = linked_blocks(live, cosine)
        counts = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "uid")
        components = connected_components(found.where("b is not null").select("a", "b"))
        named = cut(names.join(counts, "uid", "left").join(components.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid")))
        least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        # A vector on the border of two cells may be in both, linked with itself.
        result = named.join(least, "component").groupBy("h1", "h2").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.min("component_id").alias("component_id"))
        result = made.keep(cut(result))
    out = live.select("vec_id", "h1", "h2").join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
