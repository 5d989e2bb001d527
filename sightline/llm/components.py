"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, cuts, forget


class Forest:
    """Union-find over 0..n-1 for the inside of one task; roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        """The roots of all."""
        parent = np.array(self.parent, np.int64)
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        return parent


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around the smallest node of each of its components."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    a, b = (np.concatenate([x.column(c).to_numpy() for x in got]) for c in ("a", "b"))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for i, j in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        forest.join(i, j)
    root = np.fromiter(map(forest.root, range(len(nodes))), np.int64, len(nodes))
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[root[leaf]]), pa.array(nodes[leaf])], schema=_EDGE)


def _stars(edges: DataFrame) -> DataFrame:
    return cut(edges.mapInArrow(_local, "a long, b long").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b), longs -> (node, component): the smallest node reachable, for each node that has an edge to another.

    Each partition's edges first become stars by union-find: no more edges than nodes, and short ways. Then rounds of contraction: each node hooks to its smallest neighbour, hooks are followed twice, and the edges are
    rewritten between the nodes hooked to, without repeats. Every round at least halves the nodes that still have edges, so the
    rounds grow with the logarithm of a component's length. Minima are aggregated before any shuffle; a hub's edges
    collapse to one row in a round, and the joins on hubs are plain equi-joins that adaptive execution can split.
    Null ends and loops are dropped; repeated edges count once; no edge gives an empty result.
    """
    both = lambda e: e.union(e.select(F.col("b"), F.col("a")))
    with cuts() as made:
        # Written first: whatever Python makes the edges doesn't run beside this one in a task.
        given = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"))
        live, labels = _stars(given), None
        forget(given)
        while not live.isEmpty():
            near = cut(both(live).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")))
            onward = near.select(F.col("v").alias("p"), F.col("p").alias("q"))
            hook = cut(near.join(onward, "p").select("v", F.col("q").alias("p")))
            forget(near)
            if labels is None:
                labels = hook.select(F.col("v").alias("node"), F.col("p").alias("component"))
            else:
                labels = labels.join(hook, labels["component"] == hook["v"], "left").select("node", F.coalesce("p", "component").alias("component"))
            left, right = hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
            before, live = live, _stars(live.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
            forget(before)
        if labels is None:
            labels = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return made.keep(cut(labels))
