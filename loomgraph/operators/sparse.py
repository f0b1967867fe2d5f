"""Components held by one task as sparse rows of neighbours, and what is done with them there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.blocks import Large, large
from loomgraph.operators.components import connected_components, grouped_components, ranked, set_pairs, unpacked
from loomgraph.plans.scratch import Scratch

#: Most pairs of a component that one task holds; beyond it there are forms by joins.
MOST_PAIRS = 1 << 22
#: Most bytes of a table of bits of all pairs of nodes, and paths that are looked up in one step.
TABLE_BYTES, STEP = 1 << 27, 1 << 19


def by_component(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(component, a, b) of distinct pairs, which are built once."""
    if getattr(pairs, "_loom_path", None) is None:
        pairs = scratch.save(pairs, "undirected")
    parts = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    return pairs.join(parts.select(F.col("node").alias("a"), "component"), "a").select("component", "a", "b")


def parts(of: DataFrame | Graph, scratch: Scratch) -> DataFrame:
    """A row for each pair of a graph, (component, a, b), or of ``PACKED`` sets of nodes that are all pairs."""
    if not isinstance(of, Graph):
        return by_component(of, scratch)
    if of.groups is None:
        return by_component(of.undirected(), scratch)
    return scratch.held(of.groups, lambda: grouped_components(of.groups, scratch))[0]


def parted(of: DataFrame | Graph, scratch: Scratch, most: int) -> tuple[DataFrame, DataFrame | Large | None]:
    """``parts`` of the components of at most ``most`` pairs, and larger ones if there are any: their pairs (component, a, b), or ``Large`` of ``PACKED`` sets."""
    rows = parts(of, scratch)
    if "ids" not in rows.columns:
        return split(rows, scratch, most)
    found = rows.groupBy("component").agg(F.sum("pairs").alias("n")).where(F.col("n") > most).collect()  # few: each has millions of pairs
    if not found:
        return rows, None
    names = sorted(r["component"] for r in found)
    nodes = scratch.held(of.groups, lambda: None)[1]
    return rows.where(~F.col("component").isin(names)), large(rows, nodes, names, sum(r["n"] for r in found), scratch)


def split(pairs: DataFrame, scratch: Scratch, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs of components of at most ``most`` pairs, and those of larger ones if there are any."""
    pairs = scratch.save(pairs, "pairs")
    large = [r["component"] for r in pairs.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()]  # few: each has millions of pairs
    if not large:
        return pairs, None
    return pairs.where(~F.col("component").isin(large)), pairs.where(F.col("component").isin(large))


class Sparse:
    """The undirected graph of pairs of numbers as rows of neighbours in ascending order; ``ids`` in ascending order name the numbers."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, ids: list[str] | None = None):
        self.n, self.a, self.b, self.ids = n, a, b, ids
        keys = np.concatenate([a * n + b, b * n + a])
        keys.sort()
        self.to = np.remainder(keys, max(n, 1), out=keys)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n))])

    @staticmethod
    def of(table: pa.Table) -> Sparse:
        """From distinct pairs (a, b) of ids, or from ``PACKED`` sets of ids that are all pairs."""
        if "ids" in table.column_names:
            names, whose, place = unpacked(table)
            ids, codes = ranked(pa.chunked_array([names]))
            key = set_pairs(whose, codes[place], len(ids))
            return Sparse(len(ids), key // len(ids), key % len(ids), ids)
        ids, codes = ranked(pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]))
        return Sparse(len(ids), codes[: len(table)], codes[len(table) :], ids)

    def forest(self) -> np.ndarray:
        """Which pairs are of a breadth-first forest from each part's first node; a node hangs from the first that reaches it."""
        part = np.arange(self.n)
        while True:
            low = part.copy()
            np.minimum.at(low, self.a, part[self.b])
            np.minimum.at(low, self.b, part[self.a])
            low = low[low]
            if (low == part).all():
                break
            part = low
        up = np.full(self.n, -1)
        front = np.flatnonzero(part == np.arange(self.n))
        up[front] = front
        while len(front):
            counts = self.start[front + 1] - self.start[front]
            at = np.repeat(self.start[front] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            other, own = self.to[at], np.repeat(front, counts)
            new = up[other] < 0
            front, first = np.unique(other[new], return_index=True)
            up[front] = own[new][first]
        return (up[self.a] == self.b) | (up[self.b] == self.a)

    def sides(self) -> np.ndarray:
        """Of how many triangles each pair is a side: the bits that its ends' rows of neighbours have in common, or else by a list."""
        n, t = self.n, np.zeros(len(self.a), np.int64)
        if n * n <= 8 * TABLE_BYTES:
            width = -(-n // 64)
            bits = np.zeros((n * width) << 3, np.uint8)
            i, j = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a])
            np.bitwise_or.at(bits, ((i * width) << 3) + (j >> 3), (1 << (j & 7)).astype(np.uint8))
            rows, step = bits.view(np.uint64).reshape(n, width), max(STEP // max(3 * width, 1), 1)
            for at in range(0, len(t), step):
                some = slice(at, at + step)
                t[some] = np.bitwise_count(rows[self.a[some]] & rows[self.b[some]]).sum(axis=1, dtype=np.int64)
            return t
        keys = np.minimum(self.a, self.b) * n + np.maximum(self.a, self.b)
        order = np.argsort(keys)
        for x, y, z in self.triangles():
            found = np.concatenate([x * n + y, x * n + z, y * n + z])
            t += np.bincount(np.searchsorted(keys, found, sorter=order), minlength=len(keys))
        t[order] = t.copy()
        return t

    def triangles(self):
        """Batches (x, y, z) of the triangles' nodes, each triangle once; paths go from the lower to the higher degree."""
        n = self.n
        rank = np.empty(n, np.int64)
        rank[np.argsort(np.diff(self.start), kind="stable")] = np.arange(n)
        node = np.argsort(rank)
        p, q = rank[self.a], rank[self.b]
        keys = np.sort(np.minimum(p, q) * n + np.maximum(p, q))
        low, high = keys // n, keys % n
        end = np.searchsorted(low, np.arange(n), side="right")[low]  # where the edges of the same lower end stop
        counts = end - np.arange(len(keys)) - 1
        bits = None
        if n * n <= 8 * TABLE_BYTES:
            bits = np.zeros((n * n >> 3) + 1, np.uint8)
            np.bitwise_or.at(bits, keys >> 3, (1 << (keys & 7)).astype(np.uint8))
        sums = np.cumsum(counts)
        first = 0
        while first < len(keys):
            last = max(int(np.searchsorted(sums, (sums[first - 1] if first else 0) + STEP, side="right")), first + 1)
            some = counts[first:last]
            own = np.repeat(np.arange(first, last), some)
            at = own + 1 + np.arange(len(own)) - np.repeat(np.cumsum(some) - some, some)
            key = high[own] * n + high[at]
            if bits is not None:
                hit = (bits[key >> 3] >> (key & 7).astype(np.uint8)) & 1 > 0
            else:
                hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
            own, at = own[hit], at[hit]
            if len(own):
                yield np.sort(node[np.stack([low[own], high[own], high[at]])], axis=0)
            first = last
