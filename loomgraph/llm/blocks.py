"""Groups of bounded size for all-pairs work inside a group.

A group of n rows is cut into c chunks by hash, c such that a chunk holds a bounded number of rows
and bytes. Every pair of rows then meets in exactly one block (i, j) of two chunks, i <= j: chunk i
is copied to the c blocks that have it. Blocks are what is shuffled by, so a hot group is spread
over c (c + 1) / 2 tasks, and what a task holds is two chunks, however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def into_blocks(members: DataFrame, row: Column, chunks: Column) -> DataFrame:
    """``members`` with low, high and chunk: a copy of each row for each block of its group that has its chunk."""
    out = members.withColumn("_c", F.greatest(chunks.cast("int"), F.lit(1)))
    out = out.withColumn("chunk", F.pmod(F.xxhash64(row, F.lit("chunk")), F.col("_c")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return out.withColumn("low", F.least("chunk", "_other")).withColumn("high", F.greatest("chunk", "_other")).drop("_c", "_other")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            col = batch.column(k)
            change |= pc.fill_null(pc.not_equal(col[1:], col[:-1]), True).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        # only the first run of a batch may go on from the batch before
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(0, cuts[1]))
        for a, b in zip(cuts[1:], cuts[2:]):
            yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def star_roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest member of each of n members' component under the links (p, q)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        after = root.copy()
        np.minimum.at(after, p, low)
        np.minimum.at(after, q, low)
        np.minimum.at(after, root[p], low)
        np.minimum.at(after, root[q], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after
