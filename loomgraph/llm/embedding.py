"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

Vectors of one label are scaled to length 1, where cosine >= s is a distance of at most
sqrt(2 - 2 s). A table's key is k Gaussian projections, shifted and cut into steps of WIDTH; two
vectors meet in a table if all k agree. The number of projections follows the number of vectors of
the largest label, so that unrelated vectors seldom meet, and the number of tables is what the
target recall at the threshold asks for. Only vectors with company in a table are sent to it, in
bounded blocks; the many small blocks of a batch are compared in one pass. A pair that
meets in several tables is counted in the first, which each block finds from the vectors alone, so
pairs are never shuffled: a block returns sums for each vector and star edges.

Equal vectors of one label are one class and are compared once. Cosine is taken in double precision.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component, a
null label and a null vec_id link with nothing (component is the own id). Rows that repeat an id
are vectors of their own. Vectors of different lengths never link. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.blocks import into_blocks, star_roots
from loomgraph.llm.text import U, mix, signed
from loomgraph.operators.components import connected_components
from loomgraph.plans.scratch import Scratch

COSINE = 0.98
WIDTH = 2.0
#: Chance that a pair exactly at the threshold is missed by all tables.
MISS = 1e-5
#: Unrelated vectors that a bucket is meant to hold.
LOAD = 0.25
CHUNK_ROWS = 1024
#: Blocks of up to so many vectors are compared together, and so many pairs in one step.
SMALL_ROWS = 48
STEP_PAIRS = 1 << 16
SEED = 20


def meet_chance(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two vectors at this distance into one step."""
    x = width / distance
    tail = 0.5 * math.erfc(x / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


@lru_cache(maxsize=16)
def _lines(size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, size, count])
    return rng.standard_normal((size, count)), rng.uniform(0, WIDTH, count)


@dataclass(frozen=True)
class Tables:
    projections: int
    tables: int

    @staticmethod
    def choose(vectors: int, cosine: float = COSINE) -> Tables:
        near, far = meet_chance(math.sqrt(2 - 2 * cosine)), meet_chance(math.sqrt(2))
        k = max(4, math.ceil(math.log(max(vectors, 1) / LOAD) / -math.log(far))) if vectors > LOAD else 4
        return Tables(k, math.ceil(math.log(MISS) / math.log(1 - near**k)))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) uint64."""
        k, n = self.projections, self.tables
        lines, shift = _lines(unit.shape[1], n * k)
        steps = np.floor((unit @ lines + shift) / WIDTH).astype(np.int64).view(U).reshape(len(unit), n, k)
        out = np.tile(np.arange(n, dtype=U), (len(unit), 1))
        for i in range(k):
            out = mix(out, steps[:, :, i])
        return out


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components as doubles, where each vector starts and ends in them, and which vectors are usable."""
    edges = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.slice(edges[0], edges[-1] - edges[0])
    edges -= edges[0]
    flat = pc.fill_null(values.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) + 0.0  # no minus zero
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    low, high = edges[:-1], edges[1:]
    return flat, edges, column.is_valid().to_numpy(zero_copy_only=False) & (bad[high] == bad[low]) & (some[high] > some[low])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_width(flat: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of the vectors of each length."""
    widths = np.diff(edges)
    for size in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == size)
        yield rows, _unit(flat[edges[rows][:, None] + np.arange(size)])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key of label and vector for every row that can link."""
    for batch in batches:
        labels, ids = batch.column("label"), batch.column("vec_id")
        flat, edges, usable = _flat(batch.column("embedding"))
        usable = usable & labels.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
        data, cuts = memoryview(np.ascontiguousarray(flat)).cast("B"), (8 * edges).tolist()
        names = {x: repr(x).encode() + b"|" for x in labels.unique().to_pylist()}
        keys = [None] * batch.num_rows
        for i, label in zip(np.flatnonzero(usable).tolist(), labels.filter(pa.array(usable)).to_pylist()):
            key = hashlib.blake2b(names[label], digest_size=16)
            key.update(data[cuts[i] : cuts[i + 1]])
            keys[i] = key.digest()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "vkey"])


def _table_keys(batches: Iterator[pa.RecordBatch], tables: Tables) -> Iterator[pa.RecordBatch]:
    n = tables.tables
    for batch in batches:
        flat, edges, _ = _flat(batch.column("embedding"))
        for rows, unit in _by_width(flat, edges):
            keys = signed(mix(tables.keys(unit), unit.shape[1]))
            pick = pa.array(np.repeat(rows, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").take(pick), batch.column("label").take(pick), pa.array(np.tile(np.arange(n, dtype=np.int32), len(rows))), pa.array(keys.ravel())],
                names=["rep", "label", "t", "key"],
            )


BUCKET = ["label", "t", "key", "low", "high"]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks, and where each block starts, from batches that are sorted by block.

    A table holds one batch and the block that began before it.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        change = np.zeros(table.num_rows - 1, bool)
        for name in BUCKET:
            column = table.column(name)
            change |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        held = table.slice(cuts[-1])
        if len(cuts) > 1:
            yield table.slice(0, cuts[-1]), cuts[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each small block, about STEP_PAIRS at a time."""
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL_ROWS)]).tolist():
        i, j = np.triu_indices(size, 1)
        own = starts[sizes == size]
        step = max(1, STEP_PAIRS // len(i))
        for a in range(0, len(own), step):
            base = own[a : a + step, None]
            yield (base + i).ravel(), (base + j).ravel()


def _verify(batches: Iterator[pa.RecordBatch], tables: Tables, cosine: float) -> Iterator[pa.RecordBatch]:
    """Sums of links and star edges of each table of blocks."""
    for table, starts in _whole_blocks(batches):
        n = table.num_rows
        sizes = np.diff(np.append(starts, n))
        if (sizes < 2).all():
            continue
        flat, edges, _ = _flat(table.column("embedding").combine_chunks())
        chunk, reps, copies, t, low, high = (table.column(c).to_numpy() for c in ("chunk", "rep", "n", "t", "low", "high"))
        widths = np.diff(edges)
        unit = np.zeros((n, int(widths.max())))
        for rows, own in _by_width(flat, edges):
            unit[rows, : own.shape[1]] = own
        found = []
        for p, q in _pairs(starts, sizes):
            near = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
            found.append((p[near], q[near]))
        for a, b in zip(starts[sizes > SMALL_ROWS].tolist(), (starts + sizes)[sizes > SMALL_ROWS].tolist()):
            p, q = np.nonzero(np.triu(unit[a:b] @ unit[a:b].T >= cosine, 1))
            found.append((p + a, q + a))
        p, q = (np.concatenate(x) for x in zip(*found))
        # vectors of other lengths meet by hashes only; of a block of two chunks only the pairs across count
        right = (widths[p] == widths[q]) & ((low[p] == high[p]) | (chunk[p] != chunk[q]))
        p, q = p[right], q[right]
        if not len(p):
            continue
        root = star_roots(n, p, q)
        some = np.unique(np.concatenate([p, q]))
        place = np.zeros(n, np.int64)
        keys = np.zeros((len(some), tables.tables), U)
        place[some] = np.arange(len(some))
        for size in np.unique(widths[some]).tolist():
            rows = widths[some] == size
            keys[rows] = tables.keys(unit[some[rows], :size])
        earlier = np.arange(tables.tables)
        fresh = np.zeros(len(p), bool)
        for a in range(0, len(p), STEP_PAIRS):
            x, y = p[a : a + STEP_PAIRS], q[a : a + STEP_PAIRS]
            fresh[a : a + STEP_PAIRS] = ~((keys[place[x]] == keys[place[y]]) & (earlier < t[x][:, None])).any(axis=1)
        p, q = p[fresh], q[fresh]
        links = np.bincount(p, weights=copies[q], minlength=n) + np.bincount(q, weights=copies[p], minlength=n)
        told = np.flatnonzero((links > 0) | (root != np.arange(n)))
        yield pa.RecordBatch.from_arrays([pa.array(reps[told]), pa.array(links[told].astype(np.int64)), pa.array(reps[root[told]])], names=["rep", "links", "root"])


def near_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label)."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    rows = vectors.select("vec_id", "embedding", "label")
    base = rows.mapInArrow(_fingerprints, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, label {kinds['label']}, vkey binary")
    base = scratch.save(base.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    usable = base.where("vkey is not null")
    classes = scratch.save(usable.groupBy("vkey").agg(F.min("rid").alias("rep"), F.count("*").alias("n")), "classes")
    first = usable.join(classes.select(F.col("rep").alias("rid"), "n"), "rid").select(F.col("rid").alias("rep"), "n", "label", "embedding")
    first = scratch.save(first, "first")
    most = first.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables = Tables.choose(most, cosine)

    keyed = first.select("rep", "label", "embedding").mapInArrow(lambda it: _table_keys(it, tables), f"rep long, label {kinds['label']}, t int, key long")
    keyed = scratch.save(keyed, "keys")
    full = keyed.groupBy("label", "t", "key").agg(F.count("*").alias("rows")).where("rows > 1")
    met = keyed.join(full, ["label", "t", "key"])
    blocks = into_blocks(met, F.col("rep"), F.ceil(F.col("rows") / CHUNK_ROWS)).drop("rows")
    heavy = blocks.join(first.select("rep", "n", "embedding"), "rep").repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    found = heavy.mapInArrow(lambda it: _verify(it, tables, cosine), "rep long, links long, root long")
    found = scratch.save(found, "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    ids = usable.select("vkey", "vec_id").join(classes, "vkey")
    placed = ids.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    smallest = placed.groupBy("part").agg(F.min("vec_id").alias("component_id"))
    told = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    told = told.join(smallest, "part").join(links, "rep", "left")
    told = told.select("vkey", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = base.select("vec_id", "vkey").join(told, "vkey", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: The same rows in DuckDB, by brute force.
NEAR_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT a AS vec_id, count(*) AS n FROM near GROUP BY a)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e LEFT JOIN parts p USING (vec_id) LEFT JOIN links l USING (vec_id)
"""
