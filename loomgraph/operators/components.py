"""Connected components by hooking, shortcutting and contracting.

In a round every node hooks to its smallest neighbour if that is smaller, which makes trees; pointers
are doubled until each node points to its tree's root; then edges are drawn between roots, and those
inside of a tree go. At least every second node is no root any more, so edges and nodes shrink from
round to round, and there are about as many rounds as the logarithm of their number.

A hub, or the root of a very large component, is one key of very many rows only in joins of written
tables, whose large partitions Spark splits; all else is summed up before it is shuffled. Nothing but
counts and checksums reaches the driver.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.scratch import Scratch, fixpoint


#: What tells one state of a loop from the next: the number of rows and a checksum of them.
def checksum(*columns: str) -> tuple[Column, Column]:
    return F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


#: Most pairs that are left to one task.
ONE_TASK = 1 << 22


def least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each number's component."""
    part = np.arange(n)
    while True:
        x, y = part[a], part[b]
        apart = x != y
        if not apart.any():
            return part
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(part, np.maximum(x, y), np.minimum(x, y))
        while (part[part] != part).any():
            part = part[part]


def ranked(values: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """The distinct values in ascending order, and the place of each value among them."""
    coded = values.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    found = coded.dictionary.to_pylist()
    order = sorted(range(len(found)), key=found.__getitem__)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return [found[x] for x in order], rank[coded.indices.to_numpy()]


def _joined(batches):
    """(id, f) of all nodes of the pairs (a, b), by one task."""
    table = pa.Table.from_batches(list(batches))
    if len(table):
        ids, codes = ranked(pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]))
        part, kind = least_members(len(ids), codes[: len(table)], codes[len(table) :]), table.schema.field("a").type
        named = pa.array(ids, kind)
        yield from pa.table({"id": named, "f": named.take(pa.array(part))}).to_batches(1 << 16)


#: About how many rows of groups one task takes.
ROWS = 1 << 21
#: Rows of groups that are dealt out at once.
DEALT = 1 << 21
PACKED = "label long, ids array<string>, cells binary, sizes binary, pairs long"


def _pieces(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``values`` as one binary value for each of ``counts``, in order."""
    ends = np.concatenate([[0], np.cumsum(counts * values.itemsize)])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the fewest bytes that hold them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


#: Bytes of numbers from which they are compressed, and what such begin with: their number and width, the compressed bytes.
LEAST_ZIPPED, HEAD = 1 << 10, struct.Struct("<III")


def _zipped(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``_pieces`` of numbers of 32 bits from 0, compressed if there are many to a value; only those have an odd length."""
    if values.nbytes < LEAST_ZIPPED * len(counts):
        return _pieces(values, counts)
    out, ends = [], np.concatenate([[0], np.cumsum(counts)])
    for i, j in zip(ends[:-1], ends[1:]):
        few = _narrow(values[i:j])
        body = pa.compress(few.tobytes(), "zstd", asbytes=True)
        out.append(HEAD.pack(len(few), few.itemsize, len(body)) + body + bytes(1 - len(body) % 2))
    return pa.array(out, pa.binary())


def _unzipped(value: bytes) -> np.ndarray:
    if len(value) % 2 == 0:
        return np.frombuffer(value, np.int32)
    n, width, size = HEAD.unpack_from(value)
    return np.frombuffer(pa.decompress(value[HEAD.size : HEAD.size + size], n * width, "zstd", asbytes=True), f"<u{width}").astype(np.int32)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end of the last one."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in ascending order, by sorting, which for numbers of 64 bits is quicker than by hashing."""
    keys = np.sort(keys)
    return keys[_runs(keys)[:-1]] if len(keys) else keys


def set_pairs(group: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """The distinct pairs of numbers below ``n`` that share a group, as a * n + b, a < b, in ascending order."""
    key = np.sort(group * n + code)
    group, code = key // n, key % n
    found, at, step = [], np.arange(len(key)), 1
    while len(at := at[at + step < len(key)]) and len(at := at[group[at] == group[at + step]]):
        found.append(code[at] * n + code[at + step])
        step += 1
    return distinct(np.concatenate(found)) if found else np.empty(0, np.int64)


def _dealt(bounds: list[int], numbered: bool):
    def deal(batches):
        table = pa.Table.from_batches(batches)
        grp, coded = (table.column(c).combine_chunks().dictionary_encode() for c in ("grp", "id"))
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        names = coded.dictionary.take(pa.array(by_name))
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        key = table.column("key").to_numpy()
        part = np.searchsorted(bounds, key, side="right")
        set_, code = grp.indices.to_numpy(), rank[coded.indices.to_numpy()]
        order = np.lexsort((code, set_, key, part))
        part, set_, code, key = part[order], set_[order], code[order], key[order]
        ends = _runs(part)
        for i, j in zip(ends[:-1], ends[1:]):
            sets = _runs(set_[i:j])
            ids, cells = np.unique(code[i:j], return_inverse=True)
            lists = {"sizes": pa.array(np.diff(sets).astype(np.int32)), "ids": names.take(pa.array(ids)), "cells": pa.array(_narrow(cells))}
            if numbered:
                numbers = key[i:j][sets[:-1]]
                lists |= {"first": pa.array(numbers[:1]), "steps": pa.array(_narrow(np.diff(numbers.view(np.uint64))))}
            else:
                lists["grp"] = grp.dictionary.take(pa.array(set_[i:j][sets[:-1]]))
            row = pa.table({c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in lists.items()})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(row)
            yield pa.RecordBatch.from_arrays([pa.array([part[i]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "body"])

    def kernel(batches):
        """The rows (key, grp, id) by the part that their key is in, many in one row: a set's ids as places among the part's names.

        ``numbered``: a group is its key, and sets are named by the steps from one key to the next.
        """
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= DEALT:
                yield from deal(held)
                held, rows = [], 0
        if held:
            yield from deal(held)

    return kernel


def _packed(batches):
    """The sets of a part's groups (grp, id), each with two ids or more: a row for each of their components there.

    ``ids`` are the component's, ``cells`` the sets' ids by their place in it, one set after the other, and ``sizes`` the sets'.
    """
    found = [pa.ipc.open_stream(body.as_buffer()).read_all() for batch in batches for body in batch.column("body")]
    if not found:
        return
    values = lambda x, c: x.column(c).combine_chunks().flatten()
    coded = pa.chunked_array([pa.DictionaryArray.from_arrays(values(x, "cells").cast(pa.int32()), values(x, "ids")) for x in found]).unify_dictionaries().combine_chunks()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    named = lambda x: values(x, "grp") if "grp" in x.column_names else pa.array(np.cumsum(np.concatenate([values(x, "first").to_numpy(), values(x, "steps").to_numpy().astype(np.int64)])))
    grp = pa.concat_arrays([named(x) for x in found]).dictionary_encode().indices.to_numpy().astype(np.int64)
    grp = np.repeat(grp, np.concatenate([values(x, "sizes").to_numpy() for x in found]))
    del found
    n = len(coded.dictionary)
    keys = distinct(grp * n + coded.indices.to_numpy())
    grp, code = keys // n, keys % n
    several = np.bincount(grp)[grp] > 1
    grp, code = grp[several], code[several]
    if not len(code):
        return
    sets = _runs(grp)
    sizes = np.diff(sets)
    first = np.repeat(code[sets[:-1]], sizes)
    part = least_members(n, first, code)
    ids = np.flatnonzero(np.bincount(code, minlength=n))
    ids = ids[np.argsort(part[ids], kind="stable")]
    ends = _runs(part[ids])
    place = np.empty(n, np.int32)
    place[ids] = np.arange(len(ids)) - np.repeat(ends[:-1], np.diff(ends))
    cells = place[code[np.argsort(part[first], kind="stable")]]
    whose = part[code[sets[:-1]]]
    order = np.argsort(whose, kind="stable")
    own, sizes = _runs(whose[order]), sizes[order]
    out = pa.table({
        "label": (TaskContext.get().partitionId() << 40) + np.arange(len(own) - 1),
        "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(ids))),
        "cells": _zipped(cells, np.add.reduceat(sizes, own[:-1])),
        "sizes": _zipped(sizes.astype(np.int32), np.diff(own)),
        "pairs": np.add.reduceat(sizes * (sizes - 1) // 2, own[:-1]),
    })
    yield from out.to_batches(1 << 12)


def unpacked(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids of ``PACKED`` rows one row after the other, and each set's number and place among them, one set after the other."""
    lists = table.column("ids").combine_chunks()
    before = np.cumsum(lists.value_lengths().to_numpy()) - lists.value_lengths().to_numpy()
    cells, sizes = ([_unzipped(x) for x in table.column(c).to_pylist()] for c in ("cells", "sizes"))
    joined = lambda x: np.concatenate([np.empty(0, np.int32), *x]).astype(np.int64)
    counts, sizes = np.array([len(x) for x in cells], np.int64), joined(sizes)
    return lists.flatten(), np.repeat(np.arange(len(sizes)), sizes), joined(cells) + np.repeat(before, counts)


def _spread(buckets: int):
    def kernel(batches):
        """The ids and the labels that have them, by a hash of the id."""
        for batch in batches:
            lists = batch.column("ids")
            names = lists.flatten()
            label = np.repeat(batch.column("label").to_numpy(), lists.value_lengths().to_numpy())
            hashed = (pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(hashed, kind="stable")
            ends = _runs(hashed[order])
            rows = {"bucket": hashed[order][ends[:-1]], "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(order))), "labels": _pieces(label[order], np.diff(ends))}
            yield from pa.table(rows).to_batches()

    return kernel


def _met(batches):
    """The labels of a task's ids: (label, other) where two have an id in common, or are joined by those that have; and the ids of each, ``label`` and ``other`` being one."""
    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    coded = table.column("ids").combine_chunks().flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    labels, label = np.unique(np.frombuffer(b"".join(table.column("labels").to_pylist()), np.int64), return_inverse=True)
    least = np.full(len(coded.dictionary), len(labels))
    np.minimum.at(least, code, label)
    part = least_members(len(labels), least[code], label)
    apart = np.flatnonzero(part != np.arange(len(labels)))
    own = part[least]
    order = np.argsort(own, kind="stable")
    ends = _runs(own[order])
    mine = labels[own[order][ends[:-1]]]
    none = pa.nulls(len(apart), pa.list_(pa.string()))
    out = {"label": np.concatenate([labels[apart], mine]), "other": np.concatenate([labels[part[apart]], mine]), "ids": pa.concat_arrays([none, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(order)))])}
    yield from pa.table(out).to_batches(1 << 12)


def grouped_components(groups: DataFrame, scratch: Scratch, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((component, label, ids, cells, sizes, pairs), (id, component)) of the nodes that share a group in ``groups`` (grp, id): ``PACKED`` sets of two ids or more, and their nodes.

    A task has whole groups, about ``rows`` rows of them, and finds their components; those of two tasks that have
    an id in common are one; ``label >> 40`` is the task. What is shuffled are packed ids and sets; no pairs are made.

    Tasks have ranges of groups: where groups of near keys have their nodes in common, few tasks know a node, and what
    they send of it doesn't grow with their number.
    """
    kind = dict(groups.dtypes)["grp"]
    numbered = kind in ("tinyint", "smallint", "int", "bigint")
    key = F.col("grp").cast("long") if numbered else F.xxhash64("grp")
    known = groups.where("grp is not null and id is not null").select(key.alias("key"), "grp", "id")
    tasks = max(known.count() // (rows or ROWS), int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4, 1)
    bounds = known.agg(F.percentile_approx("key", [i / tasks for i in range(1, tasks)], max(10_000, 10 * tasks))).first()[0] if tasks > 1 else None
    dealt = known.mapInArrow(_dealt(bounds or [], numbered), "part int, body binary").repartitionById(tasks, F.col("part"))
    packed = scratch.save(dealt.mapInArrow(_packed, PACKED), "packed")
    spread = packed.select("label", "ids").mapInArrow(_spread(16 * tasks), "bucket int, ids array<string>, labels binary")
    met = scratch.save(spread.repartition(tasks, "bucket").mapInArrow(_met, "label long, other long, ids array<string>"), "met")
    same = scratch.save(connected_components(met.where("label <> other").select(F.col("label").alias("u"), F.col("other").alias("v")), scratch).select(F.col("node").alias("label"), F.col("component").alias("root")), "same")
    rooted = packed.select("label", F.array_min("ids").alias("least")).join(same, "label", "left").select("label", F.coalesce("root", "label").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.save(rooted.select("label", "root").join(least, "root").select("label", "component"), "named")
    return packed.join(named, "label"), met.where("label = other").select("label", F.explode("ids").alias("id")).join(named, "label").select("id", "component")


def _jump(trees: DataFrame) -> DataFrame:
    """Every node's parent's parent."""
    return trees.join(trees.select(F.col("id").alias("f"), F.col("f").alias("g")), "f").select("id", F.col("g").alias("f"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Map every end point of ``edges`` (columns u, v of one ordered type) to the smallest of its component.

    Returns (node, component). Self loops make a node known; null ends are ignored.
    """
    known = edges.where("u is not null and v is not null").select("u", "v")
    loops = known.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("f")).distinct()
    pairs = known.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    found = None
    while True:
        pairs, (left,) = scratch.save_seen(pairs, "pairs", F.count(F.lit(1)))
        if not left:
            break
        if left <= ONE_TASK and {t for _, t in pairs.dtypes} <= {"string", "bigint", "int"}:
            trees = pairs.coalesce(1).mapInArrow(_joined, ", ".join(f"{c} {t}" for c, (_, t) in zip(("id", "f"), pairs.dtypes)))
            root = trees.select(F.col("id").alias("f"), F.col("f").alias("r"))
            found = trees if found is None else found.join(root, "f", "left").select("id", F.coalesce("r", "f").alias("f"))
            break
        ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("o")), F.struct(F.col("b").alias("id"), F.col("a").alias("o")))).alias("e")
        hooked = pairs.select(ends).groupBy("e.id").agg(F.min("e.o").alias("o")).select("id", F.least("id", "o").alias("f"))
        trees = fixpoint(scratch, hooked, _jump, checksum("id", "f"))
        root = trees.select(F.col("id").alias("f"), F.col("f").alias("r"))
        # what pointed to a node that is no root any more points to that node's root
        found = trees if found is None else scratch.save(found.join(root, "f", "left").select("id", F.coalesce("r", "f").alias("f")), "found")
        over = pairs.join(trees.select(F.col("id").alias("a"), F.col("f").alias("x")), "a").join(trees.select(F.col("id").alias("b"), F.col("f").alias("y")), "b")
        pairs = over.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if found is None:
        found = loops
    else:
        found = found.unionByName(loops.join(found.select("id"), "id", "left_anti"))
    return found.select(F.col("id").alias("node"), F.col("f").alias("component"))
