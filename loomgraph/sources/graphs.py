"""GraphML elements, and plain forms of graphs: edge lists, DOT, Mermaid.

Files are read by Spark's own readers, so any file system that Spark reads serves, in pieces that all
tasks read, and parsed on the executors by a streaming parser: one task a document, which holds none of it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import IO
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


#: What ends most pieces of markup, so that no document is one row; pieces that are sent together, and elements in a batch.
END, TOGETHER, BATCH = b">", 128, 4096


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, n, size, part): the files' bytes in pieces, to be joined by END in the order of start and n."""
    file = lambda c: F.col(f"_metadata.file_{c}")
    if spark.read.format("binaryFile").load(path).where("length = 0").select("path").limit(1).count():
        raise ValueError("a document is empty")
    rows = spark.read.option("lineSep", END.decode()).text(path).select(file("path").alias("path"), file("block_start").alias("start"), file("size").alias("size"), F.col("value").cast("binary").alias("part"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            names, start, size, parts = (batch.column(c) for c in ("path", "start", "size", "part"))
            at = start.to_numpy()
            of = names.dictionary_encode().indices.to_numpy()
            # a task may read parts of several files, one after the other
            new = np.flatnonzero((at[1:] != at[:-1]) | (of[1:] != of[:-1])) + 1
            bounds = np.unique(np.concatenate([np.arange(0, len(at), TOGETHER), new, [len(at)]])).tolist()
            first, parts = pa.array(bounds[:-1], pa.int64()), parts.to_pylist()
            text = [END.join(parts[i:j]) for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([names.take(first), start.take(first), pa.array(range(n, n + len(text)), pa.int64()), size.take(first), pa.array(text, pa.binary())], names=["path", "start", "n", "size", "part"])
            n += len(text)

    return rows.mapInArrow(joined, "path string, start long, n long, size long, part binary")


def _tag(name: str) -> str:
    return name.rsplit("}", 1)[-1]


ELEMENT = "element string, seq long, xml_id string, source string, target string, attrs map<string,string>"


def _parser(start, end=None, text=None):
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    return p


def _declared(graph_id: str, file: IO[bytes]) -> dict[tuple[str, str | None], str | None]:
    """The names of a document's keys by (what they are for, id), wherever they stand; there must be one graph."""
    keys, graphs = {}, 0

    def start(name: str, a: dict[str, str]) -> None:
        nonlocal graphs
        tag = _tag(name)
        graphs += tag == "graph"
        if tag == "key":
            keys[a.get("for") or "all", a.get("id")] = a.get("attr.name") or a.get("id")

    _parser(start).ParseFile(file)
    if graphs != 1:
        raise ValueError(f"a document must have one graph; {graph_id} has {graphs}")
    return keys


def _elements(graph_id: str, file: IO[bytes]) -> Iterator[tuple]:
    """The elements of a document as they are read: the keys first, then nodes and edges, in steps of the file."""
    keys = _declared(graph_id, file)
    known = {i for _, i in keys}
    depth, top, seq = 0, -1, -1  # top: the graph's depth
    found, item, data = [], None, None  # data: the key, the text so far, and whether it goes on

    def start(name: str, a: dict[str, str]) -> None:
        nonlocal depth, top, seq, item, data
        depth += 1
        tag = _tag(name)
        if tag == "graph":
            top = depth
        elif top > 0 and depth == top + 1:
            seq += 1
            item = (tag, seq, a.get("id") or "", a.get("source"), a.get("target"), {}) if tag in ("node", "edge") else None
        elif item and depth == top + 2:
            data = [a.get("key"), [], True] if tag == "data" else None
        elif data:
            data[2] = False

    def end(_: str) -> None:
        nonlocal depth, top, item, data
        if item and data and depth == top + 2:
            key, text, _ = data
            name = keys.get((item[0], key)) or keys.get(("all", key))
            if name is None and key not in known:
                name = key
            if name is not None:
                item[5][name] = "".join(text).strip()
            data = None
        elif item and depth == top + 1:
            found.append(item)
            item = None
        elif depth == top:
            top = -1
        depth -= 1

    def text(x: str) -> None:
        if data and data[2]:
            data[1].append(x)

    p = _parser(start, end, text)
    file.seek(0)
    while step := file.read(1 << 18):
        p.Parse(step)
        yield from found
        found.clear()
    p.Parse(b"", True)


def element_rows(spark: SparkSession, path: str) -> DataFrame:
    """The nodes and edges of GraphML documents: element, seq, xml_id, source, target, attrs.

    A document's pieces are sorted and spooled to a file of the task that parses it, twice as keys may
    stand anywhere; what a task holds in memory is a step of it.
    """
    kinds = [("element", pa.string()), ("seq", pa.int64()), ("xml_id", pa.string()), ("source", pa.string()), ("target", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]

    def told(name: str, file: IO[bytes], size: int, last: bytes) -> Iterator[pa.RecordBatch]:
        if last.strip() and file.tell() < size:
            file.write(END)  # of the last piece; what follows it can be white space only
        file.seek(0)
        rows = []
        for row in _elements(_stem(name), file):
            rows.append((*row[:5], list(row[5].items())))
            if len(rows) == BATCH:
                yield batch(rows)
                rows = []
        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, size, last = None, None, 0, b""
        for b in batches:
            for own, of, part in zip(b.column("path").to_pylist(), b.column("size").to_pylist(), b.column("part").to_pylist()):
                if own != name:
                    if file:
                        yield from told(name, file, size, last)
                        file.close()
                    file, name, size = tempfile.TemporaryFile(), own, of
                else:
                    file.write(END)
                file.write(part)
                last = part.rpartition(END)[2]
        if file:
            yield from told(name, file, size, last)
            file.close()

    return _pieces(spark, path).repartition("path").sortWithinPartitions("path", "start", "n").select("path", "size", "part").mapInArrow(parsed, ELEMENT)


def to_edge_list(g: Graph) -> DataFrame:
    return g.edges.select(F.concat_ws("\t", "src", "dst", "kind").alias("value"))


def to_dot(g: Graph) -> DataFrame:
    """A line of DOT for each node and edge."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
    nodes = g.nodes.select(F.concat(F.lit("  "), q("id"), F.lit(" [label="), q("name"), F.lit("];")).alias("value"))
    edges = g.edges.select(F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(" [label="), q("kind"), F.lit("];")).alias("value"))
    return nodes.unionByName(edges)


def to_mermaid(g: Graph) -> DataFrame:
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    return g.edges.select(F.concat(F.lit("  "), clean("src"), F.lit(" -->|"), "kind", F.lit("| "), clean("dst")).alias("value")).distinct()
