"""Graphs as documents and folders: lossless JSON and GraphML, a store of variants, envelopes, diagrams, reports.

Two forms. A folder of JSON lines is written and read by all tasks and is the one for large graphs.
A single document, which other programs read, is a header, a line for each node and edge, and a
footer; its lines are sorted by ranges and then written by one task that streams them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import edge_layer, first_of, node_layer, xml_escape
from loomgraph.graph import Graph
from loomgraph.plans.scratch import Scratch

JSON_VERSION = 1
NODE_JSON = "struct<id:string,kind:string,name:string,qname:string,pos:struct<File:string,Line:int,Col:int>,attrs:map<string,string>>"
EDGE_JSON = "struct<from:string,to:string,kind:string,attrs:map<string,string>>"


def no_attrs() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def with_defaults(g: Graph) -> Graph:
    """A graph with all columns of a document: name, qname, file, line and col of nodes, attrs of both, seq of both."""

    def filled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        return df.select(*(F.coalesce(F.col(c), d).alias(c) if c in df.columns else d.alias(c) for c, d in columns.items()))

    text, zero = F.lit(""), F.lit(0)
    nodes = filled(g.nodes, {"id": text, "kind": text, "name": text, "qname": text, "file": text, "line": zero, "col": zero, "attrs": no_attrs()})
    edges = filled(g.edges, {"src": text, "dst": text, "kind": text, "attrs": no_attrs(), "seq": zero.cast("long")})
    return Graph(nodes, edges)


def _lines(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(place, id, text) of nodes and edges as JSON objects; what is empty is left out, as readers expect."""
    g = with_defaults(g)
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    attrs = F.when(F.size("attrs") > 0, F.col("attrs")).alias("attrs")
    pos = F.when((F.col("file") != "") | (F.col("line") > 0), F.struct(F.col("file").alias("File"), F.col("line").alias("Line"), F.col("col").alias("Col"))).alias("pos")
    node = F.to_json(F.struct("id", "kind", some("name").alias("name"), some("qname").alias("qname"), pos, attrs))
    edge = F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", attrs))
    nodes = g.nodes.select(F.lit(1).alias("place"), F.struct("id", F.lit("").alias("b"), F.lit("").alias("c"), F.lit(0).cast("long").alias("s")).alias("key"), node.alias("text"))
    edges = g.edges.select(F.lit(3).alias("place"), F.struct(F.col("src").alias("id"), F.col("dst").alias("b"), F.col("kind").alias("c"), F.col("seq").alias("s")).alias("key"), edge.alias("text"))
    return nodes, edges


def write_lines(g: Graph, path: str) -> None:
    """A folder with nodes/ and edges/ as JSON lines, written by all tasks."""
    for rows, name in zip(_lines(g), ("nodes", "edges")):
        rows.select(F.col("text").alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def read_lines(spark: SparkSession, path: str) -> Graph:
    text = lambda name, schema: spark.read.text(f"{path}/{name}").select(F.from_json("value", schema).alias("x"))
    return Graph(_nodes(text("nodes", NODE_JSON)), _edges(text("edges", EDGE_JSON)))


def _nodes(rows: DataFrame) -> DataFrame:
    x = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(""))
    pos = [F.coalesce("x.pos.File", F.lit("")).alias("file"), F.coalesce("x.pos.Line", F.lit(0)).alias("line"), F.coalesce("x.pos.Col", F.lit(0)).alias("col")]
    return rows.select(x("id").alias("id"), x("kind").alias("kind"), x("name").alias("name"), x("qname").alias("qname"), *pos, F.coalesce("x.attrs", no_attrs()).alias("attrs"))


def _edges(rows: DataFrame) -> DataFrame:
    x = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(""))
    return rows.select(x("from").alias("src"), x("to").alias("dst"), x("kind").alias("kind"), F.coalesce("x.attrs", no_attrs()).alias("attrs"))


def _document(spark: SparkSession, parts: list[DataFrame], frame: list[tuple[int, str]], path: str, separator: str = "") -> None:
    """Write rows (place, key, text) with the frame's lines at their places; ``separator`` ends all lines of a part but its last."""
    kind = parts[0].schema["key"].dataType
    out = spark.createDataFrame(frame, "place int, text string").select("place", F.lit(None).cast(kind).alias("key"), "text")
    for p in parts:
        if separator:
            # equal rows become one line, so that one line is the last
            same = p.groupBy("place", "key", "text").agg(F.count("*").cast("int").alias("n"))
            p = same.select("place", "key", F.array_join(F.array_repeat("text", F.col("n")), separator + "\n").alias("text"))
            row = F.struct("key", "text")
            p = p.crossJoin(F.broadcast(p.agg(F.max(row).alias("last")))).select("place", "key", F.concat("text", F.when(row == F.col("last"), "").otherwise(separator)).alias("text"))
        out = out.unionByName(p)
    out.orderBy("place", "key", "text").select(F.col("text").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json(g: Graph, path: str) -> None:
    """One JSON document {version, nodes, edges}, nodes by id and edges by ends, nothing left out."""
    nodes, edges = _lines(g)
    spark = g.nodes.sparkSession
    _document(spark, [nodes, edges], [(0, f'{{"version": {JSON_VERSION}, "nodes": ['), (2, '], "edges": ['), (4, "]}")], path, ",")


def read_json(spark: SparkSession, path: str, foreign: bool = True, granularity: str = "symbol") -> Graph:
    """A JSON document by Spark's own reader; documents of another version are refused.

    ``foreign=False`` drops nodes whose attribute foreign is true, and their edges. ``granularity``
    "package" gives packages by qualified name and their distinct dependencies.
    """
    doc = spark.read.schema(f"version int, nodes array<{NODE_JSON}>, edges array<{EDGE_JSON}>").option("multiLine", True).json(path)
    wrong = doc.where(F.coalesce("version", F.lit(JSON_VERSION)) != JSON_VERSION).limit(1).count()
    if wrong:
        raise ValueError("a graph document is of an unknown version")
    g = Graph(_nodes(doc.select(F.explode("nodes").alias("x"))), _edges(doc.select(F.explode("edges").alias("x"))))
    if not foreign:
        g = g.without_foreign(F.coalesce(F.try_element_at("attrs", F.lit("foreign")), F.lit("")) == "true")
    return package_graph(g) if granularity == "package" else g


def package_graph(g: Graph) -> Graph:
    """Packages, named by qname or else id, and their distinct dependsOn edges without self edges."""
    key = F.coalesce(F.nullif(F.col("qname"), F.lit("")), F.col("id")) if "qname" in g.nodes.columns else F.col("id")
    own = g.nodes.where("kind = 'package'").select("id", key.alias("key"))
    e = g.edges.where("kind = 'dependsOn'").join(own.select(F.col("id").alias("src"), F.col("key").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("key").alias("b")), "dst")
    edges = e.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("dependsOn").alias("kind")).distinct()
    return Graph(own.select(F.col("key").alias("id"), F.lit("package").alias("kind"), F.col("key").alias("name")).distinct(), edges)


# --- GraphML ----------------------------------------------------------------------------------

#: Which attribute names an element, in the order of preference, by flavour.
FLAVOURS = {
    "generic": {"id": ("archmotif_id", "id"), "label": ("label", "name", "id"), "kind": ("kind", "label")},
    "shape": {"id": ("id", "archmotif_id"), "label": ("memory_title", "label", "name", "id"), "kind": ("predicate", "kind", "label", "relation")},
}


def write_graphml(g: Graph, path: str) -> None:
    """One GraphML document: kind, name, qname, file, line, layer of nodes, kind and layer of edges, and all attributes.

    Keys are declared for the columns and for each attribute name; a name that both have gets the
    prefix ``e_`` for edges.
    """
    g = with_defaults(g)
    spark = g.nodes.sparkSession
    data = lambda key, value: F.concat(F.lit('<data key="'), key, F.lit('">'), xml_escape(value), F.lit("</data>"))
    more = lambda prefix: F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: data(F.concat(F.lit(prefix), xml_escape(e["key"])), e["value"])), "")
    quoted = lambda c: F.concat(F.lit('"'), xml_escape(F.col(c)), F.lit('"'))
    columns = {"kind": F.col("kind"), "name": F.col("name"), "qname": F.col("qname"), "file": F.col("file"), "line": F.col("line").cast("string"), "layer": node_layer(F.col("kind"))}
    own = F.concat(*(data(F.lit(f"d_{n}"), c) for n, c in columns.items()))
    node = F.concat(F.lit("<node id="), quoted("id"), F.lit(">"), own, more("n_"), F.lit("</node>"))
    mine = F.concat(data(F.lit("d_ekind"), F.col("kind")), data(F.lit("d_elayer"), edge_layer(F.col("kind"))))
    edge = F.concat(F.lit("<edge source="), quoted("src"), F.lit(" target="), quoted("dst"), F.lit(">"), mine, more("e_"), F.lit("</edge>"))
    key = F.struct("id", F.lit("").alias("b"), F.lit("").alias("c"), F.lit(0).cast("long").alias("s")).alias("key")
    nodes = g.nodes.select(F.lit(3).alias("place"), key, node.alias("text"))
    edges = g.edges.select(F.lit(4).alias("place"), F.struct(F.col("src").alias("id"), F.col("dst").alias("b"), F.col("kind").alias("c"), F.col("seq").alias("s")).alias("key"), edge.alias("text"))
    declare = lambda df, of, prefix: df.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().select(
        F.lit(1).alias("place"), F.struct(F.col("k").alias("id"), F.lit(of).alias("b"), F.lit("").alias("c"), F.lit(0).cast("long").alias("s")).alias("key"),
        F.concat(F.lit('<key id="' + prefix), xml_escape(F.col("k")), F.lit(f'" for="{of}" attr.type="string" attr.name="'), xml_escape(F.col("k")), F.lit('"/>')).alias("text"),
    )
    fixed = "".join(f'<key id="d_{n}" for="node" attr.name="{n}" attr.type="{"int" if n == "line" else "string"}"/>' for n in columns)
    fixed += "".join(f'<key id="d_e{n}" for="edge" attr.name="{n}" attr.type="string"/>' for n in ("kind", "layer"))
    frame = [(0, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + fixed), (2, '<graph edgedefault="directed">'), (5, "</graph></graphml>")]
    _document(spark, [declare(g.nodes, "node", "n_"), declare(g.edges, "edge", "e_"), nodes, edges], frame, path)


def read_graphml(spark: SparkSession, path: str, flavour: str = "generic") -> Graph:
    """GraphML documents, read in pieces and parsed on the executors by a streaming parser, one task a document.

    Attributes are trimmed and stand under their declared names, undeclared keys under their own;
    a key that is declared for the other kind of element doesn't count. Ids, labels and kinds follow
    the flavour's preference. Duplicate ids and edges to no node are errors, as are two graphs in one
    document.
    """
    from loomgraph.sources.graphs import element_rows

    rows = Scratch(spark).save(element_rows(spark, path), "elements")  # read many times, parsed once
    names = FLAVOURS[flavour]
    nodes = rows.where("element = 'node'").select("seq", F.coalesce(F.nullif(first_of(F.col("attrs"), *names["id"]), F.lit("")), "xml_id").alias("id"), "attrs", F.col("xml_id"))
    nodes = nodes.select(
        "seq", "id", first_of(F.col("attrs"), "kind", "type", "entityType").alias("kind"), F.coalesce(F.nullif(first_of(F.col("attrs"), *names["label"]), F.lit("")), F.col("id")).alias("name"),
        first_of(F.col("attrs"), "qname").alias("qname"), first_of(F.col("attrs"), "file").alias("file"), F.coalesce(first_of(F.col("attrs"), "line").try_cast("int"), F.lit(0)).alias("line"), "attrs", "xml_id",
    )
    ends = nodes.select("xml_id", "id")
    edges = rows.where("element = 'edge'").select("seq", F.col("source").alias("s"), F.col("target").alias("t"), first_of(F.col("attrs"), *names["kind"]).alias("kind"), "attrs")
    edges = edges.join(ends.select(F.col("xml_id").alias("s"), F.col("id").alias("src")), "s", "left").join(ends.select(F.col("xml_id").alias("t"), F.col("id").alias("dst")), "t", "left")
    wrong = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.concat(F.lit("duplicate id "), "id").alias("w"))
    wrong = wrong.unionByName(edges.where("src is null or dst is null").select(F.concat_ws(" ", F.lit("dangling edge"), "s", "t").alias("w"))).limit(1).collect()
    if wrong:
        raise ValueError(wrong[0]["w"])
    return Graph(nodes.drop("xml_id"), edges.select("seq", "src", "dst", "kind", "attrs"))


# --- diagrams and reports ---------------------------------------------------------------------


def d2_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, key, text): a D2 diagram with a container for each cluster; ``nodes`` (id, label, cluster), ``edges`` (src, dst, label)."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    at = F.when(F.col("cluster") != "", F.concat(q("cluster"), F.lit("."), q("id"))).otherwise(q("id"))
    where = nodes.select("id", at.alias("at"))
    boxes = nodes.select(F.lit(0).alias("place"), F.col("id").alias("key"), F.concat(at, F.lit(": "), q("label")).alias("text"))
    e = edges.join(where.select(F.col("id").alias("src"), F.col("at").alias("a")), "src").join(where.select(F.col("id").alias("dst"), F.col("at").alias("b")), "dst")
    arrows = e.select(F.lit(1).alias("place"), F.concat_ws(" ", "src", "dst", "label").alias("key"), F.concat("a", F.lit(" -> "), "b", F.when(F.col("label") != "", F.concat(F.lit(": "), q("label"))).otherwise("")).alias("text"))
    return boxes.unionByName(arrows)


def markdown_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(place, text): a Markdown table's head, rule and rows; pipes in values are escaped."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "place int, text string")
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return head.unionByName(rows.select(F.lit(2).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |")).alias("text")))


def write_records(records: DataFrame, path: str, version: int = 1) -> None:
    """One document {version, records} of metric, anomaly, drift or coupling rows."""
    rows = records.select(F.lit(1).alias("place"), F.struct(F.to_json(F.struct("*")).alias("id")).alias("key"), F.to_json(F.struct("*")).alias("text"))
    _document(records.sparkSession, [rows], [(0, f'{{"version": {version}, "records": ['), (2, "]}")], path, ",")


def read_records(spark: SparkSession, path: str, fields: str, version: int = 1) -> DataFrame:
    """The records of a document of the given version; another version is refused."""
    doc = spark.read.schema(f"version int, records array<struct<{fields}>>").option("multiLine", True).json(path)
    if doc.where(F.coalesce("version", F.lit(-1)) != version).limit(1).count():
        raise ValueError("a document of records is of an unknown version")
    return doc.select(F.explode("records").alias("r")).select("r.*")


# --- a store of variants ----------------------------------------------------------------------


class Store:
    """Graph variants and logs in one folder: Parquet partitioned by variant, replaced as a whole by each save.

    A save writes a new folder of the variant and then one row of the catalogue's log that names it, so a
    reader sees the old variant or the new one, never a part; a lost writer leaves an unnamed folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, path: str) -> bool:
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(sc._jsc.hadoopConfiguration()).exists(target)

    def _log(self) -> DataFrame | None:
        if not self._there(f"{self.root}/log"):
            return None
        return self.spark.read.schema("variant string, folder string, at long, gone boolean").json(f"{self.root}/log")

    def _named(self) -> DataFrame | None:
        log = self._log()
        if log is None:
            return None
        return log.groupBy("variant").agg(F.max(F.struct("at", "folder", "gone")).alias("x")).where("not x.gone").select("variant", "x.folder", "x.at")

    def save(self, variant: str, g: Graph, gone: bool = False) -> None:
        import time
        import uuid

        folder = f"{self.root}/graphs/{uuid.uuid4().hex}"
        g = with_defaults(g)
        g.nodes.write.parquet(f"{folder}/nodes")
        g.edges.write.parquet(f"{folder}/edges")
        row = self.spark.createDataFrame([(variant, folder, time.time_ns(), gone)], "variant string, folder string, at long, gone boolean")
        row.coalesce(1).write.mode("append").json(f"{self.root}/log")

    def load(self, variant: str) -> Graph:
        named = self._named()
        rows = named.where(F.col("variant") == variant).collect() if named is not None else []
        if not rows:
            raise KeyError(variant)
        return Graph(self.spark.read.parquet(f"{rows[0]['folder']}/nodes"), self.spark.read.parquet(f"{rows[0]['folder']}/edges"))

    def list(self, prefix: str = "") -> list[str]:
        named = self._named()
        return [] if named is None else [r["variant"] for r in named.where(F.col("variant").startswith(prefix)).orderBy("variant").collect()]

    def checkout(self, variant: str) -> DataFrame:
        """variant, nodes and edges of one variant."""
        g = self.load(variant)
        counts = g.nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(g.edges.agg(F.count("*").alias("edges"))))
        return counts.select(F.lit(variant).alias("variant"), "nodes", "edges")

    def fork(self, source: str, target: str, force: bool = False) -> None:
        if target in self.list() and not force:
            raise ValueError(f"{target} exists")
        self.save(target, self.load(source))

    def append(self, log: str, rows: DataFrame) -> None:
        """Add rows to a log of JSON lines, such as that of mutations."""
        rows.write.mode("append").json(f"{self.root}/{log}")

    def cached(self, variant: str, name: str, compute) -> tuple[DataFrame, bool]:
        """A result by the variant's content and a name: (rows, whether it was there). ``compute`` (graph) gives it."""
        g = self.load(variant)
        path = f"{self.root}/cache/{content_key(g)}/{name}"
        if self._there(f"{path}/_SUCCESS"):
            return self.spark.read.parquet(path), True
        compute(g).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), False


def content_key(g: Graph) -> str:
    """A digest of a graph's rows that doesn't depend on their order: sums of row hashes and counts."""
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*(F.to_json(F.struct(c)) if str(df.schema[c].dataType).startswith("Map") else F.col(c) for c in df.columns)).cast("decimal(38,0)"))).first()
    import hashlib

    return hashlib.sha256(repr((tuple(total(g.nodes)), tuple(total(g.edges)))).encode()).hexdigest()[:16]
