"""Matrix validators over a graph: adjacency, an encoder, an operation, an interpreter, as sparse tables of (i, j, value).

A matrix is a table of its entries that aren't 0, by node number. Numbers follow the order of ids, so
reports agree between runs; they come from a sort by ranges and the sizes of its partitions, and no
row passes through one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import findings, patterns, records
from loomgraph.plans.scratch import Scratch


def numbered(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n): ids in ascending order numbered from 0."""
    placed = scratch.save(nodes.select("id").distinct().orderBy("id").withColumn("m", F.monotonically_increasing_id()), "sorted")
    part, row = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.select("id", part.alias("p"), row.alias("r"))
    sizes = dict(placed.groupBy("p").agg(F.count("*")).collect())  # one row for each partition of the sort
    start, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(F.lit(start).cast("long"))
        start += sizes.get(p, 0)
    return placed.select("id", (F.get(F.array(*starts), F.col("p").cast("int")) + F.col("r")).alias("n")) if starts else placed.select("id", F.col("r").alias("n"))


def adjacency(g: Graph, numbers: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(i, j, value 1) of the simple directed graph."""
    a = g.directed(kinds).join(numbers.select(F.col("id").alias("src"), F.col("n").alias("i")), "src")
    return a.join(numbers.select(F.col("id").alias("dst"), F.col("n").alias("j")), "dst").select("i", "j", F.lit(1.0).alias("value"))


def one_hot(g: Graph, numbers: DataFrame, column: str) -> DataFrame:
    """(i, layer, value 1): which layer each node is of; nodes without one have no row."""
    return g.nodes.where(F.coalesce(F.col(column), F.lit("")) != "").join(numbers, "id").select(F.col("n").alias("i"), F.col(column).alias("layer"), F.lit(1.0).alias("value"))


def rule_mask(layers: DataFrame, rules: DataFrame) -> DataFrame:
    """(from_layer, to_layer) pairs that are forbidden, among the layers that there are."""
    known = layers.select("layer").distinct()
    return rules.join(known.withColumnRenamed("layer", "from_group"), "from_group", "left_semi").join(known.withColumnRenamed("layer", "to_group"), "to_group", "left_semi")


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum("value").alias("value"))


def column_sums(a: DataFrame) -> DataFrame:
    return a.groupBy(F.col("j").alias("i")).agg(F.sum("value").alias("value"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, value) of a matrix product."""
    right = b.select(F.col("i").alias("k"), F.col("j"), F.col("value").alias("w"))
    return a.select("i", F.col("j").alias("k"), "value").join(right, "k").groupBy("i", "j").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def collapse(a: DataFrame, layers: DataFrame) -> DataFrame:
    """(from_layer, to_layer, value): the layers' transpose times the adjacency times the layers."""
    rows = a.join(layers.select("i", F.col("layer").alias("from_layer")), "i").join(layers.select(F.col("i").alias("j"), F.col("layer").alias("to_layer")), "j")
    return rows.groupBy("from_layer", "to_layer").agg(F.sum("value").alias("value"))


def masked(a: DataFrame, layers: DataFrame, mask: DataFrame) -> DataFrame:
    """(i, j, value) of the entries whose layers the mask forbids: the entrywise product."""
    rows = a.join(layers.select("i", F.col("layer").alias("from_group")), "i").join(layers.select(F.col("i").alias("j"), F.col("layer").alias("to_group")), "j")
    return rows.join(mask, ["from_group", "to_group"], "left_semi").select("i", "j", "value")


@dataclass(frozen=True)
class Validator:
    """A named chain: ``encode`` (graph, numbers, scratch), ``operate`` (adjacency, encoded), ``interpret`` (result, numbers) to records."""

    name: str
    encode: Callable[[Graph, DataFrame, Scratch], object]
    operate: Callable[[DataFrame, object], DataFrame]
    interpret: Callable[[DataFrame, DataFrame], DataFrame]

    def run(self, g: Graph, scratch: Scratch) -> DataFrame:
        numbers = scratch.save(numbered(g.nodes, scratch), "numbers")
        a = scratch.save(adjacency(g, numbers), "adjacency")
        out = self.operate(a, self.encode(g, numbers, scratch))
        return self.interpret(out, numbers).select(F.lit(self.name).alias("metric"), "scope", "target", F.col("value").cast("double").alias("value"))


def _nodes(out: DataFrame, numbers: DataFrame) -> DataFrame:
    return out.join(numbers.select("id", F.col("n").alias("i")), "i").select(F.lit("node").alias("scope"), F.col("id").alias("target"), "value")


def _pairs(out: DataFrame, numbers: DataFrame) -> DataFrame:
    named = out.join(numbers.select(F.col("id").alias("a"), F.col("n").alias("i")), "i").join(numbers.select(F.col("id").alias("b"), F.col("n").alias("j")), "j")
    each = named.select(F.lit("edge").alias("scope"), F.concat("a", F.lit("→"), "b").alias("target"), "value")
    return each.unionByName(out.agg(F.lit("graph").alias("scope"), F.lit("").alias("target"), F.count("*").cast("double").alias("value")))


def layer_validator(column: str, rules: DataFrame) -> Validator:
    def encode(g: Graph, numbers: DataFrame, scratch: Scratch):
        layers = scratch.save(one_hot(g, numbers, column), "layers")
        return layers, rule_mask(layers, rules)

    return Validator("layer_mask", encode, lambda a, e: masked(a, *e), _pairs)


FAN_OUT = Validator("fan_out", lambda g, n, s: None, lambda a, _: row_sums(a), _nodes)
FAN_IN = Validator("fan_in", lambda g, n, s: None, lambda a, _: column_sums(a), _nodes)
TWO_STEPS = Validator("two_steps", lambda g, n, s: None, lambda a, _: product(a, a), _pairs)


def facade(g: Graph, scratch: Scratch) -> DataFrame:
    """(part, name, value): modularity, repeated motifs and anomalies of a graph in one small report."""
    told = scratch.save(records.run_metrics(g, scratch, ["modularity", "cycle_rank", "components"]), "records")
    whole = told.where("scope = 'graph'").select(F.lit("metric").alias("part"), F.col("metric").alias("name"), "value")
    motifs = patterns.motif_groups(patterns.Threes(g, scratch).counts(), counted=True).agg(F.lit("motif").alias("part"), F.lit("repeated groups").alias("name"), F.count("*").cast("double").alias("value"))
    odd = findings.detect(told, ["cycle_rank"]).groupBy("detector").agg(F.count("*").cast("double").alias("value")).select(F.lit("anomaly").alias("part"), F.col("detector").alias("name"), "value")
    return whole.unionByName(motifs).unionByName(odd)


# --- building ---------------------------------------------------------------------------------

# Which kinds may contain which.
PARENTS = {"file": ("package",), "type": ("package", "file"), "function": ("package", "file"), "method": ("type",), "field": ("type",)}


class GraphBuilder:
    """A graph put together call by call, for graphs that a program makes up; ``build`` checks it."""

    def __init__(self):
        self.nodes: list[tuple[str, str, str, str, str]] = []
        self.edges: list[tuple[str, str, str, int]] = []

    def add(self, kind: str, id: str, parent: str = "", name: str = "", layer: str = "", group: str = "") -> GraphBuilder:
        """A package, file, type, function, method or field; all but packages may have a parent that contains them."""
        self.nodes.append((id, kind, name or id, group, layer))
        return self.link("contains", parent, id) if parent else self

    def link(self, kind: str, src: str, dst: str) -> GraphBuilder:
        self.edges.append((src, dst, kind, len(self.edges)))
        return self

    def build(self, spark) -> Graph:
        g = Graph(spark.createDataFrame(self.nodes, "id string, kind string, name string, grp string, role string"), spark.createDataFrame(self.edges, "src string, dst string, kind string, seq long"))
        if wrong := invalid(g).limit(1).collect():
            raise ValueError(f"{wrong[0]['fault']}: {wrong[0]['item']}")
        return g


def invalid(g: Graph) -> DataFrame:
    """(item, fault): repeated ids, edges to no node, and containers of a kind that can't hold the node."""
    twice = g.nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("item"), F.lit("repeated id").alias("fault"))
    lost = g.dangling().select(F.concat_ws(" ", "src", "kind", "dst").alias("item"), F.lit("edge to no node").alias("fault"))
    kinds = g.nodes.groupBy("id").agg(F.min("kind").alias("k"))
    held = g.edges.where("kind = 'contains'").join(kinds.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
    may = F.lit(False)
    for child, parents in PARENTS.items():
        may = may | ((F.col("b") == child) & F.col("a").isin(*parents))
    wrong = held.where(~may).select(F.concat_ws(" ", "src", "kind", "dst").alias("item"), F.concat(F.lit("a "), "a", F.lit(" can't contain a "), "b").alias("fault"))
    return twice.unionByName(lost).unionByName(wrong)
