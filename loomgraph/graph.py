"""The graph model: a typed directed multigraph as two DataFrames.

``nodes``: id, kind, name, grp (the attribute that partitions it) and role, plus any attributes.
``edges``: src, dst, kind and seq, the order of insertion. Missing attributes are ``''``, never
null, so that a join on an attribute loses no row. A graph whose pairs are those of nodes in one
group may have ``groups`` (grp, id), which are fewer rows than their pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of nodes and edges, and those of edges that stand for a dependency.
DEPENDENCY_KINDS = ("calls", "callsFrom", "dependsOn", "usesType", "returns", "references")
NODE_KINDS = ("package", "file", "type", "function", "method", "field", "loop", "branch", "goroutine", "defer", "channelop", "syncprim")
EDGE_KINDS = ("contains", "implements", "embeds", "calls", "callsFrom", "references", "dependsOn", "returns", "usesType")
# Spellings of the hierarchy relation in generic graphs.
HIERARCHY_KINDS = ("contains", "Contains", "CONTAINS", "part-of", "part_of", "partOf", "PartOf", "parent", "child", "parent_of", "parentOf", "has", "owns")


def attr(column: str | Column) -> Column:
    """An attribute with the model's value for a missing one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    groups: DataFrame | None = None

    def typed(self) -> Graph:
        """The typed view: the first node wins on id, the first edge on (src, dst, kind)."""
        return replace(self, nodes=first_by(self.nodes, ["id"], ["seq"] if "seq" in self.nodes.columns else ["kind", "name"]), edges=first_by(self.edges, ["src", "dst", "kind"], ["seq"]))

    def dangling(self) -> DataFrame:
        """Edges with an end that is no node."""
        ids = self.nodes.select("id").distinct()
        ends = self.edges.join(ids.withColumn("_s", F.lit(1)).withColumnRenamed("id", "src"), "src", "left").join(ids.withColumn("_d", F.lit(1)).withColumnRenamed("id", "dst"), "dst", "left")
        return ends.where("_s is null or _d is null").select(*self.edges.columns)

    def of_kind(self, *kinds: str) -> Graph:
        return Graph(self.nodes, self.edges.where(F.col("kind").isin(*kinds)))

    def directed(self, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """Distinct (src, dst) without self edges."""
        edges = self.edges if kinds is None else self.edges.where(F.col("kind").isin(*kinds))
        return edges.where("src <> dst").select("src", "dst").distinct()

    def undirected(self, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """Distinct unordered pairs (a, b), a < b, without self edges."""
        edges = self.edges if kinds is None else self.edges.where(F.col("kind").isin(*kinds))
        return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def neighbours(self, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """The undirected projection in both directions: (id, other)."""
        pairs = self.undirected(kinds)
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))

    def induced(self, ids: DataFrame) -> Graph:
        """The nodes in ``ids`` (column id) and the edges with both ends in it."""
        return Graph(self.nodes.join(ids, "id", "left_semi"), inside(self.edges, ids))

    def without_foreign(self, foreign: Column) -> Graph:
        """Without the nodes for which ``foreign`` holds, and without their edges."""
        return self.induced(self.nodes.where(~foreign).select("id"))


def inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (column id)."""
    ends = ids.select(F.col("id").alias("_id"))
    return edges.join(ends, F.col("src") == F.col("_id"), "left_semi").join(ends, F.col("dst") == F.col("_id"), "left_semi")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; an aggregation, so partial firsts are taken before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in others if c not in order))).alias("_first"))
    return best.select(*keys, *(F.col(f"_first.{c}") for c in others)).select(*rows.columns)
