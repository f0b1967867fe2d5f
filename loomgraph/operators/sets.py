"""Set operations between graph variants, and rule checks: diff, merge, drift, policy, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.degrees import quotient, with_groups


def diff(before: Graph, after: Graph, compared: tuple[str, ...] = ("kind", "name", "grp")) -> DataFrame:
    """What changed: item (node or edge), key, change (added, removed or changed)."""
    a = before.nodes.select("id", F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in compared)).alias("x"))
    b = after.nodes.select("id", F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in compared)).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    nodes = a.join(b, "id", "full").select(F.lit("node").alias("item"), F.col("id").alias("key"), change.alias("change")).where("change is not null")
    name = F.concat_ws("|", "src", "kind", "dst").alias("key")
    e, f = before.edges.select(name).distinct(), after.edges.select(name).distinct()
    gone = e.join(f, "key", "left_anti").select(F.lit("edge").alias("item"), "key", F.lit("removed").alias("change"))
    new = f.join(e, "key", "left_anti").select(F.lit("edge").alias("item"), "key", F.lit("added").alias("change"))
    return nodes.unionByName(gone).unionByName(new)


def merge(into: Graph, other: Graph) -> Graph:
    """Union: nodes of ``into`` win, their empty attributes are filled from ``other``; edges once each, with both ends."""
    a, b = into.nodes, other.nodes
    names = [c for c in a.columns if c != "id"]
    right = b.select("id", *(F.col(c).alias(f"_{c}") for c in names if c in b.columns))
    both = a.join(right, "id", "full")
    filled = [F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_{c}"), F.col(c)).alias(c) if c in b.columns else F.col(c) for c in names]
    nodes = both.select("id", *filled)
    edges = into.edges.select("src", "dst", "kind").unionByName(other.edges.select("src", "dst", "kind")).distinct()
    g = Graph(nodes, edges)
    return Graph(nodes, edges.join(g.dangling(), ["src", "dst", "kind"], "left_anti"))


def drift(records_a: DataFrame, records_b: DataFrame) -> DataFrame:
    """metric, before, after, delta of two record tables (metric, value); a missing side is null."""
    a, b = records_a.select("metric", F.col("value").alias("before")), records_b.select("metric", F.col("value").alias("after"))
    return a.join(b, "metric", "full").select("metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def attribute_diff(a: Column, b: Column) -> Column:
    """Keys whose values differ, as [old, new]; a missing key is ''."""
    empty = F.create_map().cast("map<string,string>")
    zipped = F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.array(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))
    return F.map_filter(zipped, lambda k, v: v[0] != v[1])


def policy_residual(g: Graph, allow: DataFrame, sinks: DataFrame, column: str = "role") -> DataFrame:
    """Cross-group edges that the policy forbids: the source group is a sink, or the pair isn't allowed.

    ``allow`` (from_group, to_group) and ``sinks`` (from_group) are rule tables.
    """
    cross = with_groups(g, column).where("from_group <> to_group").select("from_group", "to_group", "src", "dst").distinct()
    rows = cross.join(allow.withColumn("_ok", F.lit(1)), ["from_group", "to_group"], "left").join(sinks.withColumn("_sink", F.lit(1)), "from_group", "left")
    return rows.where("_sink is not null or _ok is null").select("src", "dst", "from_group", "to_group")


def baseline_policy(g: Graph, column: str = "grp") -> DataFrame:
    return quotient(g, column).select("from_group", "to_group")


def layer_mask(g: Graph, deny: DataFrame, column: str = "role") -> DataFrame:
    """Edges whose (from, to) layers are in the deny table; unlabelled nodes are exempt."""
    simple = Graph(g.nodes, g.directed())
    rows = with_groups(simple, column).where("from_group <> '' and to_group <> ''")
    return rows.join(deny, ["from_group", "to_group"], "left_semi").select("src", "dst", "from_group", "to_group")


def move(g: Graph, node: str, group: str) -> Graph:
    return Graph(g.nodes.withColumn("grp", F.when(F.col("id") == node, group).otherwise(F.col("grp"))), g.edges)


def reverse_edge(g: Graph, src: str, dst: str) -> Graph:
    """Turn the first matching edge around."""
    first = g.edges.where((F.col("src") == src) & (F.col("dst") == dst)).agg(F.min("seq").alias("_first"))
    hit = (F.col("src") == src) & (F.col("dst") == dst) & (F.col("seq") == F.col("_first"))
    e = g.edges.crossJoin(F.broadcast(first)).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    turned = {"src": F.when(F.col("_hit"), F.col("dst")).otherwise(F.col("src")), "dst": F.when(F.col("_hit"), F.col("src")).otherwise(F.col("dst"))}
    return Graph(g.nodes, e.select(*(turned[c].alias(c) if c in turned else F.col(c) for c in g.edges.columns)))


def remove_edge(g: Graph, src: str, dst: str) -> Graph:
    first = g.edges.where((F.col("src") == src) & (F.col("dst") == dst)).agg(F.min("seq").alias("_first"))
    hit = (F.col("src") == src) & (F.col("dst") == dst) & (F.col("seq") == F.col("_first"))
    return Graph(g.nodes, g.edges.crossJoin(F.broadcast(first)).where(~F.coalesce(hit, F.lit(False))).select(*g.edges.columns))


def merge_node(g: Graph, gone: str, into: str) -> Graph:
    """Rename ``gone`` to ``into`` in all edges, drop it and the self loops this makes."""
    swap = lambda c: F.when(F.col(c) == gone, into).otherwise(F.col(c)).alias(c)
    edges = g.edges.select(*(swap(c) if c in ("src", "dst") else F.col(c) for c in g.edges.columns)).where("src <> dst")
    return Graph(g.nodes.where(F.col("id") != gone), edges)


def introduce(g: Graph, node: str, kind: str, before: str) -> Graph:
    """Put a new node in front of ``before``: its incoming edges go to the new node, which depends on it."""
    spark = g.nodes.sparkSession
    names = {"id": F.lit(node), "kind": F.lit(kind), "name": F.lit(node)}
    new = spark.range(1).select(*(names.get(f.name, F.lit("" if f.dataType.simpleString() == "string" else None).cast(f.dataType)).alias(f.name) for f in g.nodes.schema.fields))
    edges = g.edges.withColumn("dst", F.when(F.col("dst") == before, node).otherwise(F.col("dst")))
    link = {"src": F.lit(node), "dst": F.lit(before), "kind": F.lit("dependsOn")}
    one = spark.range(1).select(*(link.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in g.edges.schema.fields))
    return Graph(g.nodes.unionByName(new), edges.unionByName(one))


def accumulate(deltas: DataFrame) -> DataFrame:
    """Event-sourced weights: (id, delta) rows summed to (id, weight)."""
    return deltas.groupBy("id").agg(F.sum("delta").alias("weight"))


def focus_diff(before: Graph, after: Graph, scratch, hops: int = 1) -> DataFrame:
    """Nodes that ``after`` adds, and what lies within ``hops`` of them there: id, mark (added or context)."""
    from loomgraph.operators.traversal import khop

    added = after.nodes.select("id").join(before.nodes.select("id"), "id", "left_anti")
    found = khop(after, added, hops, scratch)
    return found.select("id", F.when(F.col("depth") == 0, "added").otherwise("context").alias("mark"))


def missing(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """Rows that a target expects and the actual graph lacks."""
    return expected.select(*keys).distinct().join(actual.select(*keys), list(keys), "left_anti")


def history(variants: DataFrame, node: str) -> DataFrame:
    """The value of one node in every variant (columns variant, id, value); '' where it is missing."""
    every = variants.select("variant").distinct()
    own = variants.where(F.col("id") == node).select("variant", F.col("value").cast("string").alias("value"))
    return every.join(own, "variant", "left").select("variant", F.coalesce("value", F.lit("")).alias("value"))
