"""Aggregations over edges: degrees, coupling, instability, quotients, purity, modularity, entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.graph import Graph


def fan(g: Graph, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """id, fan_out, fan_in of the simple directed graph, zeros included: one pass over the edges."""
    ends = g.directed(kinds)
    both = ends.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(ends.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counts = both.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return g.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("o", F.lit(0)).cast("long").alias("fan_out"), F.coalesce("i", F.lit(0)).cast("long").alias("fan_in"))


def bag_degrees(g: Graph, self_loops: bool = True) -> DataFrame:
    """id, ca, ce over the edge bag: parallel edges count."""
    edges = g.edges if self_loops else g.edges.where("src <> dst")
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counts = both.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return g.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("i", F.lit(0)).cast("long").alias("ca"), F.coalesce("o", F.lit(0)).cast("long").alias("ce"))


def degree(g: Graph) -> DataFrame:
    """id, degree: in plus out over the bag, a self loop once."""
    ends = g.edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    return g.nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("degree"))


def sinks(g: Graph) -> DataFrame:
    return g.nodes.select("id").join(g.edges.where("src <> dst").select(F.col("src").alias("id")), "id", "left_anti")


def sources(g: Graph) -> DataFrame:
    return g.nodes.select("id").join(g.edges.where("src <> dst").select(F.col("dst").alias("id")), "id", "left_anti")


def dead_items(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items (column id) that no edge points to."""
    return items.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def coupling(g: Graph) -> DataFrame:
    """id, ca, ce, instability over the bag; 0 without edges."""
    d = bag_degrees(g)
    total = F.col("ca") + F.col("ce")
    return d.select("id", "ca", "ce", F.when(total > 0, F.col("ce") / total).otherwise(F.lit(0.0)).alias("instability"))


def instability(g: Graph) -> DataFrame:
    """Records (scope, target, value): nodes with a degree, regions by role, and the graph's mean."""
    d = fan(g).where("fan_in + fan_out > 0").join(g.nodes.select("id", F.when(F.coalesce("role", F.lit("")) == "", "(unlabelled)").otherwise(F.col("role")).alias("role")), "id")
    node = d.select(F.lit("node").alias("scope"), F.col("id").alias("target"), (F.col("fan_out") / (F.col("fan_out") + F.col("fan_in"))).alias("value"))
    region = d.groupBy("role").agg((F.sum("fan_out") / F.sum(F.col("fan_out") + F.col("fan_in"))).alias("value")).select(F.lit("region").alias("scope"), F.col("role").alias("target"), "value")
    whole = node.agg(F.avg("value").alias("value")).select(F.lit("graph").alias("scope"), F.lit("").alias("target"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return node.unionByName(region).unionByName(whole)


def with_groups(g: Graph, column: str = "grp") -> DataFrame:
    """Edges with the groups of their ends, from_group and to_group."""
    side = g.nodes.select("id", F.coalesce(F.col(column), F.lit("")).alias("_g"))
    out = g.edges.join(side.select(F.col("id").alias("src"), F.col("_g").alias("from_group")), "src")
    return out.join(side.select(F.col("id").alias("dst"), F.col("_g").alias("to_group")), "dst")


def quotient(g: Graph, column: str = "grp", distinct: bool = False) -> DataFrame:
    """from_group, to_group, weight over cross-group edges; ``distinct`` counts (src, dst) once."""
    cross = with_groups(g, column).where("from_group <> to_group").select("from_group", "to_group", "src", "dst")
    cross = cross.distinct() if distinct else cross
    return cross.groupBy("from_group", "to_group").agg(F.count("*").alias("weight"))


def layer_collapse(g: Graph, column: str = "role") -> DataFrame:
    """Edges between layers, the diagonal included, over the simple directed graph."""
    simple = Graph(g.nodes, g.directed())
    return with_groups(simple, column).groupBy("from_group", "to_group").agg(F.count("*").alias("edges"))


def transpose_difference(pairs: DataFrame) -> DataFrame:
    """A minus its transpose: src, dst, sign of every pair that goes one way only, in both directions."""
    one_way = pairs.join(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    return one_way.select("src", "dst", F.lit(1).alias("sign")).unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(-1).alias("sign")))


def role_coupling(g: Graph, evidence: int = 5) -> DataFrame:
    """Edges per role pair, with the first ``evidence`` of them by insertion, joined by commas.

    The first edges come from a rank that Spark limits before the shuffle, so no whole group is collected.
    """
    rows = with_groups(g, "role").select("from_group", "to_group", "seq", F.concat_ws("->", "src", "dst").alias("e"))
    counts = rows.groupBy("from_group", "to_group").agg(F.count("*").alias("edges"))
    order = Window.partitionBy("from_group", "to_group").orderBy("seq", "e")
    first = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= evidence)
    shown = first.groupBy("from_group", "to_group").agg(F.array_sort(F.collect_list(F.struct("r", "e"))).alias("x"))
    text = F.array_join(F.transform("x", lambda v: v["e"]), ",").alias("evidence")
    return counts.join(shown, ["from_group", "to_group"]).select("from_group", "to_group", "edges", text)


def purity(g: Graph, allowed: DataFrame, column: str = "role") -> DataFrame:
    """Share of each group's edges whose (from_group, to_group) is in ``allowed``."""
    ok = allowed.withColumn("_ok", F.lit(1))
    rows = with_groups(g, column).join(ok, ["from_group", "to_group"], "left")
    return rows.groupBy("from_group").agg(F.count("*").alias("total"), F.sum(F.coalesce("_ok", F.lit(0))).alias("kept")).select("from_group", "total", "kept", (F.col("kept") / F.col("total")).alias("purity"))


def cut_quality(g: Graph, column: str = "grp") -> DataFrame:
    same = F.col("from_group") == F.col("to_group")
    return with_groups(g, column).agg(F.sum(same.cast("long")).alias("intra"), F.sum((~same).cast("long")).alias("inter"))


def community_tallies(g: Graph, column: str = "grp") -> DataFrame:
    """Edges within and between communities, per unordered pair."""
    low, high = F.least("from_group", "to_group").alias("a"), F.greatest("from_group", "to_group").alias("b")
    return with_groups(g, column).groupBy(low, high).agg(F.count("*").alias("edges"))


def modularity(g: Graph, column: str = "grp") -> DataFrame:
    """Newman's Q of a labelling over the undirected simple projection; 0 without edges.

    Q is a sum over labels of L / m - (d / 2m)^2, so no pair of nodes is built.
    """
    labels = g.nodes.select("id", F.coalesce(F.col(column), F.lit("")).alias("c"))
    pairs = g.undirected()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).join(labels, "id").groupBy("c").agg(F.count("*").alias("d"))
    inner = pairs.join(labels.select(F.col("id").alias("a"), F.col("c")), "a").join(labels.select(F.col("id").alias("b"), F.col("c").alias("c2")), "b").where("c = c2").groupBy("c").agg(F.count("*").alias("l"))
    m = ends.agg((F.sum("d") / 2).alias("m"))
    parts = ends.join(inner, "c", "left").crossJoin(F.broadcast(m))  # m is one row
    q = F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2))
    return parts.agg(F.coalesce(q, F.lit(0.0)).alias("q"))


def label_entropy(g: Graph, least: int = 5) -> DataFrame:
    """Shannon entropy (bits) of each parent's child kinds times its fan-out, from ``least`` children."""
    kinds = g.nodes.select(F.col("id").alias("dst"), F.col("kind").alias("child_kind"))
    counts = g.edges.where("src <> dst").select("src", "dst").distinct().join(kinds, "dst").groupBy("src", "child_kind").agg(F.count("*").alias("n"))
    total = counts.groupBy("src").agg(F.sum("n").alias("fan_out")).where(F.col("fan_out") >= least)
    p = F.col("n") / F.col("fan_out")
    return counts.join(total, "src").groupBy("src").agg(F.max("fan_out").alias("fan_out"), (-F.sum(p * F.log2(p))).alias("entropy")).select("src", "fan_out", "entropy", (F.col("entropy") * F.col("fan_out")).alias("score"))


def file_statistics(g: Graph, factor: float = 3, floor: float = 20) -> DataFrame:
    """Symbols of each file node, the median, and whether it stands out."""
    held = g.edges.where("kind = 'contains'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    files = g.nodes.where("kind = 'file'").select("id").join(held, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("symbols"))
    middle = files.agg(F.median("symbols").alias("median"))
    bound = F.greatest(F.col("median") * factor, F.lit(float(floor)))
    return files.crossJoin(F.broadcast(middle)).select("id", "symbols", "median", (F.col("symbols") >= bound).alias("outlier"))


def majority_parent(members: DataFrame) -> DataFrame:
    """The most common parent of each community (columns community, parent); ties go to the smallest."""
    counts = members.groupBy("community", "parent").agg(F.count("*").alias("n"))
    best = counts.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "parent")).alias("best"), F.sum("n").alias("size"))
    return best.select("community", F.col("best.parent").alias("parent"), (-F.col("best.n")).alias("votes"), "size")


def quotient_members(g: Graph, column: str = "grp") -> DataFrame:
    """Cross-group pairs with the sorted list of the edges beneath, for graphs whose lists are read by people."""
    rows = with_groups(g, column).where("from_group <> to_group").select("from_group", "to_group", F.concat_ws("->", "src", "dst").alias("e")).distinct()
    return rows.groupBy("from_group", "to_group").agg(F.count("*").alias("weight"), F.array_join(F.array_sort(F.collect_list("e")), ",").alias("edges"))


def quotient_by_communities(g: Graph, members: DataFrame) -> DataFrame:
    """(from_group, to_group, weight) between communities of ``members`` (id, community), by distinct (src, dst).

    A node of two communities is an error; members that are no nodes, and edges of nodes without a
    community, are left out.
    """
    twice = members.groupBy("id").agg(F.countDistinct("community").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['id']} is in several communities")
    own = g.nodes.select("id").join(members.select("id", F.col("community").alias("grp")).distinct(), "id")
    return quotient(Graph(own, g.edges), distinct=True)
