"""Contracts, patterns and regions: producers, consumers, propagation, fingerprints, boundary, pattern joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.traversal import spread
from loomgraph.plans.scratch import Scratch

# Edge kinds by which a node produces or uses a contract, and the role that each gives.
PRODUCES = ("returns", "implements", "publishes", "writes", "route_registers")
CONSUMES = {"calls": "caller", "callsFrom": "caller", "usesType": "user", "references": "user", "reads": "reader", "subscribes": "subscriber", "embeds": "embedder", "dependsOn": "dependent"}
#: Edge kinds that count as use of a type by the external-noise pattern.
NOISE_KINDS = ("calls", "callsFrom", "dependsOn", "returns", "implements")


def producers(g: Graph, ids: DataFrame) -> DataFrame:
    """(contract, id, kind) of the nodes that produce each contract in ``ids`` (column id)."""
    into = g.edges.where(F.col("kind").isin(*PRODUCES) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    found = into.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return found.join(g.nodes.select(F.col("id").alias("src"), "kind"), "src").select(F.col("dst").alias("contract"), F.col("src").alias("id"), "kind")


def consumers(g: Graph, ids: DataFrame) -> DataFrame:
    """(contract, id, role) of the nodes that use each contract, once for each role."""
    role = F.lit(None).cast("string")
    for kind, name in CONSUMES.items():
        role = F.when(F.col("kind") == kind, name).otherwise(role)
    into = g.edges.where(F.col("kind").isin(*CONSUMES) & (F.col("src") != F.col("dst")))
    found = into.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return found.select(F.col("dst").alias("contract"), F.col("src").alias("id"), role.alias("role")).distinct()


def propagate(g: Graph, marked: DataFrame, scratch: Scratch) -> DataFrame:
    """Contracts and the nodes that embed one, directly or not: id, source (explicit or embedded)."""
    up = g.edges.where("kind = 'embeds' and src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("other"))
    found = spread(up, marked, scratch)
    return found.select("id", F.when(F.col("depth") == 0, "explicit").otherwise("embedded").alias("source"))


def fingerprint(g: Graph, ids: DataFrame) -> DataFrame:
    """A digest of each contract's id, kind and sorted members (its in-neighbours)."""
    members = g.edges.where("src <> dst").select(F.col("dst").alias("id"), F.concat_ws(":", "kind", "src").alias("m")).distinct()
    # members are digested one by one first, so a contract with very many carries fixed-size rows
    rows = members.join(ids, "id", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("m")), "\n").alias("m"))
    nodes = g.nodes.join(ids, "id", "left_semi").select("id", "kind")
    return nodes.join(rows, "id", "left").select("id", F.sha2(F.concat_ws("\n", "id", "kind", F.coalesce("m", F.lit(""))).cast("binary"), 256).alias("fingerprint"))


def classify(g: Graph) -> DataFrame:
    """The contract kind of each node: interface, handler (a function that something returns from), dto or none."""
    registered = g.edges.where("kind = 'returns'").select(F.col("src").alias("id")).distinct().withColumn("_r", F.lit(1))
    rows = g.nodes.join(registered, "id", "left")
    kind = F.when(F.col("kind") == "interface", "interface").when(F.col("kind").isin("function", "method") & F.col("_r").isNotNull(), "handler")
    return rows.select("id", kind.when((F.col("kind") == "type") & F.col("name").rlike(r"^\p{Lu}"), "dto").otherwise("none").alias("contract_kind"))


def resolve(wanted: DataFrame, g: Graph) -> DataFrame:
    """Configured names (column name) to nodes; those that no node has keep a reason."""
    known = g.nodes.select(F.col("name"), "id", "kind").groupBy("name").agg(F.min(F.struct("id", "kind")).alias("n"))
    return wanted.join(known, "name", "left").select("name", F.col("n.id").alias("id"), F.when(F.col("n").isNull(), "unresolved").otherwise("ok").alias("reason"))


def boundary(g: Graph, region: DataFrame) -> DataFrame:
    """Edges with exactly one end in the region, and which way they go."""
    inside = region.select("id").distinct().withColumn("_in", F.lit(1))
    rows = g.edges.join(inside.withColumnRenamed("id", "src").withColumnRenamed("_in", "_s"), "src", "left").join(inside.withColumnRenamed("id", "dst").withColumnRenamed("_in", "_d"), "dst", "left")
    one = rows.where(F.col("_s").isNull() != F.col("_d").isNull())
    return one.select("src", "dst", "kind", F.when(F.col("_s").isNotNull(), "out").otherwise("in").alias("way"))


def external_noise(g: Graph, foreign: DataFrame, least: int = 5, share: float = 0.7, kinds: tuple[str, ...] = NOISE_KINDS) -> DataFrame:
    """Non-foreign types that foreign nodes mostly use: id, inbound, foreign_inbound, share."""
    marks = foreign.select("id").distinct().withColumn("_f", F.lit(1))
    types = g.nodes.where("kind = 'type'").select("id").join(marks, "id", "left_anti")
    into = g.edges.where(F.col("kind").isin(*kinds) & (F.col("src") != F.col("dst"))).join(types.withColumnRenamed("id", "dst"), "dst", "left_semi")
    rows = into.join(marks.withColumnRenamed("id", "src"), "src", "left").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound"), F.count("_f").alias("foreign_inbound"))
    return rows.withColumn("share", F.col("foreign_inbound") / F.col("inbound")).where((F.col("inbound") >= least) & (F.col("share") >= share))


def match_pattern(g: Graph, roles: dict[str, str], links: list[tuple[str, str, str]]) -> DataFrame:
    """All injective matches of a pattern: a column for each role, with its node.

    ``roles`` maps a role to a node kind, ``links`` are (from role, to role, edge kind). The pattern
    compiles to one equi-join for each link, in an order in which each link shares a role with those
    before it, so no cross product is planned for a connected pattern.
    """
    todo, bound, out = list(links), [], None
    kinds = {r: g.nodes.where(F.col("kind") == k).select(F.col("id").alias(r)) for r, k in roles.items()}
    while todo:
        link = next((x for x in todo if out is None or x[0] in bound or x[1] in bound), todo[0])
        todo.remove(link)
        a, b, kind = link
        step = g.edges.where(F.col("kind") == kind).select(F.col("src").alias(a), F.col("dst").alias(b)).distinct()
        step = step.join(kinds[a], a, "left_semi").join(kinds[b], b, "left_semi")
        on = [r for r in (a, b) if r in bound]
        out = step if out is None else out.join(step, on) if on else out.crossJoin(step)
        for r in (a, b):
            if r not in bound:
                for other in bound:
                    out = out.where(F.col(other) != F.col(r))
                bound.append(r)
    return out.select(*roles)
