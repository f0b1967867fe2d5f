"""Named calculations over any graph: the name that a command or a tool gives, and the operator behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import degrees, linalg, motifs, statistics, traversal
from loomgraph.plans.scratch import Scratch


def _cycles(g: Graph, s: Scratch) -> DataFrame:
    parts = traversal.strong_components(g.nodes, g.directed(), s).groupBy("scc")
    return parts.agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members")).where("size > 1")


CALCULATIONS: dict[str, Callable[[Graph, Scratch], DataFrame]] = {
    "lambda2": lambda g, s: linalg.spectral_summary(linalg.laplacian_spectrum(g, s)).select("lambda2", "components"),
    "components": lambda g, s: traversal.components(g, s).groupBy("component").agg(F.count("*").alias("size")),
    "cycles": _cycles,
    "levels": lambda g, s: traversal.topological_levels(g.nodes, g.directed(), s),
    "modularity": lambda g, s: degrees.modularity(g),
    "god-nodes": lambda g, s: statistics.god_nodes(g),
    "coupling": lambda g, s: degrees.coupling(g),
    "quotient": lambda g, s: degrees.quotient(g),
    "curvature": lambda g, s: motifs.curvature(g.undirected()),
    "pagerank": lambda g, s: traversal.pagerank(g.nodes, g.edges, s),
    "trophic": lambda g, s: linalg.trophic_levels(g, s),
    "articulation": lambda g, s: linalg.articulation_points(g, s),
    "communities": lambda g, s: linalg.louvain(g, s),
    "orphans": lambda g, s: statistics.orphans(g),
    "flat-stars": lambda g, s: statistics.flat_stars(g),
}


def calculate(name: str, g: Graph, scratch: Scratch) -> DataFrame:
    if name not in CALCULATIONS:
        raise ValueError(f"unknown calculation {name!r}; known: {', '.join(sorted(CALCULATIONS))}")
    return CALCULATIONS[name](g, scratch)
