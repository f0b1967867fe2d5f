"""Metric records, their registry, snapshots, detectors and proposals.

A record is (metric, scope, target, value); a metric is a function of (graph, scratch) that returns
records. The runner unions the plans of the metrics that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.graph import Graph
from loomgraph.operators import degrees, linalg, motifs, sets, statistics, traversal
from loomgraph.plans.scratch import Scratch

METRICS: dict[str, Callable[[Graph, Scratch], DataFrame]] = {}
RECORD = ["metric", "scope", "target", "value"]


def metric(name: str):
    def add(f):
        METRICS[name] = f
        return f

    return add


def _records(df: DataFrame, name: str, scope: str, target="", value="value") -> DataFrame:
    at = F.col(target) if target else F.lit("")
    return df.select(F.lit(name).alias("metric"), F.lit(scope).alias("scope"), at.alias("target"), F.col(value).cast("double").alias("value"))


def _spectrum(g: Graph, s: Scratch) -> DataFrame:
    return s.once("spectrum", lambda: linalg.spectral_summary(linalg.laplacian_spectrum(g, s)))


@metric("components")
def _(g, s):
    return _records(traversal.components(g, s).agg(F.countDistinct("component").alias("value")), "components", "graph")


@metric("scc")
def _(g, s):
    return _records(traversal.strong_components(g.nodes, g.directed(), s).agg(F.countDistinct("scc").alias("value")), "scc", "graph")


@metric("cycle_rank")
def _(g, s):
    sizes = s.save(traversal.strong_components(g.nodes, g.directed(("calls", "dependsOn")), s).groupBy("scc").agg(F.count("*").alias("value")).where("value > 1"))
    return _records(sizes.agg(F.count("*").alias("value")), "cycle_rank", "graph").unionByName(_records(sizes, "cycle_rank", "region", "scc"))


@metric("cycle_matrix")
def _(g, s):
    found = s.save(traversal.cycle_lengths(g.directed(("calls", "dependsOn")), s))
    return _records(found.agg(F.count("*").alias("value")), "cycle_matrix", "graph").unionByName(_records(found, "cycle_matrix", "node", "id", "length"))


@metric("curvature")
def _(g, s):
    k = motifs.curvature(g.undirected()).withColumn("pair", F.concat_ws("--", "a", "b"))
    return _records(k.agg(F.coalesce(F.avg("kappa"), F.lit(0.0)).alias("value")), "curvature", "graph").unionByName(_records(k, "curvature", "edge", "pair", "kappa"))


@metric("local_symmetry")
def _(g, s):
    return _records(motifs.local_symmetry(g), "local_symmetry", "node", "id", "twins")


@metric("modularity")
def _(g, s):
    return _records(degrees.modularity(g), "modularity", "graph", value="q")


@metric("instability_matrix")
def _(g, s):
    return degrees.instability(g).select(F.lit("instability_matrix").alias("metric"), "scope", "target", "value")


@metric("spectral_gap")
def _(g, s):
    # every component has the eigenvalue 0, so a graph in parts needs no decomposition, whatever its size
    parts = s.once("parts", lambda: traversal.components(g, s).agg(F.countDistinct("component").alias("n"))).first()["n"]
    if parts == 1:
        return _records(_spectrum(g, s), "spectral_gap", "graph", value="lambda2")
    return _records(g.nodes.sparkSession.range(1).select(F.lit(0.0).alias("value")), "spectral_gap", "graph")


@metric("radius")
def _(g, s):
    return _records(_spectrum(g, s), "radius", "graph", value="radius")


@metric("eigenvalues")
def _(g, s):
    return _records(g.nodes.agg(F.countDistinct("id").alias("value")), "eigenvalues", "graph")


@metric("motif_redundancy")
def _(g, s):
    m = motifs.motif3(g).where("n > 1").withColumn("name", F.concat_ws(":", "shape", "kinds"))
    return _records(m.agg(F.count("*").alias("value")), "motif_redundancy", "graph").unionByName(_records(m, "motif_redundancy", "region", "name", "n"))


# The pairs of package roles (from, to) that the layers forbid.
DENIED_ROLES = [
    ("domain", "application"), ("domain", "inbound_adapter"), ("domain", "outbound_adapter"), ("domain", "infrastructure"),
    ("application", "inbound_adapter"), ("application", "outbound_adapter"), ("application", "infrastructure"),
    ("outbound_adapter", "domain"), ("inbound_adapter", "outbound_adapter"), ("outbound_adapter", "inbound_adapter"),
]


def layer_mask_records(g: Graph, denied: list[tuple[str, str]] = DENIED_ROLES) -> DataFrame:
    """The number of edges between roles that the table forbids, and a record for each such edge."""
    rules = g.nodes.sparkSession.createDataFrame(denied, "from_group string, to_group string")
    hits = sets.layer_mask(g, rules).withColumn("pair", F.concat("src", F.lit("\u2192"), "dst")).withColumn("value", F.lit(1.0))
    return _records(hits.agg(F.count("*").alias("value")), "layer_mask", "graph").unionByName(_records(hits, "layer_mask", "edge", "pair"))


@metric("layer_mask")
def _(g, s):
    return layer_mask_records(g)


@metric("zero")
def _(g, s):
    return _records(g.nodes.sparkSession.range(1).select(F.lit(0.0).alias("value")), "zero", "graph")


def run_metrics(g: Graph, scratch: Scratch, names: list[str] | None = None) -> DataFrame:
    """Records of the named metrics (all without names); an unknown name is an error record, not a failure."""
    spark = g.nodes.sparkSession
    g = Graph(scratch.save(g.nodes, "nodes"), scratch.save(g.edges, "edges"))  # metrics read them many times
    out = []
    for name in dict.fromkeys(names or sorted(METRICS)):
        wrong = "unknown metric"
        if name in METRICS:
            try:
                # written here, so that a metric which fails is one error record and the others stay
                out.append(scratch.save(METRICS[name](g, scratch).select(*RECORD), "records"))
                continue
            except Exception as e:
                wrong = f"{type(e).__name__}: {_reason(e)}"
        out.append(spark.range(1).select(F.lit(name).alias("metric"), F.lit("error").alias("scope"), F.lit(wrong).alias("target"), F.lit(None).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, out)


def _reason(e: Exception) -> str:
    """The line of an error that says what is wrong: of a kernel's trace its last."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    told = [x for x in lines if "Error: " in x]
    return (told or lines or [""])[-1][:200]


def snapshot(records: DataFrame, label: str) -> DataFrame:
    """Graph-scope records of one moment, rounded to 1e-9."""
    return records.where("scope = 'graph'").select(F.lit(label).alias("label"), "metric", F.round("value", 9).alias("value"))


def upsert(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the catalogue's rows of the labels that ``new`` has."""
    return catalog.join(new.select("label").distinct(), "label", "left_anti").unionByName(new)


def detect(records: DataFrame, name: str, scope: str, bound: float, floor: float) -> DataFrame:
    """Anomalies of one metric: modified z at ``bound`` or above; where MAD is 0, values from ``floor``."""
    rows = statistics.modified_z(records.where((F.col("metric") == name) & (F.col("scope") == scope)))
    hit = F.when(F.col("z").isNotNull(), F.col("z") >= bound).otherwise(F.col("value") >= floor)
    return rows.where(hit).select("metric", F.col("target").alias("id"), F.coalesce("z", "value").alias("score"))


def best_per_group(proposals: DataFrame) -> DataFrame:
    """The highest score for each (metric, target); the first in order wins ties."""
    w = Window.partitionBy("metric", "target").orderBy(F.desc("score"), "seq")
    return proposals.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def without_conflicts(proposals: DataFrame, scratch: Scratch) -> DataFrame:
    """Greedy by score (then id): a proposal goes if it shares a member with a better one that stays.

    Every round keeps all proposals that are the best of each of their members, and drops those
    that overlap them: the result of the sequential pass, in few rounds.
    """
    left = scratch.save(proposals.select("id", "score", F.array_distinct("members").alias("members")), "left")
    out = None
    while True:
        rank = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
        cells = left.select("id", rank.alias("rank"), F.explode("members").alias("m"))
        best = cells.groupBy("m").agg(F.min("rank").alias("best"))
        won = cells.join(best, "m").groupBy("id").agg(F.min((F.col("best.i") == F.col("id")).cast("int")).alias("all")).where(F.col("all") == 1).select("id")
        kept, (rows,) = scratch.save_seen(left.join(won, "id", "left_semi"), "kept", F.count(F.lit(1)))
        if not rows:
            break
        out = kept if out is None else out.unionByName(kept)
        taken = kept.select(F.explode("members").alias("m")).distinct()
        gone = left.select("id", F.explode("members").alias("m")).join(taken, "m", "left_semi").select("id").distinct()
        left = scratch.save(left.join(gone, "id", "left_anti"), "left")
    return out if out is not None else left
