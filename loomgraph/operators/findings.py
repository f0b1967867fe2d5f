"""Detectors over metric records, findings over generic graphs, their registries, runners, ranking and roll-ups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import HIERARCHY_KINDS, Graph
from loomgraph.operators import degrees, linalg, statistics, traversal
from loomgraph.operators.statistics import severity
from loomgraph.plans.scratch import Scratch

ANOMALY = ["detector", "id", "score", "code"]
FINDING = ["detector", "severity", "score", "primary_id", "members"]

# The order of severities, and the thresholds of the detectors.
SEVERITIES = ("info", "low", "medium", "high", "critical")
MOTIF_Z, MOTIF_INSTANCES = 3.0, 3
SYMMETRY_Z, SYMMETRY_TWINS = 3.5, 2
MODULARITY_Z, MODULARITY_TIMES = 3.0, 5
GAP_DISCONNECTED, GAP_FRAGILE, GAP_EPSILON = 1e-6, 0.05, 1e-9

DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
FINDINGS: dict[str, Callable[[Graph, Scratch], DataFrame]] = {}


def detector(name: str):
    """Register a detector: a function of the metric's records that returns (id, score, code)."""

    def add(f):
        DETECTORS[name] = f
        return f

    return add


def finding(name: str):
    """Register a detector of generic graphs: a function of (graph, scratch) that returns (severity, score, primary_id, members)."""

    def add(f):
        FINDINGS[name] = f
        return f

    return add


def _of(records: DataFrame, metric: str, scope: str) -> DataFrame:
    return records.where((F.col("metric") == metric) & (F.col("scope") == scope))


@detector("motif_redundancy")
def motif_redundancy(records: DataFrame) -> DataFrame:
    """Groups with many instances against the other groups, or with MOTIF_INSTANCES of them; the score is the larger of both."""
    z = statistics.modified_z(_of(records, "motif_redundancy", "region"))
    far = F.coalesce(F.col("z") >= MOTIF_Z, F.lit(False))
    hit = z.where(far | (F.col("value") >= MOTIF_INSTANCES))
    return hit.select(F.col("target").alias("id"), F.greatest(F.when(far, F.col("z")), F.col("value")).alias("score"), F.when(far, "outlier").otherwise("repeated").alias("code"))


@detector("local_symmetry")
def local_symmetry(records: DataFrame) -> DataFrame:
    """Nodes with many twins; where the spread is 0, those with SYMMETRY_TWINS."""
    z = statistics.modified_z(_of(records, "local_symmetry", "node"))
    hit = z.where(F.when(F.col("z").isNotNull(), F.col("z") >= SYMMETRY_Z).otherwise(F.col("value") >= SYMMETRY_TWINS))
    return hit.select(F.col("target").alias("id"), F.coalesce("z", "value").alias("score"), F.lit("twins").alias("code"))


@detector("modularity")
def modularity(records: DataFrame) -> DataFrame:
    """Communities that are large against the others of more than one node: by modified z, else by the median's multiple."""
    z = statistics.modified_z(_of(records, "modularity", "region").where("value > 1")).where("median is not null")
    far = F.coalesce(F.col("z") >= MODULARITY_Z, F.lit(False))
    times = F.col("value") / F.col("median")
    hit = z.where(far | (times >= MODULARITY_TIMES))
    return hit.select(F.col("target").alias("id"), F.when(far, F.col("z")).otherwise(times).alias("score"), F.when(far, "outlier").otherwise("oversize").alias("code"))


@detector("cycle_rank")
def cycle_rank(records: DataFrame) -> DataFrame:
    """Every non-trivial strong component; the score is its size."""
    return _of(records, "cycle_rank", "region").select(F.col("target").alias("id"), F.col("value").alias("score"), F.lit("cycle").alias("code"))


@detector("spectral_gap")
def spectral_gap(records: DataFrame) -> DataFrame:
    """A graph that is in parts or nearly so, by its algebraic connectivity."""
    rows = _of(records, "spectral_gap", "graph").where(F.col("value") < GAP_FRAGILE)
    code = F.when(F.col("value") < GAP_DISCONNECTED, "disconnected").otherwise("near_cut")
    return rows.select(F.lit("").alias("id"), (1 / (F.col("value") + GAP_EPSILON)).alias("score"), code.alias("code"))


def detect(records: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Anomalies of the named detectors (all without names): detector, id, score, code; an unknown name is an error row."""
    spark = records.sparkSession
    out = []
    for name in dict.fromkeys(names or sorted(DETECTORS)):
        if name in DETECTORS:
            out.append(DETECTORS[name](records).select(F.lit(name).alias("detector"), "id", F.col("score").cast("double").alias("score"), "code"))
        else:
            out.append(spark.range(1).select(F.lit(name).alias("detector"), F.lit("").alias("id"), F.lit(None).cast("double").alias("score"), F.lit("unknown detector").alias("code")))
    return reduce(DataFrame.unionByName, out)


# --- generic graphs ---------------------------------------------------------------------------


def children_by_parent(g: Graph) -> DataFrame:
    """Distinct (parent, child) over hierarchy edges, or over all edges where the graph has none."""
    edges = g.edges.withColumn("h", F.col("kind").isin(*HIERARCHY_KINDS).cast("int"))
    any_ = edges.agg(F.coalesce(F.max("h"), F.lit(0)).alias("any"))
    return edges.crossJoin(F.broadcast(any_)).where("h = any").select(F.col("src").alias("parent"), F.col("dst").alias("child")).distinct()


def hierarchy_cycles(g: Graph, scratch: Scratch) -> DataFrame:
    """Strong components of the hierarchy edges, and self loops: severity, score, primary_id, members."""
    e = scratch.save(g.edges.where(F.col("kind").isin(*HIERARCHY_KINDS)).select("src", "dst").distinct(), "hierarchy")
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    parts = traversal.strong_components(ids, e, scratch).join(e.where("src = dst").select(F.col("src").alias("id"), F.lit(1).alias("loop")), "id", "left")
    rows = parts.groupBy("scc").agg(F.count("*").alias("n"), F.max("loop").alias("loop"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members")).where("n > 1 or loop = 1")
    level = F.when(F.col("n") >= 5, "critical").when(F.col("n") >= 2, "high").otherwise("medium")
    return rows.select(level.alias("severity"), F.col("n").cast("double").alias("score"), F.col("scc").alias("primary_id"), "members")


@finding("hierarchy_cycle")
def _(g, s):
    return hierarchy_cycles(g, s)


@finding("articulation")
def _(g, s):
    rows = linalg.articulation_points(g, s, least=2)
    return rows.select(severity(F.col("guarded"), (20, "high"), (5, "medium")).alias("severity"), F.col("guarded").cast("double").alias("score"), F.col("id").alias("primary_id"), F.col("id").alias("members"))


@finding("label_entropy_hub")
def _(g, s):
    rows = degrees.label_entropy(Graph(g.nodes, children_by_parent(g).select(F.col("parent").alias("src"), F.col("child").alias("dst"))))
    return rows.where("entropy > 0").select(severity(F.col("score"), (40, "high"), (15, "medium")).alias("severity"), "score", F.col("src").alias("primary_id"), F.col("src").alias("members"))


@finding("orphan_bucket")
def _(g, s):
    rows = statistics.orphans(g)
    return rows.select("severity", F.col("orphans").cast("double").alias("score"), F.col("kind").alias("primary_id"), F.col("kind").alias("members"))


@finding("duplicate_titles")
def _(g, s):
    rows = statistics.duplicate_titles(g.nodes, "name")
    return rows.select("severity", F.col("n").cast("double").alias("score"), F.col("first_id").alias("primary_id"), F.col("title").alias("members"))


@finding("community_parent_mismatch")
def _(g, s):
    rows = statistics.parent_mismatch(g.nodes.where("role <> '' and grp <> ''").select("id", F.col("role").alias("community"), F.col("grp").alias("parent")))
    return rows.select("severity", F.col("ratio").alias("score"), F.col("usual").alias("primary_id"), F.col("community").alias("members"))


def find(g: Graph, scratch: Scratch, names: list[str] | None = None) -> DataFrame:
    """Findings of the named detectors, each name once; one that fails or is unknown is an error row and the others stay."""
    spark = g.nodes.sparkSession
    g = Graph(scratch.save(g.nodes, "nodes"), scratch.save(g.edges, "edges"))
    out = []
    for name in dict.fromkeys(names or sorted(FINDINGS)):
        wrong = "not registered"
        if name in FINDINGS:
            try:
                out.append(scratch.save(FINDINGS[name](g, scratch).select(F.lit(name).alias("detector"), *FINDING[1:]), "found"))
                continue
            except Exception as e:
                wrong = type(e).__name__
        out.append(spark.range(1).select(F.lit(name).alias("detector"), F.lit("error").alias("severity"), F.lit(None).cast("double").alias("score"), F.lit("").alias("primary_id"), F.lit(wrong).alias("members")))
    return reduce(DataFrame.unionByName, out)


def severity_rank(column: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), column)


def ranked(findings: DataFrame) -> list[Column]:
    """The order of findings: severity and score down, then detector, primary id and members."""
    return [severity_rank(F.col("severity")).desc(), F.desc("score"), F.col("detector"), F.col("primary_id"), F.col("members")]


def roll_up(findings: DataFrame) -> DataFrame:
    """For each detector: findings, the highest and the total score, the highest severity."""
    top = F.max(severity_rank(F.col("severity")))
    rows = findings.groupBy("detector").agg(F.count("*").alias("findings"), F.max("score").alias("highest"), F.sum("score").alias("total"), top.alias("r"))
    return rows.select("detector", "findings", "highest", "total", F.get(F.array(*map(F.lit, SEVERITIES)), (F.col("r") - 1).cast("int")).alias("severity"))


def motif_digest(groups: DataFrame, most: int = 200) -> DataFrame:
    """The ``most`` groups (canonical, size, instances) of most instances: a digest for a report."""
    return groups.orderBy(F.desc("instances"), "canonical").limit(most)


# What a pattern's report says.
PATTERN_STATES = ("match", "near_match", "mismatch", "not_applicable")


def status_counts(reports: DataFrame) -> DataFrame:
    """How many reports (status) are of each state, zeros included."""
    states = reports.sparkSession.createDataFrame([(s,) for s in PATTERN_STATES], "status string")
    counts = reports.groupBy("status").agg(F.count("*").alias("n"))
    return states.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


# --- orders and cycles ------------------------------------------------------------------------


def condensation_order(g: Graph, scratch: Scratch) -> DataFrame:
    """(id, scc, level): the peeling level of each node's strong component among the components, members in one level."""
    pairs = scratch.save(g.directed(), "pairs")
    parts = scratch.save(traversal.strong_components(g.nodes, pairs, scratch), "scc")
    over = pairs.join(parts.select(F.col("id").alias("src"), F.col("scc").alias("a")), "src").join(parts.select(F.col("id").alias("dst"), F.col("scc").alias("b")), "dst")
    over = over.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    levels = traversal.topological_levels(parts.select(F.col("scc").alias("id")).distinct(), over, scratch)
    return parts.join(levels.withColumnRenamed("id", "scc"), "scc").select("id", "scc", "level")


def layering_score(g: Graph, scratch: Scratch) -> DataFrame:
    """One row, layering: 1 - the share of edges that go back in the order of the condensation; 1 without edges.

    Nodes are ordered by their component's level, then by component and id; within a component the
    order is by id.
    """
    rank = F.struct("level", "scc", "id")
    order = scratch.save(condensation_order(g, scratch).select("id", rank.alias("rank")), "order")
    e = g.edges.join(order.select(F.col("id").alias("src"), F.col("rank").alias("a")), "src").join(order.select(F.col("id").alias("dst"), F.col("rank").alias("b")), "dst")
    back = F.sum((F.col("b") < F.col("a")).cast("long"))
    return e.agg(F.coalesce(1 - back / F.count("*"), F.lit(1.0)).alias("layering"))


def cycles_missing(g: Graph, scratch: Scratch, predicate: Column) -> DataFrame:
    """(scc, size) of the non-trivial strong components in which ``predicate`` over node columns holds for no node."""
    parts = traversal.strong_components(g.nodes, g.directed(), scratch)
    rows = parts.join(g.nodes, "id").groupBy("scc").agg(F.count("*").alias("size"), F.max(F.coalesce(predicate, F.lit(False)).cast("int")).alias("any"))
    return rows.where("size > 1 and any = 0").select("scc", "size")
