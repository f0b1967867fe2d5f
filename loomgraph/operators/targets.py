"""From anomalies to proposals, targets, patches and batches: rules, expansion, validation, feasibility, convergence, rendering.

Proposals and contracts of one step are small documents; what is checked for many of them at once,
patches against contracts and batches of orphans, is joins and aggregates.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.graph import Graph

# What a patch may do and how an assignment may end.
OPERATIONS = ("regroup", "merge", "retitle", "annotate")
OUTCOMES = ("kept", "moved", "merged")
MOST_CHILDREN, MOST_ORPHANS, CONTEXT_BUDGET, CONTEXT_BASE = 12, 64, 12000, 7000


@dataclass(frozen=True)
class TargetRole:
    name: str
    kind: str
    cardinality: int = 1


@dataclass(frozen=True)
class Proposal:
    id: str
    rule: str
    trigger: str
    score: float
    roles: tuple[TargetRole, ...] = ()
    links: tuple[tuple[str, str, str], ...] = ()
    samples: tuple[dict[str, str], ...] = field(default=())


# --- proposers --------------------------------------------------------------------------------


def propose(anomalies: DataFrame, rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, rule, score): for each anomaly (id, score) the first rule that has a proposal for it.

    ``rules`` are (name, DataFrame of the ids that the rule yields for), in their order of precedence.
    """
    out = anomalies.select("id", "score")
    place = F.lit(None).cast("int")
    for i, (_, yields) in enumerate(rules):
        out = out.join(yields.select("id").distinct().withColumn(f"_r{i}", F.lit(i)), "id", "left")
    place = F.coalesce(*(F.col(f"_r{i}") for i in range(len(rules))), place)
    names = F.array(*(F.lit(n) for n, _ in rules))
    return out.select("id", F.get(names, place).alias("rule"), "score").where("rule is not null")


def package_splits(records: DataFrame, g: Graph, least: int = 20, prefix: str = "cmd/") -> DataFrame:
    """(id, members, role, kind): the five roles of a split for each command package whose modularity region has ``least`` members."""
    own = g.nodes.where((F.col("kind") == "package") & F.col("name").contains(prefix)).select("id")
    big = records.where((F.col("metric") == "modularity") & (F.col("scope") == "region") & (F.col("value") >= least)).select(F.col("target").alias("id"), F.col("value").cast("long").alias("members"))
    roles = ("CLIAdapter", "Orchestrator", "Reporter", "Contracts", "Storage")
    return big.join(own, "id", "left_semi").select("id", "members", F.explode(F.array(*map(F.lit, roles))).alias("role")).withColumn("kind", F.lit("package"))


def by_trigger(proposals: DataFrame, most: int) -> DataFrame:
    """The ``most`` proposals of highest score, then smallest id."""
    return proposals.orderBy(F.desc("score"), "id").limit(most)


# --- targets ----------------------------------------------------------------------------------


def expand_target(spark: SparkSession, proposal: Proposal) -> Graph:
    """The graph that a proposal asks for: a node for each instance of a role, links zipped (N to N) or spread (1 to N, N to 1)."""
    count: dict[str, int] = {}
    for r in proposal.roles:
        if not r.name or r.name in count:
            raise ValueError(f"target role {r.name!r} is empty or repeated")
        count[r.name] = max(r.cardinality, 1)
    name = lambda role, i: role if count[role] == 1 else f"{role}[{i}]"
    ident = lambda role, i: f"target:{proposal.id}:{name(role, i)}"
    nodes = [(ident(r.name, i), r.kind, name(r.name, i), r.name) for r in proposal.roles for i in range(count[r.name])]
    edges = []
    for a, b, kind in proposal.links:
        if a not in count or b not in count:
            raise ValueError(f"target edge {a}->{b} references an unknown role")
        m, n = count[a], count[b]
        if m != n and 1 not in (m, n):
            raise ValueError(f"target edge {a}->{b} has {m} and {n} ends")
        for i in range(max(m, n)):
            edges.append((ident(a, i if m > 1 else 0), ident(b, i if n > 1 else 0), kind))
    return Graph(spark.createDataFrame(nodes, "id string, kind string, name string, role string"), spark.createDataFrame(edges, "src string, dst string, kind string"))


def verify_target(expected: Graph, actual: Graph) -> DataFrame:
    """(item, key): nodes by kind and name, and edges by the names of their ends, that a target expects and the graph lacks."""

    def told(g: Graph) -> tuple[DataFrame, DataFrame]:
        n = g.nodes.select(F.lit("node").alias("item"), F.concat_ws(" ", "kind", "name").alias("key"))
        named = g.nodes.select("id", "name")
        e = g.edges.join(named.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
        return n.distinct(), e.select(F.lit("edge").alias("item"), F.concat_ws(" ", "a", "kind", "b").alias("key")).distinct()

    (a, b), (c, d) = told(expected), told(actual)
    return a.join(c, ["item", "key"], "left_anti").unionByName(b.join(d, ["item", "key"], "left_anti"))


def feasibility(samples: Iterable[dict[str, str]], region_nodes: int, target_nodes: int) -> tuple[str, list[str]]:
    """(status, reused values): a candidate, or one to review as samples share an Impl or Method or the target is larger than region and samples."""
    samples = list(samples)
    seen = Counter(v for s in samples for k in ("Impl", "Method") if (v := s.get(k)))
    reused = sorted(v for v, n in seen.items() if n > 1)
    return ("needs_review" if reused or target_nodes > region_nodes + len(samples) else "candidate"), reused


def convergence(before: tuple[int, int], after: tuple[int, int], applied: bool, failed: bool = False) -> tuple[str, int]:
    """(status, change of nodes plus edges) of a step of the loop."""
    delta = sum(after) - sum(before)
    if failed:
        return "failed", delta
    if not applied:
        return "dry_run", delta
    return ("converged" if delta == 0 else "improved" if delta < 0 else "regressed"), delta


def optimise(state, propose_next: Callable, materialise: Callable, validate: Callable, score: Callable, most: int, dry_run: bool = False) -> list[dict]:
    """The loop: take the next proposal, make it, check it, go on; it ends on a failure, without a proposal, on a dry run or after ``most`` batches.

    Making a change is the caller's (an external program or model); nothing here calls one.
    """
    report = []
    for batch in range(most):
        proposal = propose_next(state)
        if proposal is None:
            report.append({"batch": batch, "status": "empty"})
            break
        if dry_run:
            report.append({"batch": batch, "status": "dry_run", "proposal": proposal})
            break
        made = materialise(state, proposal)
        if wrong := validate(state, proposal, made):
            report.append({"batch": batch, "status": "failed", "proposal": proposal, "reason": wrong})
            break
        status, delta = convergence(score(state), score(made), True)
        report.append({"batch": batch, "status": status, "proposal": proposal, "delta": delta})
        state = made
        if status == "converged":
            break
    return report


# --- patches ----------------------------------------------------------------------------------

FENCE = re.compile(r"```(?:json)?\s*\n(.*?)\n\s*```", re.S)


def parse_patch(reply: str) -> dict:
    """The JSON object in the first fenced block of a reply, or the reply itself if it is one."""
    found = FENCE.search(reply)
    out = json.loads(found[1] if found else reply)
    if not isinstance(out, dict):
        raise ValueError("a patch is an object")
    return out


def fenced_json(text):
    """``parse_patch`` as a column: the block's text, else the text."""
    block = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n(.*?)\n\s*```", 1)
    return F.when(block != "", block).otherwise(text)


def check_contracts(contracts: DataFrame, selected: DataFrame, allowed: DataFrame) -> DataFrame:
    """(contract, fault) of contracts (contract, kind) with selected (contract, id) and allowed (contract, op): '' if sound."""
    s = selected.groupBy("contract").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.max((F.coalesce("id", F.lit("")) == "").cast("int")).alias("blank"))
    a = allowed.groupBy("contract").agg(F.max((~F.col("op").isin(*OPERATIONS)).cast("int")).alias("odd"))
    rows = contracts.join(s, "contract", "left").join(a, "contract", "left")
    fault = (
        F.when(F.coalesce("kind", F.lit("")) == "", "no kind").when(F.coalesce("n", F.lit(0)) == 0, "nothing selected").when(F.col("blank") == 1, "empty id")
        .when(F.col("d") < F.col("n"), "repeated id").when(F.coalesce("odd", F.lit(0)) == 1, "unknown operation").otherwise("")
    )
    return rows.select("contract", fault.alias("fault"))


def check_patches(patches: DataFrame, operations: DataFrame, assignments: DataFrame, selected: DataFrame, allowed: DataFrame) -> DataFrame:
    """(patch, verdict): ok, or the first thing that is wrong with each patch.

    ``patches`` (patch, contract, rationale, sources), ``operations`` (patch, seq, op, target),
    ``assignments`` (patch, seq, node, outcome), ``selected`` (contract, id), ``allowed`` (contract, op).
    Operations come first, in their order; then assignments, which cover each selected node once; then
    the rationale of regroups and merges, and the sources.
    """
    owner = patches.select("patch", "contract")
    ops = operations.join(owner, "patch").join(allowed.distinct().withColumn("_ok", F.lit(1)), ["contract", "op"], "left")
    ops = ops.join(selected.distinct().select("contract", F.col("id").alias("target"), F.lit(1).alias("_in")), ["contract", "target"], "left")
    wrong = F.when(~F.col("op").isin(*OPERATIONS), "unknown_op").when(F.col("_ok").isNull(), "shape_change").when(F.col("_in").isNull(), "extra_node")
    first = ops.select("patch", "seq", wrong.alias("w"), "op").groupBy("patch").agg(F.min(F.when(F.col("w").isNotNull(), F.struct("seq", "w")))["w"].alias("op_fault"), F.max(F.col("op").isin("regroup", "merge").cast("int")).alias("moves"))
    rows = assignments.join(owner, "patch").join(selected.distinct().select("contract", F.col("id").alias("node"), F.lit(1).alias("_in")), ["contract", "node"], "left")
    again = F.row_number().over(Window.partitionBy("patch", "node").orderBy("seq")) > 1
    rows = rows.withColumn("_again", again)
    bad = F.when(F.col("_in").isNull(), "extra_node").when(F.col("_again"), "duplicate_assignment").when(~F.col("outcome").isin(*OUTCOMES), "unknown_outcome")
    told = rows.select("patch", "seq", "node", bad.alias("w"), "_in").groupBy("patch").agg(F.min(F.when(F.col("w").isNotNull(), F.struct("seq", "w")))["w"].alias("as_fault"), F.countDistinct(F.when(F.col("_in") == 1, F.col("node"))).alias("covered"))
    sizes = selected.groupBy("contract").agg(F.countDistinct("id").alias("size"))
    out = patches.join(first, "patch", "left").join(told, "patch", "left").join(sizes, "contract", "left")
    verdict = F.coalesce(
        F.col("op_fault"), F.col("as_fault"), F.when(F.coalesce("covered", F.lit(0)) < F.coalesce("size", F.lit(0)), "missing_node"),
        F.when((F.col("moves") == 1) & (F.trim(F.coalesce("rationale", F.lit(""))) == ""), "missing_rationale"), F.when(F.coalesce("sources", F.lit(0)) == 0, "missing_sources"), F.lit("ok"),
    )
    return out.select("patch", verdict.alias("verdict"))


# --- batches ----------------------------------------------------------------------------------


def orphan_batch(orphans: DataFrame, most: int = MOST_ORPHANS, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """(id, bucket, place, spent): the next batch of orphans (id, label, memory_type, entity_type, labels).

    The bucket is working memory, then episodic, then sessions, events and issues, then the most common
    label. A batch is its first ``most`` by label and id, as many as fit the context: a base and three
    times a row's JSON and a bit each. The choice of a bucket is an aggregate; what is ordered is the
    batch's heap.
    """
    labels = F.filter(F.transform(F.split("labels", ","), lambda x: F.trim(x)), lambda x: x != "")
    named = (
        F.when(F.upper("memory_type") == "WORKING", F.struct(F.lit(0).alias("p"), F.lit("memoryType:WORKING").alias("b")))
        .when(F.upper("memory_type") == "EPISODIC", F.struct(F.lit(1).alias("p"), F.lit("memoryType:EPISODIC").alias("b")))
        .when(F.lower("entity_type") == "session", F.struct(F.lit(2).alias("p"), F.lit("entityType:session").alias("b")))
        .when(F.lower("entity_type") == "event", F.struct(F.lit(3).alias("p"), F.lit("entityType:event").alias("b")))
        .when(F.lower("entity_type") == "issue", F.struct(F.lit(4).alias("p"), F.lit("entityType:issue").alias("b")))
    )
    best = orphans.agg(F.min(named).alias("x"))
    common = orphans.select(F.explode(labels).alias("l")).groupBy("l").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "l"))["l"].alias("l"))
    chosen = best.crossJoin(common).select(F.coalesce(F.col("x.b"), F.col("l"), F.lit("")).alias("bucket"))
    rows = orphans.crossJoin(F.broadcast(chosen))
    kind, value = F.split_part("bucket", F.lit(":"), F.lit(1)), F.split_part("bucket", F.lit(":"), F.lit(2))
    fits = F.when(kind == "memoryType", F.upper("memory_type") == value).when(kind == "entityType", F.lower("entity_type") == value).when(F.col("bucket") == "", F.lit(True)).otherwise(F.array_contains(labels, F.col("bucket")))
    batch = rows.where(fits).orderBy("label", "id").limit(most)
    order = Window.orderBy("label", "id")  # of the batch only
    cost = 3 * F.length(F.to_json(F.struct("id", "label"))) + 160
    batch = batch.withColumn("place", F.row_number().over(order).cast("long")).withColumn("spent", CONTEXT_BASE + F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return batch.where(F.col("spent") <= budget).select("id", "bucket", "place", F.col("spent").cast("long").alias("spent"))


def batch_contract(batch: DataFrame) -> DataFrame:
    """One row for a batch: bucket, selected, groups of at most MOST_CHILDREN, and whether all may be deleted (working sessions)."""
    return batch.groupBy("bucket").agg(F.count("*").alias("selected"), F.ceil(F.count("*") / MOST_CHILDREN).alias("groups"), (F.first("bucket") == "memoryType:WORKING").alias("deletable"))


def next_batch(orphans: int, has_anchor: bool, stars: list[tuple[str, bool, float]]) -> tuple[str, str]:
    """(kind, id): orphans first if there is an anchor to put them under, else the feasible flat star of highest score, else none."""
    if orphans and has_anchor:
        return "orphan_bucket", ""
    good = sorted((-score, hub) for hub, feasible, score in stars if feasible)
    return ("flat_star_hub", good[0][1]) if good else ("none", "")


# --- rendering --------------------------------------------------------------------------------


def skeleton_yaml(p: Proposal) -> str:
    """The skeleton file of a proposal."""
    out = [f"proposal_id: {json.dumps(p.id)}", "target_subgraph:", "  roles:"]
    out += [f"    - id: {r.name}\n      kind: {r.kind}" + (f"\n      cardinality: {r.cardinality}" if r.cardinality > 1 else "") for r in p.roles]
    out += ["  edges:", *(f"    - from: {a}\n      to: {b}\n      kind: {k}" for a, b, k in p.links)]
    if p.samples:
        out += ["samples:", *("  - " + json.dumps(s, sort_keys=True) for s in p.samples)]
    return "\n".join(out) + "\n"


def source_stub(p: Proposal, package: str) -> str:
    """A source file's stubs for the roles of a proposal: interfaces, structs and methods."""
    out = [f"package {package}", ""]
    implemented = {b for _, b, k in p.links if k == "implements"}
    for r in p.roles:
        if r.kind == "type":
            out += [f"// {r.name} is proposed by {p.id}.", f"type {r.name} {'interface' if r.name in implemented else 'struct'} {{", "}", ""]
    holder = {b: a for a, b, k in p.links if k == "contains"}
    for r in p.roles:
        if r.kind in ("method", "function"):
            receiver = f"(x *{holder[r.name]}) " if r.kind == "method" and r.name in holder else ""
            out += [f"func {receiver}{r.name}() {{", '\tpanic("not implemented")', "}", ""]
    return "\n".join(out)
