"""Joins and fix-points over edges: neighbours, k-hop, paths, closures, components, cycles, orders, walks.

Loops keep their state in written tables (``Scratch``), carry only ids, and look at the driver only
for a count a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.components import checksum, connected_components, grouped_components, ranked
from loomgraph.plans.scratch import Scratch, fixpoint

#: Rounds of a search after which what is known is written as one table, so that plans stay short.
FOLD = 16


def neighbors(g: Graph, ids: DataFrame, direction: str = "both", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, other) of each id in ``ids``; ``direction`` is out, in or both."""
    edges = g.edges if kinds is None else g.edges.where(F.col("kind").isin(*kinds))
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))
    found = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return found.join(ids, "id", "left_semi").distinct()


def spread(steps: DataFrame, seeds: DataFrame, scratch: Scratch, depth: int | None = None) -> DataFrame:
    """Breadth-first search over ``steps`` (id, other) from ``seeds`` (id): id and depth; without ``depth`` to the end.

    Each round joins the frontier only and drops what is known by an anti join.
    """
    steps = scratch.save(steps, "steps")
    seen = frontier = scratch.save(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "seen")
    round_ = 0
    while depth is None or round_ < depth:
        round_ += 1
        nxt = frontier.select("id").join(steps, "id").select(F.col("other").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier, (rows,) = scratch.save_seen(nxt.withColumn("depth", F.lit(round_)), "frontier", F.count(F.lit(1)))
        if not rows:
            break
        seen = seen.unionByName(frontier)
        if round_ % FOLD == 0:
            seen = scratch.save(seen, "seen")
    return seen


def khop(g: Graph, seeds: DataFrame, depth: int, scratch: Scratch, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes within ``depth`` undirected hops, the seeds at depth 0."""
    return spread(g.neighbours(kinds), seeds, scratch, depth)


def khop_subgraph(g: Graph, seeds: DataFrame, depth: int, scratch: Scratch) -> Graph:
    return g.induced(khop(g, seeds, depth, scratch).select("id"))


def reachable(pairs: DataFrame, roots: DataFrame, scratch: Scratch, depth: int | None = None) -> DataFrame:
    """Nodes that directed ``pairs`` (src, dst) reach from the roots, which are included."""
    return spread(pairs.select(F.col("src").alias("id"), F.col("dst").alias("other")), roots, scratch, depth)


def shortest_paths(pairs: DataFrame, start: str, scratch: Scratch, depth: int | None = None) -> DataFrame:
    """The unweighted shortest path from ``start`` to every node it reaches: id, hops, path.

    Of the predecessors at equal distance the one whose own path is smallest wins. The search keeps
    a node's predecessor and the place of its path among those of its distance; paths are put
    together at the end, by doubling: a node's ancestors 1, 2, 4, ... steps before it.
    """
    spark, pairs = pairs.sparkSession, scratch.save(pairs, "pairs")
    first = spark.createDataFrame([(start, 0, None, 1)], "id string, hops int, before string, place long")
    known = frontier = scratch.save(first, "found")
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        step = frontier.select(F.col("id").alias("src"), "place").join(pairs, "src").groupBy("dst").agg(F.min(F.struct("place", "src")).alias("best"))
        step = step.join(known.select(F.col("id").alias("dst")), "dst", "left_anti")
        # the order of paths of one length: by the predecessor's place, then by the own id; numbers grow along a sort by ranges
        placed = step.orderBy("best.place", "dst").select(F.col("dst").alias("id"), F.lit(hop).alias("hops"), F.col("best.src").alias("before"), F.monotonically_increasing_id().alias("place"))
        frontier, (rows,) = scratch.save_seen(placed, "found", F.count(F.lit(1)))
        if not rows:
            break
        known = known.unionByName(frontier)
        if hop % FOLD == 0:
            known = scratch.save(known, "found")
    known = scratch.save(known, "found")
    # tail: the last nodes of the path, jump: the node before them
    paths = scratch.save(known.select("id", "hops", F.array("id").alias("tail"), F.col("before").alias("jump")), "paths")
    reach = 1
    while reach <= hop:
        ahead = paths.select(F.col("id").alias("jump"), F.col("tail").alias("more"), F.col("jump").alias("next"))
        paths = scratch.save(paths.join(ahead, "jump", "left").select("id", "hops", F.when(F.col("more").isNull(), F.col("tail")).otherwise(F.concat("more", "tail")).alias("tail"), F.col("next").alias("jump")), "paths")
        reach *= 2
    return paths.select("id", "hops", F.col("tail").alias("path"))


def closure(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst) by one step or more, with doubling: rounds grow with the log of the diameter."""

    def wider(reach: DataFrame) -> DataFrame:
        far = reach.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        return reach.unionByName(reach.join(far, "dst").select("src", F.col("far").alias("dst"))).distinct()

    return fixpoint(scratch, pairs.select("src", "dst").distinct(), wider, (F.count(F.lit(1)),))


def components(g: Graph, scratch: Scratch, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, component) of the undirected projection; the component is its smallest node."""
    if g.groups is not None and kinds is None:
        _, parts = scratch.held(g.groups, lambda: grouped_components(g.groups, scratch))
        return g.nodes.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    parts = connected_components(g.undirected(kinds).select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    return g.nodes.select("id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def trim(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs between nodes that have both a predecessor and a successor, to the end: what is left may lie on cycles."""

    def inner(left: DataFrame) -> DataFrame:
        heads, tails = left.select(F.col("src").alias("_h")).distinct(), left.select(F.col("dst").alias("_t")).distinct()
        return left.join(tails, F.col("src") == F.col("_t"), "left_semi").join(heads, F.col("dst") == F.col("_h"), "left_semi")

    return fixpoint(scratch, pairs.select("src", "dst").distinct(), inner, (F.count(F.lit(1)),))


def _peel(pairs: DataFrame, scratch: Scratch, rounds: int = 4) -> DataFrame:
    """Some rounds of ``trim``: enough to make the rest smaller, whatever the longest path."""
    for _ in range(rounds):
        heads, tails = pairs.select(F.col("src").alias("_h")).distinct(), pairs.select(F.col("dst").alias("_t")).distinct()
        pairs = scratch.save(pairs.join(tails, F.col("src") == F.col("_t"), "left_semi").join(heads, F.col("dst") == F.col("_h"), "left_semi"), "peel")
    return pairs


#: Most pairs whose strong components are left to one task.
ONE_TASK = 1 << 22


def _strong(batches):
    """(id, scc) of all nodes of the pairs (src, dst), by one search in depth."""
    table = pa.Table.from_batches(list(batches))
    ids, codes = ranked(pa.chunked_array([*table.column("src").chunks, *table.column("dst").chunks]))
    src, n = codes[: len(table)], len(ids)
    to, ends = codes[len(table) :][np.argsort(src, kind="stable")].tolist(), np.cumsum(np.bincount(src, minlength=n))
    next_, end = (ends - np.bincount(src, minlength=n)).tolist(), ends.tolist()
    order, low, part = [0] * n, [0] * n, [-1] * n
    open_, seen = [], 0
    for root in range(n):
        if order[root]:
            continue
        seen += 1
        order[root] = low[root] = seen
        open_.append(root)
        path = [root]
        while path:
            node, at = path[-1], next_[path[-1]]
            if at < end[node]:
                next_[node] = at + 1
                other = to[at]
                if not order[other]:
                    seen += 1
                    order[other] = low[other] = seen
                    open_.append(other)
                    path.append(other)
                elif part[other] < 0:
                    low[node] = min(low[node], order[other])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[node])
            if low[node] == order[node]:
                members = [open_.pop()]
                while members[-1] != node:
                    members.append(open_.pop())
                least = min(members)
                for x in members:
                    part[x] = least
    named = pa.array(ids, table.schema.field("src").type)
    yield from pa.table({"id": named, "scc": named.take(pa.array(part))}).to_batches(1 << 16)


def strong_components(nodes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, scc): the smallest node of each strongly connected component.

    At most ONE_TASK pairs are searched by one task, whatever their paths. Of more the nodes at the ends of
    paths are peeled off first, and the rest is solved by colours, until few enough are left: each node takes
    the smallest id that reaches it and the smallest id that it reaches, both in one pass; the nodes
    of which both are the same id form that id's component, and are taken out. Colours jump: a node
    also takes its colour's colour, so rounds grow with the logarithm of a path along which ids rise,
    and at worst with the path (a plain cycle, against its ids). No closure is built.
    """
    left, (rows,) = scratch.save_seen(pairs.where("src <> dst").select("src", "dst").distinct(), "pairs", F.count(F.lit(1)))
    if rows > ONE_TASK:
        left = _peel(left, scratch)
        rows = left.count()
    done: DataFrame | None = None
    while rows:
        if rows <= ONE_TASK:
            part = scratch.save(left.coalesce(1).mapInArrow(_strong, ", ".join(f"{c} {t}" for c, (_, t) in zip(("id", "scc"), left.dtypes))), "scc")
            done = part if done is None else done.unionByName(part)
            break
        ids = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()

        def spread_colours(state: DataFrame, left: DataFrame = left) -> DataFrame:
            f = left.join(state.select(F.col("id").alias("src"), F.col("f").alias("c")), "src").select(F.col("dst").alias("id"), F.col("c").alias("f"), F.lit(None).cast("string").alias("b"))
            b = left.join(state.select(F.col("id").alias("dst"), F.col("b").alias("c")), "dst").select(F.col("src").alias("id"), F.lit(None).cast("string").alias("f"), F.col("c").alias("b"))
            met = state.unionByName(f).unionByName(b).groupBy("id").agg(F.min("f").alias("f"), F.min("b").alias("b"))
            # what reaches my smallest ancestor reaches me
            far = met.join(met.select(F.col("id").alias("f"), F.col("f").alias("ff")), "f").join(met.select(F.col("id").alias("b"), F.col("b").alias("bb")), "b")
            return far.select("id", F.col("ff").alias("f"), F.col("bb").alias("b"))

        colour = fixpoint(scratch, ids.select("id", F.col("id").alias("f"), F.col("id").alias("b")), spread_colours, checksum("id", "f", "b"))
        part, (found,) = scratch.save_seen(colour.where("f = b").select("id", F.col("f").alias("scc")), "scc", F.count(F.lit(1)))
        if not found:
            break
        done = part if done is None else done.unionByName(part)
        # a component lies within one pair of colours
        rest = colour.where("f <> b")
        same = left.join(rest.select(F.col("id").alias("src"), F.struct("f", "b").alias("x")), "src").join(rest.select(F.col("id").alias("dst"), F.struct("f", "b").alias("y")), "dst").where("x = y")
        left, (rows,) = scratch.save_seen(same.select("src", "dst"), "left", F.count(F.lit(1)))
    if done is None:
        return nodes.select("id", F.col("id").alias("scc"))
    return nodes.select("id").join(done, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def cycle_lengths(pairs: DataFrame, scratch: Scratch, most: int = 8) -> DataFrame:
    """The length of the shortest closed walk through each node, up to ``most``: id, length."""
    pairs = trim(pairs, scratch)
    walk = pairs.select(F.col("src").alias("origin"), F.col("dst").alias("at"))
    found = None
    for step in range(1, most + 1):
        walk = scratch.save(walk, "walk")
        hit = walk.where("origin = at").select(F.col("origin").alias("id"), F.lit(step).alias("length"))
        found = hit if found is None else found.unionByName(hit)
        walk = walk.withColumnRenamed("at", "src").join(pairs, "src").select("origin", F.col("dst").alias("at")).distinct()
    return found.groupBy("id").agg(F.min("length").alias("length"))


def topological_levels(nodes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Kahn's peeling: id and level of every node not behind a cycle; others are left out."""
    left = scratch.save(pairs.where("src <> dst").select("src", "dst").distinct(), "left")
    rest = scratch.save(nodes.select("id"), "rest")
    out, level = None, 0
    while True:
        free = rest.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level))
        free, (rows,) = scratch.save_seen(free, "free", F.count(F.lit(1)))
        if not rows:
            break
        out = free if out is None else out.unionByName(free)
        level += 1
        if level % FOLD == 0:
            out = scratch.save(out, "levels")
        gone = free.select("id")
        rest = scratch.save(rest.join(gone, "id", "left_anti"), "rest")
        left = scratch.save(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti"), "left")
    return out if out is not None else nodes.select("id", F.lit(0).alias("level")).limit(0)


def acyclic(nodes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row: whether there is no cycle, self loops included. A cycle is a strong component of several nodes."""
    loops = pairs.where("src = dst").select(F.col("src").alias("scc")).distinct()
    several = strong_components(nodes, pairs, scratch).groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    return loops.unionByName(several).agg((F.count("*") == 0).alias("acyclic"))


def containment_ancestors(g: Graph, scratch: Scratch, depth: int | None = None) -> DataFrame:
    """Every (id, ancestor, depth) over ``contains`` edges, nearest first; a cycle of containers is gone round once."""
    up = g.edges.where("kind = 'contains' and src <> dst").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    up = scratch.save(up, "parents")
    level = up.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out = level = scratch.save(level, "up")
    d = 1
    while depth is None or d < depth:
        d += 1
        nxt = level.where("id <> ancestor").select("id", F.col("ancestor").alias("_a")).join(up.select(F.col("id").alias("_a"), "parent"), "_a")
        nxt = nxt.select("id", F.col("parent").alias("ancestor"), F.lit(d).alias("depth")).join(out.select("id", "ancestor"), ["id", "ancestor"], "left_anti")
        level, (rows,) = scratch.save_seen(nxt, "up", F.count(F.lit(1)))
        if not rows:
            break
        out = out.unionByName(level)
        if d % FOLD == 0:
            out = scratch.save(out, "up")
    return out


def pagerank(nodes: DataFrame, edges: DataFrame, scratch: Scratch, seeds: DataFrame | None = None, alpha: float = 0.15, rounds: int = 20) -> DataFrame:
    """Personalised PageRank after fixed rounds: id, score. Dangling mass goes back to the seeds.

    ``edges`` (src, dst) may repeat, which weighs them. Without seeds every node is one.
    """
    ids = nodes.select("id")
    start = ids if seeds is None else ids.join(seeds.select("id"), "id", "left_semi")
    n = start.count()
    home = ids.join(start.withColumn("_s", F.lit(1.0 / max(n, 1))), "id", "left").select("id", F.coalesce("_s", F.lit(0.0)).alias("home"))
    weights = edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    total = weights.groupBy("src").agg(F.sum("w").alias("t"))
    steps = scratch.save(weights.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("share")), "steps")
    home = home.join(total.withColumnRenamed("src", "id"), "id", "left").select("id", "home", F.col("t").isNull().alias("dangling"), F.col("home").alias("score"))
    # the mass of dangling nodes is summed up on the way of each write
    lost_mass = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0))
    state, (lost,) = scratch.save_seen(home, "score", lost_mass)
    for _ in range(rounds):
        sent = state.select(F.col("id").alias("src"), "score").join(steps, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = alpha * F.col("home") + (1 - alpha) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("home"))
        nxt = state.select("id", "home", "dangling").join(sent, "id", "left").select("id", "home", "dangling", score.alias("score"))
        state, (lost,) = scratch.save_seen(nxt, "score", lost_mass)
    return state.select("id", "score")


def wl_labels(g: Graph, scratch: Scratch, rounds: int = 1) -> DataFrame:
    """Weisfeiler-Leman refinement: id and label after ``rounds``, labels being digests of kind and neighbourhood."""
    labels = g.nodes.select("id", F.col("kind").alias("label"))
    for _ in range(rounds):
        out = g.edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.concat(F.lit(">"), "kind").alias("e"))
        back = g.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.concat(F.lit("<"), "kind").alias("e"))
        near = out.unionByName(back).join(labels.select(F.col("id").alias("other"), F.col("label").alias("l")), "other")
        # equal neighbours are counted first, so a hub carries distinct (edge, label) pairs only
        counts = near.groupBy("id", "e", "l").agg(F.count("*").alias("n"))
        sign = counts.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "e", "l", F.col("n").cast("string")))), ",").alias("s"))
        labels = scratch.save(labels.join(sign, "id", "left").select("id", F.md5(F.concat_ws("|", "label", F.coalesce("s", F.lit(""))).cast("binary")).alias("label")), "labels")
    return labels


def wl_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine of two label histograms; 0 if one is empty."""
    x = a.groupBy("label").agg(F.count("*").cast("double").alias("x"))
    y = b.groupBy("label").agg(F.count("*").cast("double").alias("y"))
    both = x.join(y, "label", "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))
    return both.agg(F.when(norm > 0, F.sum(F.col("x") * F.col("y")) / norm).otherwise(F.lit(0.0)).alias("cosine"))
