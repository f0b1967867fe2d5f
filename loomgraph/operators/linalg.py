"""Dense kernels for graphs of kernel size: spectra, trophic levels, articulation, k-means, clustering.

A dense decomposition needs its whole matrix in one place, so kernels run as ``applyInPandas`` over
a weak component each, and refuse more than ``MOST_NODES`` nodes. Beyond that there are forms by joins:
``summary_by_joins`` and ``moments_by_joins`` of a spectrum, ``heights_by_joins``, ``louvain_by_joins``,
and ``spectral.power_radius``. Vector operators (k-means steps, silhouette) are DataFrame aggregations and
have no such bound.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import motifs, sparse
from loomgraph.operators.blocks import Large, coded, decoded
from loomgraph.operators.components import distinct
from loomgraph.operators.sparse import MOST_PAIRS, Sparse, by_component, parted, parts, split
from loomgraph.operators.traversal import components
from loomgraph.plans.scratch import Scratch

MOST_NODES = 5000


def _matrix(rows: pd.DataFrame, directed: bool = False) -> tuple[list[str], np.ndarray]:
    ids = sorted(set(rows["src"]) | set(rows["dst"]))
    if len(ids) > MOST_NODES:
        raise ValueError(f"a dense kernel takes {MOST_NODES} nodes at most; this component has {len(ids)}")
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    i, j = rows["src"].map(at).to_numpy(), rows["dst"].map(at).to_numpy()
    np.add.at(a, (i, j), 1.0)
    if not directed:
        a = ((a + a.T) > 0).astype(float)
        np.fill_diagonal(a, 0)
    return ids, a


def per_component(g: Graph, scratch: Scratch, kernel, schema: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Run ``kernel(rows)`` on the edges (src, dst) of each weak component."""
    parts = scratch.save(components(g, scratch, kinds), "parts")
    edges = g.edges if kinds is None else g.edges.where(F.col("kind").isin(*kinds))
    edges = edges.where("src <> dst").select("src", "dst").join(parts.withColumnRenamed("id", "src"), "src")
    return edges.groupBy("component").applyInPandas(kernel, schema)


def laplacian_spectrum(g: Graph, scratch: Scratch) -> DataFrame:
    """Eigenvalues of the Laplacian of the undirected projection: component, k, eigenvalue.

    The spectrum of a graph is the union of its components' spectra; a single node has the value 0.
    """

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        _, a = _matrix(rows)
        values = np.maximum(np.linalg.eigvalsh(np.diag(a.sum(axis=1)) - a), 0)
        return pd.DataFrame({"component": rows["component"].iloc[0], "k": np.arange(1, len(values) + 1), "eigenvalue": values})

    found = per_component(g, scratch, kernel, "component string, k long, eigenvalue double")
    alone = g.nodes.select("id").join(g.edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")
    return found.unionByName(alone.select(F.col("id").alias("component"), F.lit(1).cast("long").alias("k"), F.lit(0.0).alias("eigenvalue")))


def spectral_summary(spectrum: DataFrame) -> DataFrame:
    """nodes, components (eigenvalues near 0), total (twice the edges), lambda2 and radius of a spectrum."""
    zeros = F.sum((F.col("eigenvalue") < 1e-9).cast("long"))
    # every component has the eigenvalue 0, so the second one is 0 unless there is one component
    second = F.when(zeros > 1, F.lit(0.0)).otherwise(F.min(F.when(F.col("eigenvalue") >= 1e-9, F.col("eigenvalue"))))
    return spectrum.agg(F.count("*").alias("nodes"), zeros.alias("components"), F.sum("eigenvalue").alias("total"), F.coalesce(second, F.lit(0.0)).alias("lambda2"), F.max("eigenvalue").alias("radius"))


def fits_kernel(g: Graph, scratch: Scratch) -> bool:
    """Whether every weak component has at most MOST_NODES nodes."""
    largest = components(g, scratch).groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= MOST_NODES


def summary_by_joins(g: Graph, scratch: Scratch) -> DataFrame:
    """nodes, components and total of the Laplacian's spectrum without decomposing it: one zero a component, and the trace."""
    parts = components(g, scratch).agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))
    return parts.crossJoin(F.broadcast(g.undirected().agg((2.0 * F.count("*")).alias("total"))))


def moments_by_joins(g: Graph, scratch: Scratch | None = None) -> DataFrame:
    """nodes, m1, m2, m3: sums of the Laplacian's eigenvalues and of their squares and cubes, from degrees and triangles."""
    nodes, m1 = g.nodes.agg(F.count("*").alias("nodes")), F.col("d1")
    sums = motifs.moments(g, scratch).select(m1.alias("m1"), (F.col("d2") + m1).alias("m2"), (F.col("d3") + 3 * F.col("d2") - 6 * F.col("t")).alias("m3"))
    return nodes.crossJoin(F.broadcast(sums))


def _by_size(g: Graph, scratch: Scratch) -> tuple[DataFrame, DataFrame, bool, bool]:
    """(src, dst, component) of the edges in components that fit a kernel and of those beyond, and whether there are any of each."""
    parts = scratch.save(components(g, scratch), "parts")
    large = scratch.save(parts.groupBy("component").agg(F.count("*").alias("n")).where((F.col("n") > 1)).select("component", (F.col("n") > MOST_NODES).alias("large")), "sizes")
    seen = large.agg(F.coalesce(F.min("large"), F.lit(True)).alias("all"), F.coalesce(F.max("large"), F.lit(False)).alias("any")).first()
    edges = g.edges.where("src <> dst").select("src", "dst").join(parts.join(large, "component").select(F.col("id").alias("src"), "component", "large"), "src")
    return edges.where("not large").drop("large"), edges.where("large").drop("large"), not seen["all"], seen["any"]


def trophic_levels(g: Graph, scratch: Scratch) -> DataFrame:
    """Heights h with L h = in - out for each weak component, the least being 0: id, height."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        ids, w = _matrix(rows, directed=True)
        inn, out = w.sum(axis=0), w.sum(axis=1)
        lap = np.diag(inn + out) - w - w.T
        h = np.zeros(len(ids))
        try:
            h[1:] = np.linalg.solve(lap[1:, 1:], (inn - out)[1:])
        except np.linalg.LinAlgError:
            h[:] = 0
        return pd.DataFrame({"id": ids, "height": h - h.min()})

    small, large, some, more = _by_size(g, scratch)
    found = small.groupBy("component").applyInPandas(kernel, "id string, height double") if some or not more else None
    if more:
        beyond = heights_by_joins(large, scratch)
        found = beyond if found is None else found.unionByName(beyond)
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("height", F.lit(0.0)).alias("height"))


def heights_by_joins(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``trophic_levels`` of whole components (src, dst, component), whatever their size: id, height.

    Ends of trees are taken off round by round, each handing what it has over to its only neighbour, which
    is exact and leaves nothing of a tree; what lies on cycles or between them is solved by conjugate
    gradients. Then the ends get their heights from their neighbours, the last ones first.
    """
    way = lambda a, b, sign: edges.select(F.col(a).alias("id"), F.col(b).alias("other"), F.lit(sign).alias("net"), "component")
    near = way("src", "dst", -1.0).unionByName(way("dst", "src", 1.0))
    near = scratch.save(near.groupBy("component", "id", "other").agg(F.sum("net").alias("net"), F.count("*").cast("double").alias("w")), "near")
    part = scratch.save(near.groupBy("component", "id").agg(F.sum("net").alias("b")), "part")
    left, near, taken = part.select("id", "b"), near.select("id", "other", "w"), []
    while True:
        ends = near.groupBy("id").agg(F.count("*").alias("n"), F.max("other").alias("up"), F.max("w").alias("w")).where("n = 1").drop("n")
        ends = scratch.save(ends, "ends")
        # of two that have only each other the smaller stays
        facing = ends.select(F.col("up").alias("id"), F.col("id").alias("up")).join(ends.select("id", "up"), ["id", "up"]).where("id < up")
        ends, (some,) = scratch.save_seen(ends.join(facing.select("id"), "id", "left_anti").join(left, "id"), "ends", F.count(F.lit(1)))
        if not some:
            break
        taken.append(ends)
        ids, given = ends.select("id"), ends.groupBy(F.col("up").alias("id")).agg(F.sum("b").alias("g"))
        near = scratch.save(near.join(ids, "id", "left_anti").join(ids.withColumnRenamed("id", "other"), "other", "left_anti"), "near")
        left = scratch.save(left.join(ids, "id", "left_anti").join(given, "id", "left").select("id", (F.col("b") + F.coalesce("g", F.lit(0.0))).alias("b")), "left")
    heights = scratch.save(_solved(near.select("id", "other", "w"), left, scratch), "heights")
    for ends in reversed(taken):
        placed = ends.join(heights.select(F.col("id").alias("up"), F.col("h").alias("base")), "up").select("id", (F.col("base") + F.col("b") / F.col("w")).alias("h"))
        heights = scratch.save(heights.unionByName(placed), "heights")
    found = heights.join(part.select("id", "component"), "id")
    least = found.groupBy("component").agg(F.min("h").alias("least"))
    return found.join(least, "component").select("id", (F.col("h") - F.col("least")).alias("height"))


def _solved(near: DataFrame, right: DataFrame, scratch: Scratch, exact: float = 1e-12, patience: int = 50) -> DataFrame:
    """(id, h) with the Laplacian of ``near`` (id, other, w) times h being ``right`` (id, b), by preconditioned conjugate gradients as joins.

    Rounds end at a residual of ``exact`` of the first, or where rounding keeps it from getting any smaller.
    """
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    degree = near.groupBy("id").agg(F.sum("w").alias("d"))
    first = right.join(degree, "id", "left").select("id", F.lit(0.0).alias("h"), F.when(F.col("d").isNull(), 0.0).otherwise(F.col("b")).alias("r"), F.coalesce("d", F.lit(1.0)).alias("d"))
    first = first.select("*", (F.col("r") / F.col("d")).alias("p"))
    state, (rho, start) = scratch.save_seen(first, "state", dot("r", "p"), F.sum(F.col("r") * F.col("r")))
    best, waited = start or 0.0, 0
    while rho and best > exact * exact * start and waited < patience:
        pulled = near.join(state.select(F.col("id").alias("other"), F.col("p").alias("q")), "other").groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("s"))
        step = state.join(pulled, "id", "left").withColumn("lp", F.when(F.col("s").isNull(), 0.0).otherwise(F.col("d") * F.col("p") - F.col("s"))).drop("s")
        step, (along,) = scratch.save_seen(step, "step", dot("p", "lp"))
        if not along or along <= 0:
            break
        alpha = rho / along
        moved = step.select("id", (F.col("h") + alpha * F.col("p")).alias("h"), (F.col("r") - alpha * F.col("lp")).alias("r"), "d", "p")
        now, size = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r"))).first()
        scratch.drop(state)
        state = scratch.save(moved.select("id", "h", "r", "d", (F.col("r") / F.col("d") + now / rho * F.col("p")).alias("p")), "state")
        scratch.drop(step)
        best, waited, rho = (size, 0, now) if size < best else (best, waited + 1, now)
    return state.select("id", "h")


def trophic_incoherence(g: Graph, heights: DataFrame) -> DataFrame:
    """the mean of (h(dst) - h(src) - 1)^2 over the edges."""
    rows = g.edges.where("src <> dst").join(heights.select(F.col("id").alias("src"), F.col("height").alias("hs")), "src").join(heights.select(F.col("id").alias("dst"), F.col("height").alias("hd")), "dst")
    return rows.agg(F.coalesce(F.avg(F.pow(F.col("hd") - F.col("hs") - 1, 2)), F.lit(0.0)).alias("f0"), F.sum((F.col("hs") - F.col("hd") > 0.5).cast("long")).alias("backward"))


def pairs_by_component(g: Graph, scratch: Scratch) -> DataFrame:
    """(component, a, b): the undirected projection with each pair's weak component."""
    return by_component(g.undirected(), scratch)


def certificate(s: Sparse) -> np.ndarray:
    """The pairs of two forests, the first breadth-first and the second of what it leaves: the same nodes cut them, also together with other pairs."""
    one = s.forest()
    rest = np.flatnonzero(~one)
    return np.concatenate([np.flatnonzero(one), rest[Sparse(s.n, s.a[rest], s.b[rest]).forest()]])


def cut_vertices(s: Sparse) -> dict[int, int]:
    """The cut vertices of a connected graph, each with the size of the largest part it cuts off from the first node.

    Two breadth-first forests, the second of what the first leaves, have the same parts as the graph
    whichever node is taken out, so the search in depth has two pairs a node to look at at most.
    """
    if len(s.a) > 2 * s.n:
        kept = certificate(s)
        s = Sparse(s.n, s.a[kept], s.b[kept])
    # arrays of numbers take a fourth of what lists of them do
    held = lambda x: array("q", np.asarray(x, np.int64).tobytes())
    start, to, next_ = held(s.start), held(s.to), held(s.start[:-1])
    order, low, size = held(np.full(s.n, -1)), held(np.zeros(s.n)), held(np.ones(s.n))
    best: dict[int, int] = {}
    stack, children, seen = [(0, -1)], 0, 1
    order[0] = 0
    while stack:
        node, up = stack[-1]
        at, end = next_[node], start[node + 1]
        while at < end:
            other = to[at]
            at += 1
            if order[other] < 0:
                order[other] = low[other] = seen
                seen += 1
                stack.append((other, node))
                break
            if other != up and order[other] < low[node]:
                low[node] = order[other]
        else:
            stack.pop()
            if up < 0:
                continue
            size[up] += size[node]
            low[up] = min(low[up], low[node])
            children += up == 0
            # the root's first subtree doesn't count: it cuts only from its second child on
            if low[node] >= order[up] and (up or children > 1):
                best[up] = max(best.get(up, 0), size[node])
            continue
        next_[node] = at
    return best


def articulation_points(g: Graph, scratch: Scratch, least: int = 1) -> DataFrame:
    """Cut vertices of the undirected projection and the size of the largest part each one guards.

    Of a large component of groups each task sends two forests of its pairs; two tasks' are made one's, until one task has them all.
    """

    def kernel(table: pa.Table) -> pa.Table:
        s = Sparse.of(table)
        best = cut_vertices(s)
        return pa.table({"id": pa.array([s.ids[x] for x in best], pa.string()), "guarded": pa.array(list(best.values()), pa.int64())})

    if g.groups is None:
        found = parts(g, scratch).groupBy("component").applyInArrow(kernel, "id string, guarded long")
    else:
        small, large = parted(g, scratch, sparse.MOST_PAIRS)
        found = small.groupBy("component").applyInArrow(kernel, "id string, guarded long")
        if large is not None:
            found = found.unionByName(_cut_large(large, scratch))
    return found.where(F.col("guarded") >= least)


def _cut_large(of: Large, scratch: Scratch) -> DataFrame:
    """``articulation_points`` of large components."""
    n, schema = of.nodes, "part int, task int, body binary"

    def row(part: int, task: int, s: Sparse, ids: np.ndarray) -> pa.Table:
        kept = certificate(s)
        body = coded(np.sort(ids[s.a[kept]] * n + ids[s.b[kept]]))
        return pa.table({"part": pa.array([part], pa.int32()), "task": pa.array([task], pa.int32()), "body": pa.array([body], pa.binary())})

    def read(bodies: pa.Table) -> tuple[Sparse, np.ndarray]:
        keys = distinct(np.concatenate([np.empty(0, np.int64), *(decoded(x.as_buffer()) for x in bodies.column("body"))]))
        a, b = keys // n, keys % n
        ids = distinct(np.concatenate([a, b]))
        return Sparse(len(ids), np.searchsorted(ids, a), np.searchsorted(ids, b)), ids

    def merged(key, bodies):
        return row(key[0].as_py(), key[1].as_py(), *read(bodies))

    def cut(key, bodies):
        s, ids = read(bodies)
        best = cut_vertices(s)
        return pa.table({"number": pa.array([int(ids[x]) for x in best], pa.int64()), "guarded": pa.array(list(best.values()), pa.int64())})

    found = scratch.save(of.mapped(lambda part, task, ids, a, b: row(part, task, Sparse(len(ids), a, b), ids), schema), "forests")
    while found.agg(F.max("task")).first()[0]:
        two = found.select("part", F.floor(F.col("task") / 2).cast("int").alias("task"), "body")
        found = scratch.save(two.groupBy("part", "task").applyInArrow(merged, schema), "forests")
    return found.groupBy("part").applyInArrow(cut, "number long, guarded long").join(of.names, "number").select("id", "guarded")


def eigen_centrality(g: Graph, scratch: Scratch, rounds: int = 100) -> DataFrame:
    """Exactly ``rounds`` power iterations from a uniform start in each component: id, centrality."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        ids, a = _matrix(rows)
        x = np.full(len(ids), 1 / np.sqrt(len(ids)))
        for _ in range(rounds):
            y = a @ x
            n = np.linalg.norm(y)
            if n == 0:
                break
            x = y / n
        return pd.DataFrame({"id": ids, "centrality": np.abs(x)})

    return per_component(g, scratch, kernel, "id string, centrality double")


def communities(s: Sparse, passes: int = 20, resolution: float = 1.0) -> np.ndarray:
    """Each node's community by greedy modularity in fixed node order, the best of its neighbours' communities, its own and an empty one."""
    i, j = np.concatenate([s.a, s.b]), np.concatenate([s.b, s.a])
    w, n, member = np.ones(len(i)), s.n, np.arange(s.n)
    m2 = w.sum()
    while True:
        order = np.lexsort((j, i))
        i, j, w = i[order], j[order], w[order]
        start, degree = np.searchsorted(i, np.arange(n + 1)).tolist(), np.bincount(i, w, n)
        away = np.where(i == j, 0.0, w)
        label, total, size = np.arange(n), degree.copy(), np.ones(n, np.int64)
        moved_any = False
        for _ in range(passes):
            moved = False
            for x in range(n):
                own, d = label[x], degree[x]
                total[own] -= d
                size[own] -= 1
                at = slice(start[x], start[x + 1])
                near, back = np.unique(np.append(label[j[at]], own), return_inverse=True)
                links = np.bincount(back, np.append(away[at], 0.0))
                gain = links - resolution * total[near] * d / m2
                top, stay = gain.argmax(), gain[back[-1]]
                best = near[top] if gain[top] > stay + 1e-12 else own
                if gain[top] < 0 and 0 > stay + 1e-12:
                    best = int((size == 0).argmax())
                moved |= bool(best != own)
                label[x] = best
                total[best] += d
                size[best] += 1
            moved_any |= moved
            if not moved:
                break
        if not moved_any:
            return member
        found, label = np.unique(label, return_inverse=True)
        n, member = len(found), label[member]
        key, back = np.unique(label[i] * n + label[j], return_inverse=True)
        i, j, w = key // n, key % n, np.bincount(back, w)


def louvain(g: Graph, scratch: Scratch, passes: int = 20, resolution: float = 1.0) -> DataFrame:
    """Communities by greedy modularity in fixed node order: id, community (its smallest member). A higher resolution gives smaller ones.

    A component of at most MOST_PAIRS pairs is one task's work; larger ones go by joins, and a node without
    neighbours is its own community.
    """

    def kernel(table: pa.Table) -> pa.Table:
        s = Sparse.of(table)
        member = communities(s, passes, resolution)
        first = dict(zip(reversed(member.tolist()), reversed(s.ids)))
        return pa.table({"id": pa.array(s.ids, pa.string()), "community": pa.array([first[c] for c in member.tolist()], pa.string())})

    small, large = split(pairs_by_component(g, scratch), scratch, MOST_PAIRS)
    found = small.groupBy("component").applyInArrow(kernel, "id string, community string")
    if large is not None:
        edges = large.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        found = found.unionByName(louvain_by_joins(Graph(ids, edges), scratch, resolution, passes))
    return g.nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def louvain_by_joins(g: Graph, scratch: Scratch, resolution: float = 1.0, passes: int = 20) -> DataFrame:
    """Communities by greedy modularity, whatever the size: id, community (its smallest member).

    Every round computes each node's best community from sums over (node, community) and moves half of
    the nodes, by hash, that gain by it; after a pass communities become the nodes of a smaller weighted
    graph, until a pass moves nothing. Moves are made side by side, so the parts may differ from the
    sequential ones.
    """
    near = g.neighbours().select(F.col("id").alias("a"), F.col("other").alias("b"), F.lit(1.0).alias("w"))
    near = scratch.save(near, "near")
    total = near.agg(F.sum("w")).first()[0] or 0.0
    member = scratch.save(g.nodes.select("id", F.col("id").alias("c")), "member")
    while total:
        degree = scratch.save(near.groupBy("a").agg(F.sum("w").alias("d")), "degree")
        own = scratch.save(degree.select("a", "d", F.col("a").alias("c")), "own")
        any_moved = False
        for turn in range(passes):
            links = near.where("a <> b").join(own.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("k"))
            sums = own.groupBy("c").agg(F.sum("d").alias("t"))
            here = own.select("a", "d", F.col("c").alias("old"))
            stay = own.select("a", "c", F.lit(0.0).alias("k"))  # a node may have no link into its own community
            options = links.unionByName(stay).groupBy("a", "c").agg(F.sum("k").alias("k")).join(here, "a").join(sums, "c")
            rest = F.col("t") - F.when(F.col("c") == F.col("old"), F.col("d")).otherwise(0.0)
            gain = F.col("k") - resolution * F.col("d") * rest / F.lit(total)
            best = options.withColumn("gain", gain).groupBy("a").agg(F.max(F.when(F.col("c") == F.col("old"), F.col("gain"))).alias("now"), F.min(F.struct((-F.col("gain")).alias("g"), "c")).alias("b"), F.first("old").alias("old"), F.first("d").alias("d"))
            better = -F.col("b.g") > F.col("now") + 1e-12
            turns = F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0
            after = best.select("a", "d", F.when(better & turns, F.col("b.c")).otherwise(F.col("old")).alias("c"), (better & turns).cast("long").alias("moved"), better.cast("long").alias("would"))
            after, (moved, would) = scratch.save_seen(after, "own", F.sum("moved"), F.sum("would"))
            own = after.select("a", "d", "c")
            any_moved |= bool(moved)
            if not would:
                break
        if not any_moved:
            break
        member = scratch.save(member.join(own.select(F.col("a").alias("c"), F.col("c").alias("n")), "c", "left").select("id", F.coalesce("n", "c").alias("c")), "member")
        ends = near.join(own.select("a", F.col("c").alias("x")), "a").join(own.select(F.col("a").alias("b"), F.col("c").alias("y")), "b")
        near = scratch.save(ends.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "near")
    first = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(first, "c").select("id", "community")


def spectral_bisection(g: Graph, scratch: Scratch) -> DataFrame:
    """The sides of each component by the sign of the Fiedler vector: id, side of its smallest member first."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        ids, a = _matrix(rows)
        _, vectors = np.linalg.eigh(np.diag(a.sum(axis=1)) - a)
        side = vectors[:, 1] >= 0 if len(ids) > 1 else np.array([True])
        return pd.DataFrame({"id": ids, "side": (side != side[0]).astype(int)})

    return per_component(g, scratch, kernel, "id string, side int")


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, vec, cluster of the nearest centroid (cluster, centroid); ties go to the smallest cluster.

    Centroids are k rows that a caller chose, hence broadcast.
    """
    rows = vectors.crossJoin(F.broadcast(centroids)).withColumn("d", squared_distance("vec", "centroid"))
    return rows.groupBy("id").agg(F.min(F.struct("d", "cluster")).alias("best"), F.first("vec").alias("vec")).select("id", "vec", F.col("best.cluster").alias("cluster"), F.col("best.d").alias("distance"))


def kmeans(vectors: DataFrame, k: int, scratch: Scratch, rounds: int = 10) -> DataFrame:
    """Deterministic Lloyd iterations from the first k ids; an empty cluster keeps its centroid."""
    from pyspark.sql.window import Window

    first = vectors.orderBy("id").limit(k)
    centroids = scratch.save(first.select((F.row_number().over(Window.orderBy("id")) - 1).alias("cluster"), F.col("vec").alias("centroid")), "centroids")
    for _ in range(rounds):
        placed = nearest_centroid(vectors, centroids)
        cells = placed.select("cluster", F.posexplode("vec").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
        means = cells.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
        centroids = scratch.save(centroids.join(means, "cluster", "left").select("cluster", F.coalesce("mean", "centroid").alias("centroid")), "centroids")
    return nearest_centroid(vectors, centroids)


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def parse_vector(text):
    """Floats separated by commas or spaces; null if any token is no number."""
    parts = F.split(F.trim(F.regexp_replace(text, "[,\\s]+", " ")), " ")
    values = F.transform(parts, lambda t: t.try_cast("double"))
    return F.when(F.exists(values, lambda v: v.isNull()), F.lit(None)).otherwise(values)
