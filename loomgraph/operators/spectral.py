"""Spectral reports, choices of k, k-means seedings, silhouettes, spectral and semantic clusters, local partition.

What is asked of a list of numbers (a spectrum, a row of gaps) is plain numpy on the driver, since a
list is read by people. Decompositions run on a weak component each, like the kernels of ``linalg``;
vectors are compared by sums over clusters where that is possible, and local partition is joins over
residuals, however large the graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.graph import Graph
from loomgraph.operators import linalg
from loomgraph.operators.statistics import sweep_cut
from loomgraph.plans.scratch import Scratch

ZERO = 1e-9


# --- lists of numbers -------------------------------------------------------------------------


def eigengap(values: list[float], most: int) -> tuple[int, float]:
    """(k, ratio): where the next value is the largest multiple of the one before, zeros left out; (2, 0) without one."""
    n = len(values)
    if n < 3:
        return 2, 0.0
    best = (2, 0.0)
    last = min(max(most, 2), n - 1)
    for i, (low, high) in enumerate(zip(values, values[1:]), start=1):
        if i > last:
            break
        if low > ZERO and high / low > best[1]:
            best = (i, high / low)
    return best


def knee(values: list[float]) -> int:
    """How many of a falling list come before it flattens: the place farthest from the chord of its ends."""
    n = len(values)
    if n <= 2:
        return n
    y = np.asarray(values, float)
    x = np.arange(n)
    away = np.abs((n - 1) * (y[0] - y) + x * (y[-1] - y[0]))[1:-1]
    return int(away.argmax()) + 2 if np.hypot(n - 1, y[-1] - y[0]) else 1


def gap_candidates(values: list[float], first: int = 20, most: int = 6) -> list[tuple[int, float, float, str]]:
    """(k, gap, ratio, confidence) of the widest gaps among the first values, the widest first; a gap against the mean one makes its confidence."""
    start = next((i for i, v in enumerate(values) if v > ZERO), 0)
    if len(values) < 2 or start >= len(values) - 1:
        return []
    window = values[:first]
    gaps = [(i + 1, b - a, b / a if a > ZERO else 0.0) for i, (a, b) in enumerate(zip(window, window[1:])) if i >= start]
    if not gaps:
        return []
    mean = sum(g for _, g, _ in gaps) / len(gaps)
    confidence = lambda g: "strong" if mean > 0 and g > 3.0 * mean else "moderate" if mean > 0 and g > 1.8 * mean else "weak"
    return [(k, round(g, 4), round(r, 4), confidence(g)) for k, g, r in sorted(gaps, key=lambda x: (-x[1], x[0]))[:most]]


# --- seedings and k-means ---------------------------------------------------------------------


def farthest_first(x: np.ndarray, k: int, first: int) -> np.ndarray:
    """Rows of the seeds: ``first``, then each time the row farthest from all chosen."""
    chosen = [first]
    away = ((x - x[first]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def seeds(x: np.ndarray, k: int, how: str) -> np.ndarray:
    """Rows that k-means starts from: ``norm`` (the longest row, then farthest), ``index`` (row 0, then farthest), ``spread`` (every n/k-th row)."""
    if how == "spread":
        return np.arange(k) * len(x) // k
    return farthest_first(x, k, int((x**2).sum(axis=1).argmax()) if how == "norm" else 0)


#: Most rounds of Lloyd's steps by seeding.
ROUNDS = {"norm": 100, "index": 20, "spread": 50}


def lloyd(x: np.ndarray, k: int, how: str) -> np.ndarray:
    """Deterministic k-means labels; an empty cluster keeps its centre, and k of n or more gives each row its own."""
    if k >= len(x):
        return np.arange(len(x))
    centres, labels = x[seeds(x, k, how)].astype(float), None
    for _ in range(ROUNDS[how]):
        now = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if labels is not None and (now == labels).all():
            break
        labels = now
        for c in range(k):
            if (labels == c).any():
                centres[c] = x[labels == c].mean(axis=0)
    return labels


def silhouette_of(x: np.ndarray, labels: np.ndarray) -> float:
    """The mean of (b - a) / max(a, b) over rows; a single row's a is 0, and a row without another cluster counts 0."""
    n = len(x)
    if n < 2:
        return 0.0
    away = np.sqrt(np.maximum(((x[:, None, :] - x[None]) ** 2).sum(axis=2), 0))
    total = 0.0
    for i in range(n):
        same = labels == labels[i]
        a = away[i, same].sum() / max(same.sum() - 1, 1)
        others = [away[i, labels == c].mean() for c in np.unique(labels) if c != labels[i]]
        if others and max(a, min(others)) > 0:
            total += (min(others) - a) / max(a, min(others))
    return total / n


def silhouette(vectors: DataFrame, scratch: Scratch, chunk: int = 1024) -> DataFrame:
    """One row with the mean silhouette of ``vectors`` (id, vec, cluster), by exact distances.

    Rows are dealt into chunks, and each pair of chunks is one task's work, which returns a sum for
    each row and cluster: no pair of rows leaves a task.
    """
    rows = scratch.save(vectors.select("id", "vec", "cluster"), "vectors")
    n = rows.count()
    parts = max(1, -(-n // chunk))
    placed = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    pairs = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("o")).select("id", "vec", "cluster", F.col("c").alias("own"), F.col("o").alias("other"), F.lit(0).alias("side"))
    met = pairs.unionByName(placed.select("id", "vec", "cluster", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("own"), F.col("c").alias("other"), F.lit(1).alias("side")))
    kind = vectors.schema["cluster"].dataType.simpleString()

    def sums(block: pd.DataFrame) -> pd.DataFrame:
        a, b = block[block["side"] == 0], block[block["side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "mine": [], "cluster": [], "total": [], "n": []})
        x, y = np.stack(a["vec"].to_list()), np.stack(b["vec"].to_list())
        away = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
        out = []
        for c, where in b.groupby("cluster").indices.items():
            out.append(pd.DataFrame({"id": a["id"].to_numpy(), "mine": a["cluster"].to_numpy(), "cluster": c, "total": away[:, where].sum(axis=1), "n": len(where)}))
        return pd.concat(out)

    key = vectors.schema["id"].dataType.simpleString()
    found = met.groupBy("own", "other").applyInPandas(sums, f"id {key}, mine {kind}, cluster {kind}, total double, n long")
    per = found.groupBy("id", "mine", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same = F.col("mine") == F.col("cluster")
    each = per.groupBy("id").agg(
        F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b")
    ).withColumn("a", F.coalesce("a", F.lit(0.0)))
    most = F.greatest("a", "b")
    value = F.when(F.col("b").isNotNull() & (most > 0), (F.col("b") - F.col("a")) / most).otherwise(F.lit(0.0))
    return each.agg(F.avg(value).alias("silhouette"), F.count("*").alias("n"))


def semantic_clusters(vectors: DataFrame, most: int = 8, bound: int = linalg.MOST_NODES) -> DataFrame:
    """(id, cluster, k, silhouette) of ``vectors`` (id, vec) for the k of 2 to ``most`` whose k-means has the best silhouette.

    Up to ``bound`` vectors are a kernel's work, more go by passes over their table; fewer than two are too few.
    """
    rows = vectors.where("vec is not null").orderBy("id").limit(bound + 1).toPandas()
    if len(rows) < 2:
        raise ValueError(f"semantic clusters take 2 vectors or more; there are {len(rows)}")
    if len(rows) > bound:
        return clusters_by_passes(vectors, Scratch(vectors.sparkSession), most)
    x = np.stack(rows["vec"].to_list())
    best = max(((silhouette_of(x, labels := lloyd(x, k, "spread")), -k, labels) for k in range(2, min(most, len(x) - 1) + 1)), key=lambda t: t[:2], default=(0.0, -1, np.zeros(len(x), int)))
    out = pd.DataFrame({"id": rows["id"], "cluster": best[2].astype(int), "k": -best[1], "silhouette": float(best[0])})
    key = vectors.schema["id"].dataType.simpleString()
    return vectors.sparkSession.createDataFrame(out, f"id {key}, cluster long, k long, silhouette double")


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def clusters_by_passes(vectors: DataFrame, scratch: Scratch, most: int = 8, chunk: int = 2048) -> DataFrame:
    """``semantic_clusters``, whatever their number: each round of all k-means is one pass that returns sums by centre; silhouettes are exact."""
    rows = scratch.save(vectors.where("vec is not null").select("id", "vec"), "vectors")
    n = rows.count()
    ks = range(2, min(most, n - 1) + 1)
    at = {k: [c * n // k for c in range(k)] for k in ks}
    wanted = sorted({i for places in at.values() for i in places})
    first = rows.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("row")).where(F.col("row").isin(wanted)).join(rows, "id").collect()
    start = {r["row"]: np.asarray(r["vec"], float) for r in first}
    centres = {k: np.stack([start[i] for i in at[k]]) for k in ks}
    used, moving = dict(centres), list(ks)

    def sums(batches):
        for batch in batches:
            x = np.stack(batch["vec"].to_list()) if len(batch) else np.empty((0, 1))
            for k in moving if len(x) else ():
                labels = _nearest(x, centres[k])
                for c in np.unique(labels):
                    yield pd.DataFrame({"k": [k], "c": [c], "n": [(labels == c).sum()], "total": [x[labels == c].sum(axis=0)]})

    for _ in range(ROUNDS["spread"]):
        if not moving:
            break
        found = rows.mapInPandas(sums, "k long, c long, n long, total array<double>").collect()  # a row a centre and batch
        after = {k: centres[k].copy() for k in moving}
        cells: dict[tuple[int, int], list] = {}
        for r in found:
            cells.setdefault((r["k"], r["c"]), []).append((np.asarray(r["total"]), r["n"]))
        for (k, c), parts in cells.items():
            after[k][c] = sum(t for t, _ in parts) / sum(m for _, m in parts)
        used |= {k: centres[k] for k in moving}
        moving = [k for k in moving if not (after[k] == centres[k]).all()]
        centres = centres | after

    def placed(k: int) -> DataFrame:
        own = used[k]

        def label(batches):
            for batch in batches:
                if len(batch):
                    yield batch.assign(cluster=_nearest(np.stack(batch["vec"].to_list()), own))

        return rows.mapInPandas(label, f"id {vectors.schema['id'].dataType.simpleString()}, vec array<double>, cluster long")

    scores = {k: silhouette(placed(k), scratch, chunk).first()["silhouette"] for k in ks}
    k = max(ks, key=lambda x: (scores[x], -x))
    return placed(k).select("id", "cluster", F.lit(k).cast("long").alias("k"), F.lit(float(scores[k])).alias("silhouette"))


# --- spectra ----------------------------------------------------------------------------------


def _undirected(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    return linalg._matrix(rows)


def laplacian(a: np.ndarray, normalised: bool) -> np.ndarray:
    degree = a.sum(axis=1)
    if not normalised:
        return np.diag(degree) - a
    scale = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1)), 0)
    return np.diag((degree > 0).astype(float)) - scale[:, None] * a * scale[None, :]


def decomposition(g: Graph, scratch: Scratch, normalised: bool = False) -> DataFrame:
    """component, k, eigenvalue and the eigenvector's entry at each node: (component, k, eigenvalue, id, entry)."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        ids, a = _undirected(rows)
        values, vectors = np.linalg.eigh(laplacian(a, normalised))
        n = len(ids)
        return pd.DataFrame({"component": rows["component"].iloc[0], "k": np.repeat(np.arange(1, n + 1), n), "eigenvalue": np.repeat(np.maximum(values, 0), n), "id": ids * n, "entry": vectors.T.ravel()})

    return linalg.per_component(g, scratch, kernel, "component string, k long, eigenvalue double, id string, entry double")


def moments(spectrum: DataFrame) -> DataFrame:
    """nodes and the sums of the eigenvalues, their squares and cubes: what a spectrum has in common with its matrix's traces."""
    v = F.col("eigenvalue")
    return spectrum.agg(F.count("*").alias("nodes"), F.sum(v).alias("m1"), F.sum(v * v).alias("m2"), F.sum(v * v * v).alias("m3"))


def modularity_of(a: np.ndarray, labels: np.ndarray) -> float:
    m2 = a.sum()
    if not m2:
        return 0.0
    degree = a.sum(axis=1)
    return float(sum(a[np.ix_(labels == c, labels == c)].sum() / m2 - (degree[labels == c].sum() / m2) ** 2 for c in np.unique(labels)))


def modularity_at(a: np.ndarray, vectors: np.ndarray, k: int) -> float:
    """Q of the embedding's k parts: the Fiedler vector's signs for two, k-means of k - 1 columns from three."""
    if k <= 1 or not len(a):
        return 0.0
    labels = (vectors[:, 1] >= 0).astype(int) if k == 2 else lloyd(vectors[:, 1:k], k, "index")
    return modularity_of(a, labels)


def report(g: Graph, scratch: Scratch, most: int = 10) -> DataFrame:
    """A row for each component: nodes, lambda2, gap_k, gap_ratio, knee, q (at the gap's k), eigenvalues and singular values of the adjacency as lists."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        _, a = _undirected(rows)
        values, vectors = np.linalg.eigh(laplacian(a, False))
        values = np.maximum(values, 0)
        k, ratio = eigengap(values.tolist(), most)
        singular = np.linalg.svd(a, compute_uv=False)
        out = {"component": rows["component"].iloc[0], "nodes": len(a), "lambda2": values[1] if len(a) > 1 else 0.0, "gap_k": k, "gap_ratio": ratio, "knee": knee(singular.tolist()), "q": modularity_at(a, vectors, k)}
        return pd.DataFrame([out | {"eigenvalues": values.tolist(), "singular_values": singular.tolist()}])

    return linalg.per_component(g, scratch, kernel, "component string, nodes long, lambda2 double, gap_k long, gap_ratio double, knee long, q double, eigenvalues array<double>, singular_values array<double>")


#: Share of the Fiedler entries' deviation below which a node is on the boundary.
BOUNDARY = 0.2


def clusters(g: Graph, scratch: Scratch, k: int | None = None) -> DataFrame:
    """(id, component, cluster, k, q, boundary) by the normalised embedding; without k the candidate of best modularity.

    Rows of the embedding have length 1; k-means starts from the longest row and goes on farthest
    first. A node is on the boundary if its Fiedler entry is small.
    """

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        ids, a = _undirected(rows)
        values, vectors = np.linalg.eigh(laplacian(a, True))
        tries = [k] if k else [c[0] for c in gap_candidates(np.maximum(values, 0).tolist()) if 2 <= c[0] < len(ids)] or [min(2, len(ids))]
        best = None
        for n in tries:
            x = vectors[:, :n]
            length = np.linalg.norm(x, axis=1, keepdims=True)
            labels = lloyd(np.where(length > 0, x / np.maximum(length, 1e-300), 0), n, "norm")
            q = modularity_of(a, labels)
            if best is None or q > best[0] + 1e-12:
                best = (q, n, labels)
        q, n, labels = best
        first = {c: ids[int(np.flatnonzero(labels == c)[0])] for c in np.unique(labels)}
        fiedler = vectors[:, 1] if len(ids) > 1 else np.zeros(len(ids))
        edge = np.abs(fiedler) < BOUNDARY * fiedler.std()
        return pd.DataFrame({"id": ids, "component": rows["component"].iloc[0], "cluster": [first[c] for c in labels], "k": n, "q": q, "boundary": edge})

    return linalg.per_component(g, scratch, kernel, "id string, component string, cluster string, k long, q double, boundary boolean")


# --- by joins, whatever the size --------------------------------------------------------------


def power_radius(g: Graph, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """One row, radius: the largest Laplacian eigenvalue by ``rounds`` power steps as joins, for graphs beyond a kernel's size."""
    near = scratch.save(g.neighbours(), "near")
    degree = scratch.save(near.groupBy("id").agg(F.count("*").cast("double").alias("d")), "degree")
    x = degree.select("id", "d", F.rand(1).alias("x"))
    x = scratch.save(x, "x")
    for _ in range(rounds):
        pulled = near.join(x.select(F.col("id").alias("other"), F.col("x").alias("y")), "other").groupBy("id").agg(F.sum("y").alias("s"))
        step = x.join(pulled, "id").select("id", "d", "x", (F.col("d") * F.col("x") - F.col("s")).alias("lx"))
        step, (size, along) = scratch.save_seen(step, "lx", F.sqrt(F.sum(F.col("lx") * F.col("lx"))), F.sum(F.col("x") * F.col("lx")) / F.sum(F.col("x") * F.col("x")))
        x = step.select("id", "d", (F.col("lx") / F.lit(size or 1.0)).alias("x"))
    return g.nodes.sparkSession.range(1).select(F.lit(float(along or 0.0)).alias("radius"))


def push_pagerank(g: Graph, starts: DataFrame, scratch: Scratch, alpha: float = 0.15, epsilon: float = 1e-5, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Approximate personalised PageRank by pushes: id, mass, degree of the nodes that got any.

    Every round pushes all nodes whose residual is above ``epsilon`` times their degree: a share
    ``alpha`` stays as mass, half of the rest stays as residual and half goes to the neighbours. What
    is touched is bounded by 1 / (epsilon alpha), whatever the graph; a node without neighbours keeps
    its share once.
    """
    near = scratch.save(g.neighbours(kinds), "near")
    degree = scratch.save(g.nodes.select("id").join(near.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")), "degree")
    first = starts.select("id").distinct().join(degree, "id")
    n = first.count()
    state = scratch.save(first.select("id", "degree", F.lit(0.0).alias("mass"), F.lit(1.0 / max(n, 1)).alias("rest"), F.lit(True).alias("hot")), "state")
    hot = n
    while hot:
        active = state.where("hot")
        spread = (1 - alpha) / 2
        sent = active.where("degree > 0").join(near, "id").groupBy(F.col("other").alias("id")).agg(F.sum(F.col("rest") * spread / F.col("degree")).alias("got"))
        kept = state.select(
            "id",
            (F.col("mass") + F.when(F.col("hot"), alpha * F.col("rest")).otherwise(0.0)).alias("mass"),
            F.when(F.col("hot"), F.when(F.col("degree") > 0, spread * F.col("rest")).otherwise(0.0)).otherwise(F.col("rest")).alias("rest"),
        )
        both = kept.join(sent, "id", "full").select("id", F.coalesce("mass", F.lit(0.0)).alias("mass"), (F.coalesce("rest", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("rest"))
        nxt = both.join(degree, "id").withColumn("hot", (F.col("rest") > epsilon * F.col("degree")) & (F.col("degree") > 0))
        after, (hot,) = scratch.save_seen(nxt.select("id", "degree", "mass", "rest", "hot"), "state", F.sum(F.col("hot").cast("long")))
        scratch.drop(state)
        state = after
    return state.where("mass > 0").select("id", "mass", "degree")


def local_partition(g: Graph, starts: DataFrame, scratch: Scratch, alpha: float = 0.15, epsilon: float = 1e-5, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, weight, conductance): the prefix of least conductance in the order of mass by degree around the starts."""
    weights = push_pagerank(g, starts, scratch, alpha, epsilon, kinds).select("id", F.when(F.col("degree") > 0, F.col("mass") / F.col("degree")).otherwise(F.col("mass")).alias("weight"))
    weights = scratch.save(weights, "weights")
    own = g if kinds is None else g.of_kind(*kinds)
    swept = scratch.save(sweep_cut(own, weights), "sweep")
    best = swept.agg(F.min(F.struct("conductance", "place")).alias("b")).select("b.*").withColumnsRenamed({"place": "last"})
    return swept.join(weights, "id").crossJoin(F.broadcast(best.select(F.col("conductance").alias("least"), "last"))).where("place <= last").select("id", "weight", F.col("least").alias("conductance"))


def center(g: Graph, members: DataFrame, scratch: Scratch) -> DataFrame:
    """The node of most edges of each component (columns id, component), the smallest of equal ones: component, center, degree, size."""
    ends = g.edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    rows = members.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = rows.groupBy("component").agg(F.min(F.struct((-F.col("degree")).alias("d"), "id")).alias("b"), F.count("*").alias("size"))
    return best.select("component", F.col("b.id").alias("center"), (-F.col("b.d")).alias("degree"), "size")


def layers(heights: DataFrame) -> DataFrame:
    """(level, nodes) of rounded heights (id, height); levels without a node are left out."""
    return heights.groupBy(F.floor(F.col("height") + 0.5).cast("long").alias("level")).agg(F.count("*").alias("nodes"))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def seeded_centroids(vectors: DataFrame, k: int, how: str, scratch: Scratch) -> DataFrame:
    """(cluster, centroid): the seeds of ``vectors`` (id, vec) as DataFrame passes, one for each farthest seed."""
    if how == "spread":
        n = vectors.count()
        numbered = vectors.select("id", "vec", (F.row_number().over(Window.orderBy("id")) - 1).alias("row"))
        wanted = [c * n // k for c in range(k)]
        return numbered.where(F.col("row").isin(wanted)).select((F.row_number().over(Window.orderBy("row")) - 1).alias("cluster"), F.col("vec").alias("centroid"))
    start = F.struct((-squared_norm(F.col("vec"))).alias("s"), "id", "vec") if how == "norm" else F.struct(F.lit(0.0).alias("s"), "id", "vec")
    chosen = [list(vectors.agg(F.min(start).alias("b")).first()["b"]["vec"])]
    away = scratch.save(vectors.select("id", "vec", linalg.squared_distance("vec", F.array(*map(F.lit, chosen[0]))).alias("d")), "away")
    while len(chosen) < k:
        far = away.agg(F.min(F.struct((-F.col("d")).alias("s"), "id", "vec")).alias("b")).first()["b"]["vec"]
        chosen.append(list(far))
        away = scratch.save(away.select("id", "vec", F.least("d", linalg.squared_distance("vec", F.array(*map(F.lit, chosen[-1])))).alias("d")), "away")
    return vectors.sparkSession.createDataFrame(list(enumerate(chosen)), "cluster int, centroid array<double>")
