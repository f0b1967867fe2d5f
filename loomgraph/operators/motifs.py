"""Triangles, curvature, two-hop symmetry and small motifs, by degree-ordered joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import blocks, sparse
from loomgraph.operators.blocks import Blocks
from loomgraph.operators.sparse import Sparse, parted
from loomgraph.plans.scratch import Scratch


def oriented(pairs: DataFrame) -> DataFrame:
    """Undirected pairs (a, b) as (lo, hi) from the end of lower degree: no node keeps more than sqrt(2 m) of them."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    rows = pairs.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return rows.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"), "da", "db", "a", "b")


def triangles(pairs: DataFrame | Graph) -> DataFrame:
    """Every triangle once, as (x, y, z) in ascending order.

    A component of at most MOST_PAIRS pairs is one task's work, which sends no paths; larger ones go by joins, those of a graph of groups by blocks.
    """

    def kernel(table: pa.Table) -> pa.Table:
        s = Sparse.of(table)
        found = list(s.triangles())
        xyz = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        ids = pa.array(s.ids, pa.string())
        return pa.table({name: ids.take(pa.array(x)) for name, x in zip("xyz", xyz)})

    small, large = _split(pairs)
    found = small.groupBy("component").applyInArrow(kernel, "x string, y string, z string")
    if isinstance(large, Blocks):
        return found.unionByName(_listed(large))
    return found if large is None else found.unionByName(triangles_by_joins(large))


def _listed(of: Blocks) -> DataFrame:
    """Every triangle of blocks once, as (x, y, z)."""
    held = of.n <= blocks.MOST_NAMES

    def kernel(x, y, names):
        i, j = x.pairs(y)
        a, b = i * x.step + x.first, j * y.step + y.first
        swap = a > b
        for which, z in blocks.common(x, i, y, j, beyond=True):
            own, other, turn = x.ids.take(pa.array(i[which])), y.ids.take(pa.array(j[which])), pa.array(swap[which])
            yield pa.table({"x": pc.if_else(turn, other, own), "y": pc.if_else(turn, own, other), "z": names.take(pa.array(z)) if held else pa.array(z)})

    found = of.met(kernel, f"x string, y string, z {'string' if held else 'long'}", named=held)
    return found if held else found.join(of.names.select(F.col("number").alias("z"), "id"), "z").select("x", "y", F.col("id").alias("z"))


def triangle_count(pairs: DataFrame | Graph) -> DataFrame:
    """One row, t: the number of triangles."""

    def kernel(table: pa.Table) -> pa.Table:
        return pa.table({"t": pa.array([Sparse.of(table).sides().sum() // 3], pa.int64())})

    small, large = _split(pairs)
    found = small.groupBy("component").applyInArrow(kernel, "t long")
    if isinstance(large, Blocks):
        found = found.unionByName(_counted(large))
    elif large is not None:
        found = found.unionByName(triangles_by_joins(large).agg(F.count("*").alias("t")))
    return found.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"))


def _counted(of: Blocks) -> DataFrame:
    """t, the number of triangles for each two blocks."""

    def kernel(x, y, _):
        i, j = x.pairs(y)
        yield pa.table({"t": pa.array([sum(len(z) for _, z in blocks.common(x, i, y, j, beyond=True))], pa.int64())})

    return of.met(kernel, "t long")


def moments(of: DataFrame | Graph, scratch: Scratch | None = None) -> DataFrame:
    """One row: d1, d2, d3, the sums of the degrees, of their squares and of their cubes, and t, the number of triangles."""

    def kernel(table: pa.Table) -> pa.Table:
        s = Sparse.of(table)
        d = np.diff(s.start).astype(float)
        return pa.table({"d1": [d.sum()], "d2": [(d**2).sum()], "d3": [(d**3).sum()], "t": pa.array([s.sides().sum() // 3], pa.int64())})

    small, large = _split(of, scratch)
    found = small.groupBy("component").applyInArrow(kernel, "d1 double, d2 double, d3 double, t long")
    if isinstance(large, Blocks):

        def degrees(x) -> pa.Table:
            d = x.degree.astype(float)
            return pa.table({"d1": [d.sum()], "d2": [(d**2).sum()], "d3": [(d**3).sum()], "t": pa.array([0], pa.int64())})

        zero = F.lit(0.0)
        counted = _counted(large).select(zero.alias("d1"), zero.alias("d2"), zero.alias("d3"), "t")
        found = found.unionByName(large.each(degrees, "d1 double, d2 double, d3 double, t long")).unionByName(counted)
    elif large is not None:
        x = F.col("d")
        d = large.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").cast("double").alias("d"))
        sums = d.agg(F.sum(x).alias("d1"), F.sum(x * x).alias("d2"), F.sum(x * x * x).alias("d3"))
        found = found.unionByName(sums.crossJoin(F.broadcast(triangles_by_joins(large).agg(F.count("*").alias("t")))))
    return found.agg(*(F.sum(c).alias(c) for c in ("d1", "d2", "d3")), F.coalesce(F.sum("t"), F.lit(0)).alias("t"))


def _split(pairs: DataFrame | Graph, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame | Blocks | None]:
    if isinstance(pairs, Graph):
        scratch = scratch or Scratch(pairs.nodes.sparkSession)
        small, large = parted(pairs, scratch, sparse.MOST_PAIRS)
        if isinstance(large, blocks.Large):
            return small, blocks.blocks(large, scratch)
        return small, None if large is None else large.select("a", "b")
    scratch = scratch or Scratch(pairs.sparkSession)
    text = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")) if dict(pairs.dtypes)["a"] != "string" else pairs
    small, large = parted(text, scratch, sparse.MOST_PAIRS)
    return small, None if large is None else large.select("a", "b")


def triangles_by_joins(pairs: DataFrame, e: DataFrame | None = None) -> DataFrame:
    """``triangles``, whatever the components' size; ``e`` is ``oriented(pairs)`` where that is at hand."""
    e = (oriented(pairs) if e is None else e).select("lo", "hi")
    # the edges are few and the paths that they make many: partitions stay as many as there are, whatever the edges' size
    e = e.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lo")
    wedge = e.join(e.select("lo", F.col("hi").alias("far")), "lo").where("hi < far")
    known = pairs.select(F.col("a").alias("hi"), F.col("b").alias("far"))
    found = wedge.join(known, ["hi", "far"])
    ordered = F.array_sort(F.array("lo", "hi", "far"))
    return found.select(ordered[0].alias("x"), ordered[1].alias("y"), ordered[2].alias("z"))


def _sides(pairs: DataFrame, e: DataFrame) -> DataFrame:
    """(a, b, t) of the pairs that are a side of triangles."""
    side = lambda p, q: F.struct(F.col(p).alias("a"), F.col(q).alias("b"))
    sides = triangles_by_joins(pairs, e).select(F.explode(F.array(side("x", "y"), side("x", "z"), side("y", "z"))).alias("s"))
    return sides.groupBy("s.a", "s.b").agg(F.count("*").alias("t"))


def edge_triangles(pairs: DataFrame) -> DataFrame:
    """(a, b, triangles) of every undirected pair."""
    return _sided(pairs).select("a", "b", "triangles")


def _sided(pairs: DataFrame | Graph, least: int | None = None) -> DataFrame:
    """(a, b, da, db, triangles): each pair with its ends' degrees and the triangles that it is a side of; ``least`` as in ``curvature``."""

    def sided(ids_a, ids_b, da, db, t, order) -> pa.Table:
        """``order(some)`` has the rows ``some`` by (a, b)."""
        if least is not None and least < len(t):
            kappa = 4 - da - db + 3 * t
            some = np.flatnonzero(kappa <= np.partition(kappa, max(least - 1, 0))[max(least - 1, 0)])
            low, high = order(some)
            some = some[np.lexsort((high, low, kappa[some]))[:least]]
            da, db, t = da[some], db[some], t[some]
        else:
            some = np.arange(len(t))
        return pa.table({"a": ids_a(some), "b": ids_b(some), "da": da, "db": db, "triangles": t})

    def kernel(table: pa.Table) -> pa.Table:
        s = Sparse.of(table)
        low, high, t = np.minimum(s.a, s.b), np.maximum(s.a, s.b), s.sides()
        degree = np.diff(s.start)
        ids = pa.array(s.ids, pa.string())
        return sided(lambda some: ids.take(pa.array(low[some])), lambda some: ids.take(pa.array(high[some])), degree[low], degree[high], t, lambda some: (low[some], high[some]))

    def met(x, y, _):
        i, j = x.pairs(y)
        t = np.zeros(len(i), np.int64)
        for which, _ in blocks.common(x, i, y, j, beyond=False):
            t += np.bincount(which, minlength=len(t))
        a, b = i * x.step + x.first, j * y.step + y.first
        turn = a > b
        da, db = x.degree[i], y.degree[j]

        def named(turned):
            return lambda some: pc.if_else(pa.array(turned[some]), y.ids.take(pa.array(j[some])), x.ids.take(pa.array(i[some])))

        yield sided(named(turn), named(~turn), np.where(turn, db, da), np.where(turn, da, db), t, lambda some: (np.minimum(a, b)[some], np.maximum(a, b)[some]))

    small, large = _split(pairs)
    schema = "a string, b string, da long, db long, triangles long"
    found = small.groupBy("component").applyInArrow(kernel, schema)
    if isinstance(large, Blocks):
        found = found.unionByName(large.met(met, schema))
    elif large is not None:
        e = oriented(large)
        found = found.unionByName(e.join(_sides(large, e), ["a", "b"], "left").select("a", "b", "da", "db", F.coalesce("t", F.lit(0)).alias("triangles")))
    return found


def curvature(pairs: DataFrame | Graph, least: int | None = None) -> DataFrame:
    """Forman-Ricci curvature of each pair, of a table or of a graph: 4 - d(a) - d(b) + 3 triangles.

    For one who wants the ``least`` first by (kappa, a, b), a component that one task holds sends no more than those.
    """
    return _sided(pairs, least).select("a", "b", "triangles", (4 - F.col("da") - F.col("db") + 3 * F.col("triangles")).alias("kappa"))


def two_hop(g: Graph) -> DataFrame:
    """(id, other) within two undirected hops, without the node itself."""
    near = g.neighbours()
    far = near.join(near.select(F.col("id").alias("other"), F.col("other").alias("far")), "other").select("id", F.col("far").alias("other"))
    return near.unionByName(far).where("id <> other").distinct()


def role_signatures(g: Graph) -> DataFrame:
    """id and signature: the node's kind and the counts of its edge kinds by direction."""
    out = g.edges.select(F.col("src").alias("id"), F.concat(F.lit("out:"), "kind").alias("e"))
    back = g.edges.select(F.col("dst").alias("id"), F.concat(F.lit("in:"), "kind").alias("e"))
    counts = out.unionByName(back).groupBy("id", "e").agg(F.count("*").alias("n"))
    text = counts.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "e", F.col("n").cast("string")))), ";").alias("s"))
    return g.nodes.select("id", "kind").join(text, "id", "left").select("id", F.concat_ws("|", "kind", F.coalesce("s", F.lit(""))).alias("signature"))


def local_symmetry(g: Graph) -> DataFrame:
    """How many nodes within two hops have the same signature: id, twins.

    Neighbours of one node meet by signature, so only twins are paired, and not all pairs around a hub.
    """
    s = role_signatures(g)
    near = g.neighbours().join(s, "id")
    far = near.join(near.select("other", "signature", F.col("id").alias("twin")), ["other", "signature"]).select("id", "twin")
    direct = near.join(s.select(F.col("id").alias("other"), F.col("signature").alias("same")), "other").where("signature = same").select("id", F.col("other").alias("twin"))
    pairs = far.unionByName(direct).where("id <> twin").distinct()
    return g.nodes.select("id").join(pairs.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("twins"))


def motif3(g: Graph) -> DataFrame:
    """Connected induced subgraphs of three nodes: shape (path or triangle) and kinds, with their number.

    Triangles are listed by degree order; paths are counted from degrees per centre and end kinds,
    minus those that a triangle closes, so no wedge list of a hub is built.
    """
    pairs, kinds = g.undirected(), g.nodes.select("id", "kind")
    t = triangles(pairs)
    for side in ("x", "y", "z"):
        t = t.join(kinds.select(F.col("id").alias(side), F.col("kind").alias(f"k{side}")), side)
    closed = t.select(F.array_join(F.array_sort(F.array("kx", "ky", "kz")), ",").alias("kinds")).groupBy("kinds").agg(F.count("*").alias("n")).select(F.lit("triangle").alias("shape"), "kinds", "n")
    near = g.neighbours().join(kinds.select(F.col("id").alias("other"), F.col("kind").alias("k")), "other").groupBy("id", "k").agg(F.count("*").alias("d"))
    two = near.join(near.select("id", F.col("k").alias("k2"), F.col("d").alias("d2")), "id").where("k <= k2").join(kinds, "id")
    wedges = F.when(F.col("k") == F.col("k2"), F.col("d") * (F.col("d") - 1) / 2).otherwise(F.col("d") * F.col("d2"))
    name = F.concat(F.col("kind"), F.lit("("), F.col("k"), F.lit(","), F.col("k2"), F.lit(")"))
    wedge = two.groupBy(name.alias("kinds")).agg(F.sum(wedges).cast("long").alias("n"))
    corners = t.select(F.explode(F.array(*(F.struct(F.col(c).alias("c"), F.least(a, b).alias("p"), F.greatest(a, b).alias("q")) for c, a, b in (("kx", "ky", "kz"), ("ky", "kx", "kz"), ("kz", "kx", "ky"))))).alias("s"))
    shut = corners.groupBy(F.concat(F.col("s.c"), F.lit("("), F.col("s.p"), F.lit(","), F.col("s.q"), F.lit(")")).alias("kinds")).agg(F.count("*").alias("m"))
    open_ = wedge.join(shut, "kinds", "left").select(F.lit("path").alias("shape"), "kinds", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")
    return closed.unionByName(open_)
