"""Spectra, choices of k, seedings, silhouettes, local partition."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import linalg, spectral, traversal
from loomgraph.plans import oracle_graphs as sql
from loomgraph.plans.scratch import Scratch
from loomgraph.registry import query, r6, with_
from loomgraph.sources import derive

NATIONS, TREE, PARTS = sql.NATIONS, sql.CONTAINMENT, sql.PARTS
DEGREES = ", dg AS (SELECT n.id, count(b.other) AS d FROM nodes n LEFT JOIN both_ways b USING (id) GROUP BY n.id)"
TRIANGLES = ", tr AS (SELECT count(*) AS t FROM und x JOIN und y ON x.b = y.a JOIN und w ON w.a = x.a AND w.b = y.b)"


@query("laplacian_moments", with_(NATIONS, sql.UNDIRECTED) + DEGREES + TRIANGLES + " SELECT count(*)::BIGINT AS nodes, round(sum(d), 4)::DOUBLE AS m1, round(sum(d * d + d), 4)::DOUBLE AS m2, round(sum(d * d * d + 3 * d * d) - 6 * max(t), 4)::DOUBLE AS m3 FROM dg, tr")
def _(spark, d):
    out = spectral.moments(linalg.laplacian_spectrum(derive.nations(spark, d), Scratch(spark)))
    return out.select("nodes", *(F.round(c, 4).alias(c) for c in ("m1", "m2", "m3")))


@query("part_laplacian_moments", with_(PARTS, sql.UNDIRECTED) + DEGREES + TRIANGLES + " SELECT count(*)::BIGINT AS nodes, round(sum(d), 2)::DOUBLE AS m1, round(sum(d * d + d), 2)::DOUBLE AS m2, (sum(d * d * d + 3 * d * d) - 6 * max(t))::BIGINT AS m3 FROM dg, tr")
def _(spark, d):
    g, s = derive.cooccurrence(spark, d), Scratch(spark)
    out = spectral.moments(linalg.laplacian_spectrum(g, s)) if linalg.fits_kernel(g, s) else linalg.moments_by_joins(g, s)
    return out.select("nodes", F.round("m1", 2).alias("m1"), F.round("m2", 2).alias("m2"), F.round("m3").cast("long").alias("m3"))


@query("normalised_moments", with_(NATIONS, sql.UNDIRECTED) + DEGREES + " SELECT (SELECT count(*) FROM dg WHERE d > 0)::BIGINT AS nodes, round((SELECT count(*) FROM dg WHERE d > 0), 6)::DOUBLE AS m1, round((SELECT count(*) FROM dg WHERE d > 0) + sum(2.0 / (p.d * q.d)), 6)::DOUBLE AS m2 FROM und JOIN dg p ON a = p.id JOIN dg q ON b = q.id")
def _(spark, d):
    g = derive.nations(spark, d)
    values = spectral.decomposition(g, Scratch(spark), normalised=True).select("component", "k", "eigenvalue").distinct()
    return spectral.moments(values).select("nodes", *r6("m1", "m2"))


@query("eigenvectors_hold", with_(NATIONS, sql.UNDIRECTED) + " SELECT id, true AS holds FROM (SELECT DISTINCT id FROM both_ways)")
def _(spark, d):
    """Whether L x = lambda x at each node for all eigenvectors, checked by joins."""
    g, s = derive.nations(spark, d), Scratch(spark)
    x = s.save(spectral.decomposition(g, s), "vectors")
    near = g.neighbours()
    pulled = near.join(x.select(F.col("id").alias("other"), "component", "k", F.col("entry").alias("y")), "other").groupBy("id", "component", "k").agg(F.sum("y").alias("s"), F.count("*").alias("d"))
    off = x.join(pulled, ["id", "component", "k"]).withColumn("off", F.abs(F.col("d") * F.col("entry") - F.col("s") - F.col("eigenvalue") * F.col("entry")))
    return off.groupBy("id").agg((F.max("off") < 1e-8).alias("holds"))


@query("trophic_balance", with_(NATIONS) + " SELECT id, true AS balanced, true AS grounded FROM nodes")
def _(spark, d):
    """Whether heights solve (in + out) h - sum of neighbours' h = in - out at each node, and are 0 or more."""
    g, s = derive.nations(spark, d), Scratch(spark)
    h = s.save(linalg.trophic_levels(g, s), "heights")
    e = g.edges.where("src <> dst").select("src", "dst")
    ends = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(-1).alias("sign")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(1).alias("sign")))
    rows = ends.join(h.select(F.col("id").alias("other"), F.col("height").alias("ho")), "other").groupBy("id").agg(F.count("*").alias("n"), F.sum("ho").alias("s"), F.sum("sign").alias("net"))
    out = h.join(rows, "id", "left").withColumn("off", F.coalesce(F.abs(F.col("n") * F.col("height") - F.col("s") - F.col("net")), F.lit(0.0)))
    return out.select("id", (F.col("off") < 1e-6).alias("balanced"), (F.col("height") >= 0).alias("grounded"))


@query("height_layers", with_(TREE) + ", l AS (SELECT CASE kind WHEN 'package' THEN 0 WHEN 'file' THEN 1 ELSE 2 END AS level FROM nodes WHERE id IN (SELECT src FROM edges) OR id IN (SELECT dst FROM edges)) SELECT level::BIGINT AS level, count(*)::BIGINT AS nodes FROM l GROUP BY level")
def _(spark, d):
    """Trophic levels of a tree are its depths."""
    g = derive.containment(spark, d)
    linked = g.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return spectral.layers(linalg.trophic_levels(g, Scratch(spark)).join(linked, "id", "left_semi"))


@query("component_centers", with_(TREE, sql.UNDIRECTED, "walk AS (SELECT id, id AS c FROM nodes UNION SELECT b.other, w.c FROM walk w JOIN both_ways b ON w.id = b.id WHERE w.c < b.other)", recursive=True) + ", p AS (SELECT id, min(c) AS c FROM walk GROUP BY id), dg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) SELECT c AS component, arg_min(id, (-coalesce(d, 0), id)) AS center, max(coalesce(d, 0))::BIGINT AS degree, count(*)::BIGINT AS size FROM p LEFT JOIN dg USING (id) GROUP BY c")
def _(spark, d):
    g, s = derive.containment(spark, d), Scratch(spark)
    return spectral.center(g, traversal.components(g, s), s)


@query("spectral_report", with_(NATIONS, sql.UNDIRECTED) + DEGREES + " SELECT count(*) FILTER (d > 0)::BIGINT AS nodes, true AS bounded, true AS found FROM dg")
def _(spark, d):
    """lambda2 is at most n / (n - 1) times the least degree; Q at the gap's k lies in its range and k among the values."""
    g, s = derive.nations(spark, d), Scratch(spark)
    least = g.neighbours().groupBy("id").agg(F.count("*").alias("d")).agg(F.min("d").alias("least"))
    r = spectral.report(g, s).crossJoin(F.broadcast(least))
    return r.select("nodes", (F.col("lambda2") <= F.col("nodes") / (F.col("nodes") - 1) * F.col("least") + 1e-9).alias("bounded"), (F.col("gap_k").between(1, F.col("nodes")) & F.col("knee").between(1, F.col("nodes")) & F.col("q").between(-0.5, 1.0)).alias("found"))


@query("spectral_clusters", with_(NATIONS, sql.UNDIRECTED) + " SELECT count(DISTINCT id)::BIGINT AS nodes, true AS better FROM both_ways")
def _(spark, d):
    """The chosen clusters' modularity, recomputed by sums over labels, is the reported one and above that of one part."""
    from loomgraph.operators import degrees

    g, s = derive.nations(spark, d), Scratch(spark)
    found = s.save(spectral.clusters(g, s), "clusters")
    q = degrees.modularity(Graph(found.select("id", F.col("cluster").alias("grp")), g.edges))
    return found.agg(F.count("*").alias("nodes"), F.max("q").alias("told")).crossJoin(F.broadcast(q)).select("nodes", ((F.abs(F.col("told") - F.col("q")) < 1e-9) & (F.col("told") > -1e-9)).alias("better"))


VECS = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings WHERE label IS NOT NULL)"
DD = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _vectors(spark, d):
    rows = derive.table(spark, d, "embeddings").where("label is not null")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@query(
    "silhouette",
    VECS + f""", p AS (SELECT a.id, a.label AS mine, b.label AS cluster, sum(sqrt({DD})) FILTER (a.id <> b.id) AS total, count(*) FILTER (a.id <> b.id) AS n FROM v a, v b GROUP BY 1, 2, 3),
e AS (SELECT id, coalesce(max(CASE WHEN mine = cluster AND n > 0 THEN total / n END), 0) AS a, min(CASE WHEN mine <> cluster THEN total / n END) AS b FROM p GROUP BY id)
SELECT round(avg(CASE WHEN b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette, count(*)::BIGINT AS n FROM e""",
)
def _(spark, d):
    out = spectral.silhouette(_vectors(spark, d).withColumnRenamed("label", "cluster"), Scratch(spark), chunk=256)
    return out.select(*r6("silhouette"), "n")


@query("kmeans_spread_seeds", VECS + ", r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row, count(*) OVER () AS n FROM v) SELECT c::INTEGER AS cluster, id AS seed FROM r JOIN (SELECT unnest(range(5)) AS c) ON row = c * n // 5")
def _(spark, d):
    v = _vectors(spark, d)
    return spectral.seeded_centroids(v, 5, "spread", Scratch(spark)).join(v.withColumnRenamed("vec", "centroid"), "centroid").select("cluster", F.col("id").alias("seed"))


def _farthest_sql(k: int, first: str) -> str:
    out = [VECS, f"s0 AS MATERIALIZED (SELECT id, vec FROM v ORDER BY {first}, id LIMIT 1)"]
    for i in range(1, k):
        chosen = " UNION ALL ".join(f"FROM s{j}" for j in range(i))
        out.append(f"s{i} AS MATERIALIZED (SELECT a.id, a.vec FROM v a, ({chosen}) b GROUP BY a.id, a.vec ORDER BY min({DD}) DESC, a.id LIMIT 1)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT {i} AS cluster, id AS seed FROM s{i}" for i in range(k))


@query("kmeans_farthest_seeds", _farthest_sql(4, "id"))
def _(spark, d):
    v = _vectors(spark, d)
    return spectral.seeded_centroids(v, 4, "index", Scratch(spark)).join(v.withColumnRenamed("vec", "centroid"), "centroid").select("cluster", F.col("id").alias("seed"))


@query("kmeans_norm_seeds", _farthest_sql(4, "-list_sum(list_transform(vec, lambda x: x * x))"))
def _(spark, d):
    v = _vectors(spark, d)
    return spectral.seeded_centroids(v, 4, "norm", Scratch(spark)).join(v.withColumnRenamed("vec", "centroid"), "centroid").select("cluster", F.col("id").alias("seed"))


@query("semantic_clusters")
def _(spark, d):
    return spectral.semantic_clusters(_vectors(spark, d).select("id", "vec"))


@query("local_partition", "SELECT 'A' || unnest(range(1, 6)) AS id, round(1 / 21, 6) AS conductance")
def _(spark, d):
    """Two cliques of five with a bridge, from one of their nodes: the clique is the region."""
    import itertools

    rows = [(f"{c}{i}", f"{c}{j}") for c in "AB" for i, j in itertools.combinations(range(1, 6), 2)] + [("A5", "B1")]
    edges = spark.createDataFrame([(a, b, "calls", i) for i, (a, b) in enumerate(rows)], "src string, dst string, kind string, seq long")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("kind", F.lit("function"))
    return spectral.local_partition(Graph(nodes, edges), spark.createDataFrame([("A1",)], "id string"), Scratch(spark), epsilon=1e-3).select("id", *r6("conductance"))


@query("push_pagerank", with_(NATIONS, sql.UNDIRECTED) + " SELECT true AS whole, true AS ranked FROM both_ways LIMIT 1")
def _(spark, d):
    """Pushes to a small bound: the mass is nearly all, and the start has the most by degree."""
    g, s = derive.nations(spark, d), Scratch(spark)
    start = g.neighbours().agg(F.min("id").alias("id"))
    p = s.save(spectral.push_pagerank(g, start, s, epsilon=1e-4), "mass")
    top = p.agg(F.max_by("id", F.col("mass") / F.col("degree")).alias("top"), F.sum("mass").alias("total"))
    return top.crossJoin(F.broadcast(start)).select((F.col("total") > 0.95).alias("whole"), (F.col("top") == F.col("id")).alias("ranked"))


@query("moments_by_joins", with_(PARTS, sql.UNDIRECTED) + DEGREES + TRIANGLES + " SELECT count(*)::BIGINT AS nodes, round(sum(d), 2)::DOUBLE AS m1, round(sum(d * d + d), 2)::DOUBLE AS m2, (sum(d * d * d + 3 * d * d) - 6 * max(t))::BIGINT AS m3 FROM dg, tr")
def _(spark, d):
    out = linalg.moments_by_joins(derive.cooccurrence(spark, d))
    return out.select("nodes", F.round("m1", 2).alias("m1"), F.round("m2", 2).alias("m2"), F.round("m3").cast("long").alias("m3"))


@query("summary_by_joins", with_(TREE, sql.UNDIRECTED) + ", r AS (SELECT count(*) AS n FROM nodes WHERE kind = 'package') SELECT (SELECT count(*) FROM nodes)::BIGINT AS nodes, max(n)::BIGINT AS components, 2.0::DOUBLE * count(*) AS total FROM und, r")
def _(spark, d):
    """The containment forest has a tree for each region."""
    return linalg.summary_by_joins(derive.containment(spark, d), Scratch(spark))


@query("louvain_quality", with_(NATIONS, sql.UNDIRECTED) + " SELECT (SELECT count(*) FROM nodes)::BIGINT AS nodes, true AS better, true AS agree FROM und LIMIT 1")
def _(spark, d):
    """Communities by kernel and by joins: both are above each node alone, and neither far below the other."""
    from loomgraph.operators import degrees

    g, s = derive.nations(spark, d), Scratch(spark)
    q = lambda parts, name: degrees.modularity(Graph(g.nodes.select("id").join(parts, "id", "left").select("id", F.coalesce("community", "id").alias("grp")), g.edges)).select(F.col("q").alias(name))
    alone = degrees.modularity(Graph(g.nodes.select("id", F.col("id").alias("grp")), g.edges)).select(F.col("q").alias("x"))
    joined = s.save(linalg.louvain_by_joins(g, s), "communities")
    rows = q(linalg.louvain(g, s), "a").crossJoin(F.broadcast(q(joined, "b"))).crossJoin(F.broadcast(alone)).crossJoin(F.broadcast(joined.agg(F.count("*").alias("nodes"))))
    return rows.select("nodes", ((F.col("a") > F.col("x")) & (F.col("b") > F.col("x"))).alias("better"), (F.abs(F.col("a") - F.col("b")) < 0.1).alias("agree"))


@query("power_radius", with_(TREE) + " SELECT true AS near FROM nodes LIMIT 1")
def _(spark, d):
    """The radius by joins is the kernels' radius."""
    g, s = derive.nations(spark, d), Scratch(spark)
    exact = linalg.spectral_summary(linalg.laplacian_spectrum(g, s)).select(F.col("radius").alias("exact"))
    return spectral.power_radius(g, s, rounds=12).crossJoin(F.broadcast(exact)).select((F.abs(F.col("radius") - F.col("exact")) < 0.05 * F.col("exact")).alias("near"))
