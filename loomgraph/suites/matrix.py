"""Matrix validators, the metric report, building and importing, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import findings, matrix
from loomgraph.plans import oracle_graphs as sql
from loomgraph.plans.scratch import Scratch
from loomgraph.queries import ORACLES as GRAPH_ORACLES
from loomgraph.registry import query, with_
from loomgraph.sources import derive

NATIONS, TREE, SERVICES, TRADE = sql.NATIONS, sql.CONTAINMENT, sql.SERVICES, sql.TRADE
NUMBERS = "num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM nodes)"
ADJACENCY = "adj AS (SELECT x.n AS i, y.n AS j, src, dst FROM dir JOIN num x ON src = x.id JOIN num y ON dst = y.id)"
DENY = [("AFRICA", "ASIA"), ("ASIA", "AMERICA"), ("EUROPE", "MIDDLE EAST"), ("ATLANTIS", "ASIA")]


@query("node_numbers", with_(TRADE, NUMBERS) + "SELECT id, n FROM num")
def _(spark, d):
    return matrix.numbered(derive.parties(spark, d), Scratch(spark))


@query("adjacency_matrix", with_(NATIONS, sql.DIRECTED, NUMBERS, ADJACENCY) + "SELECT i, j, 1.0::DOUBLE AS value FROM adj")
def _(spark, d):
    g, s = derive.nations(spark, d), Scratch(spark)
    return matrix.adjacency(g, matrix.numbered(g.nodes, s))


@query("matrix_validators", with_(NATIONS, sql.DIRECTED, NUMBERS, ADJACENCY) + f", no(a, b) AS (VALUES {', '.join(map(str, DENY))}), hit AS (SELECT src, dst FROM dir JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id JOIN no ON x.role = a AND y.role = b), two AS (SELECT a.src, b.dst, count(*) AS v FROM dir a JOIN dir b ON a.dst = b.src GROUP BY 1, 2) SELECT 'fan_out' AS metric, 'node' AS scope, src AS target, count(*)::DOUBLE AS value FROM dir GROUP BY src UNION ALL SELECT 'fan_in', 'node', dst, count(*) FROM dir GROUP BY dst UNION ALL SELECT 'layer_mask', 'edge', concat(src, '→', dst), 1 FROM hit UNION ALL SELECT 'layer_mask', 'graph', '', count(*) FROM hit UNION ALL SELECT 'two_steps', 'edge', concat(src, '→', dst), v FROM two UNION ALL SELECT 'two_steps', 'graph', '', count(*) FROM two")
def _(spark, d):
    g, s = derive.nations(spark, d), Scratch(spark)
    rules = spark.createDataFrame(DENY, "from_group string, to_group string")
    g = Graph(s.save(g.nodes, "nodes"), s.save(g.edges, "edges"))
    out = [v.run(g, s) for v in (matrix.FAN_OUT, matrix.FAN_IN, matrix.layer_validator("role", rules), matrix.TWO_STEPS)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("matrix_collapse", with_(NATIONS, sql.DIRECTED) + "SELECT a.role AS from_layer, b.role AS to_layer, count(*)::DOUBLE AS value FROM dir JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id GROUP BY 1, 2")
def _(spark, d):
    g, s = derive.nations(spark, d), Scratch(spark)
    n = s.save(matrix.numbered(g.nodes, s), "numbers")
    return matrix.collapse(matrix.adjacency(g, n), matrix.one_hot(g, n, "role"))


@query("metric_report", with_(SERVICES) + "SELECT 'anomaly' AS part, 'none' AS name, true AS there")
def _(spark, d):
    """The report on the services' graph, which has no cycles of calls: metrics and motifs, and no anomaly of cycles."""
    out = matrix.facade(derive.services(spark, d), Scratch(spark))
    n = out.agg(F.count(F.when(F.col("part") == "anomaly", 1)).alias("odd"), F.countDistinct(F.when(F.col("part") != "anomaly", F.col("name"))).alias("names"))
    return n.select(F.lit("anomaly").alias("part"), F.lit("none").alias("name"), ((F.col("odd") == 0) & (F.col("names") == 4)).alias("there"))


@query("import_faults", with_(TREE) + "SELECT concat(src, ' contains ', dst) AS item, 'a type can''t contain a function' AS fault FROM edges WHERE dst LIKE 'c%' AND src LIKE 'n:%' UNION ALL SELECT concat(src, ' contains ', dst), 'a package can''t contain a package' FROM edges WHERE src NOT LIKE 'n:%' AND false UNION ALL SELECT 'ASIA contains nowhere', 'edge to no node' UNION ALL SELECT 'ASIA', 'repeated id'")
def _(spark, d):
    """Nations as types: they may hold no customers, which are functions, nor suppliers, which are types."""
    g = derive.containment(spark, d)
    kind = F.when(F.col("kind") == "file", "type").when(F.col("kind") == "type", "method").otherwise(F.col("kind"))
    nodes = g.nodes.withColumn("kind", kind)
    nodes = nodes.unionByName(nodes.where("id = 'ASIA'"))
    extra = spark.createDataFrame([("ASIA", "nowhere", "contains", 0)], "src string, dst string, kind string, seq long")
    return matrix.invalid(Graph(nodes, g.edges.unionByName(extra)))


@query("built_graph", "SELECT 'p' AS src, 'p.T' AS dst, 'contains' AS kind UNION ALL SELECT 'p.T', 'p.T.m', 'contains' UNION ALL SELECT 'p.T', 'p.I', 'implements' UNION ALL SELECT 'p', 'p.I', 'contains'")
def _(spark, d):
    b = matrix.GraphBuilder().add("package", "p", layer="domain").add("type", "p.T", "p").add("type", "p.I", "p").add("method", "p.T.m", "p.T")
    return b.link("implements", "p.T", "p.I").build(spark).edges.select("src", "dst", "kind")


@query("hashed_embeddings", "SELECT p_partkey AS id, 32 AS size, true AS unit, true AS reread FROM part")
def _(spark, d):
    """Vectors of part names by the provider without a model, of length 1 or 0 (where signs cancel), and once more from a cache."""
    from loomgraph.commands import HashedWords, embed

    provider, scratch = HashedWords(32), Scratch(spark)
    rows = derive.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    first = scratch.save(embed(rows, provider), "vectors")
    key = F.sha2(F.concat_ws("|", F.lit(provider.name), "text").cast("binary"), 256)
    known = rows.join(first, "id").groupBy(key.alias("key")).agg(F.first("vec").alias("vec"))
    again = embed(rows, provider, scratch.save(known, "known")).withColumnRenamed("vec", "other")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return first.join(again, "id").select("id", F.size("vec").alias("size"), ((F.abs(norm - 1) < 1e-9) | (norm == 0)).alias("unit"), (F.col("vec") == F.col("other")).alias("reread"))


@query("find_articulation", "SELECT 'articulation' AS detector, CASE WHEN guarded >= 20 THEN 'high' WHEN guarded >= 5 THEN 'medium' ELSE 'low' END AS severity, guarded::DOUBLE AS score, id AS primary_id FROM (" + GRAPH_ORACLES["articulation_services"] + ") WHERE guarded >= 2")
def _(spark, d):
    return findings.find(derive.services(spark, d), Scratch(spark), ["articulation"]).select("detector", "severity", "score", "primary_id")


@query("quotient_communities", with_(NATIONS) + "SELECT a.grp AS from_group, b.grp AS to_group, count(DISTINCT (src, dst))::BIGINT AS weight FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.grp <> b.grp AND a.grp <> 'ASIA' AND b.grp <> 'ASIA' GROUP BY 1, 2")
def _(spark, d):
    """Communities of all nations but Asia's, with a member that no node is."""
    from loomgraph.operators import degrees

    g = derive.nations(spark, d)
    members = g.nodes.where("grp <> 'ASIA'").select("id", F.col("grp").alias("community"))
    return degrees.quotient_by_communities(g, members.unionByName(spark.createDataFrame([("nowhere", "EUROPE")], "id string, community string")))


@query("component_eigen_centers", with_(NATIONS, sql.UNDIRECTED, "walk AS (SELECT id, id AS c FROM nodes UNION SELECT b.other, w.c FROM walk w JOIN both_ways b ON w.id = b.id WHERE w.c < b.other)", recursive=True) + ", p AS (SELECT id, min(c) AS component FROM walk GROUP BY id), e AS (" + GRAPH_ORACLES["eigen_centrality"] + ") SELECT component, arg_min(id, (-coalesce(centrality, 0), id)) AS center, count(*)::BIGINT AS size FROM p LEFT JOIN e USING (id) GROUP BY component")
def _(spark, d):
    """Each component's node of highest eigenvector centrality, the smallest of equal ones, and its size."""
    from loomgraph.operators import linalg, traversal

    g, s = derive.nations(spark, d), Scratch(spark)
    score = linalg.eigen_centrality(g, s).select("id", F.round("centrality", 6).alias("x"))
    rows = traversal.components(g, s).join(score, "id", "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    best = rows.groupBy("component").agg(F.min(F.struct((-F.col("x")).alias("x"), "id")).alias("b"), F.count("*").alias("size"))
    return best.select("component", F.col("b.id").alias("center"), "size")
