"""Detectors, findings, their runners and roll-ups, orders and cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import findings, patterns, records
from loomgraph.plans import oracle_graphs as sql
from loomgraph.plans.scratch import Scratch
from loomgraph.registry import query, r6, with_
from loomgraph.sources import derive
from loomgraph.suites.motif import _instances_sql

NATIONS, TREE, TRADE, SERVICES = sql.NATIONS, sql.CONTAINMENT, sql.TRADE, sql.SERVICES
CLOSURE = "reach AS (SELECT src, dst FROM dir UNION SELECT r.src, d.dst FROM reach r JOIN dir d ON r.dst = d.src)"
SCC = ", s AS (SELECT a.src AS id, min(a.dst) AS m FROM reach a JOIN reach b ON a.dst = b.src AND b.dst = a.src GROUP BY a.src)"
Z = "(0.6745 * (value - median) / mad)"


def _z(source: str) -> str:
    return f"v AS ({source}), m AS (SELECT median(value) AS median, count(*) AS n FROM v), md AS (SELECT median(abs(value - median)) AS mad FROM v, m), z AS (SELECT v.*, median, CASE WHEN n >= 2 AND mad > 0 THEN {Z} END AS z FROM v, m, md)"


@query(
    "detect_motifs",
    with_(*_instances_sql(3), _z("SELECT canonical AS id, count(*)::DOUBLE AS value FROM f GROUP BY 1 HAVING count(*) >= 2"))
    + "SELECT 'motif_redundancy' AS detector, id, round(CASE WHEN z >= 3.0 THEN greatest(z, value) ELSE value END, 6) AS score, CASE WHEN z >= 3.0 THEN 'outlier' ELSE 'repeated' END AS code FROM z WHERE z >= 3.0 OR value >= 3",
)
def _(spark, d):
    groups = patterns.motif_groups(patterns.instances(derive.services(spark, d), 3, Scratch(spark)))
    rows = groups.select(F.lit("motif_redundancy").alias("metric"), F.lit("region").alias("scope"), F.col("canonical").alias("target"), F.col("instances").cast("double").alias("value"))
    return findings.detect(rows, ["motif_redundancy"]).select("detector", "id", *r6("score"), "code")


@query("detect_symmetry", with_(TRADE, _z("SELECT n.id, count(e.src)::DOUBLE AS value FROM nodes n LEFT JOIN edges e ON e.dst = n.id GROUP BY n.id")) + "SELECT 'local_symmetry' AS detector, id, round(coalesce(z, value), 6) AS score, 'twins' AS code FROM z WHERE CASE WHEN z IS NOT NULL THEN z >= 3.5 ELSE value >= 2 END")
def _(spark, d):
    """The detector over any per-node number: here a node's calls."""
    from loomgraph.operators import degrees

    v = degrees.bag_degrees(derive.trade(spark, d)).select(F.lit("local_symmetry").alias("metric"), F.lit("node").alias("scope"), F.col("id").alias("target"), F.col("ca").cast("double").alias("value"))
    return findings.detect(v, ["local_symmetry"]).select("detector", "id", *r6("score"), "code")


@query("detect_oversize", with_(TREE, _z("SELECT grp AS id, count(*)::DOUBLE AS value FROM nodes GROUP BY grp HAVING count(*) > 1")) + "SELECT 'modularity' AS detector, id, round(CASE WHEN z >= 3.0 THEN z ELSE value / median END, 6) AS score, CASE WHEN z >= 3.0 THEN 'outlier' ELSE 'oversize' END AS code FROM z WHERE z >= 3.0 OR value / median >= 5 UNION ALL SELECT 'nothing', '', NULL, 'unknown detector'")
def _(spark, d):
    rows = derive.containment(spark, d).nodes.groupBy(F.col("grp").alias("target")).agg(F.count("*").cast("double").alias("value"))
    rows = rows.select(F.lit("modularity").alias("metric"), F.lit("region").alias("scope"), "target", "value")
    return findings.detect(rows, ["modularity", "nothing", "modularity"]).select("detector", "id", *r6("score"), "code")


@query("detect_cycles", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + SCC + " SELECT 'cycle_rank' AS detector, least(id, m) AS id, count(*)::DOUBLE AS score, 'cycle' AS code FROM s GROUP BY least(id, m) HAVING count(*) > 1")
def _(spark, d):
    return findings.detect(records.run_metrics(derive.nations(spark, d), Scratch(spark), ["cycle_rank"]), ["cycle_rank"])


@query("detect_gap", with_(TREE) + "SELECT 'spectral_gap' AS detector, '' AS id, 1e9::DOUBLE AS score, 'disconnected' AS code")
def _(spark, d):
    """The containment forest has a tree for each region, so its gap is 0."""
    return findings.detect(records.run_metrics(derive.containment(spark, d), Scratch(spark), ["spectral_gap"]), ["spectral_gap"]).withColumn("score", F.round("score", 0))


LAYERS = [("AFRICA", "domain"), ("AMERICA", "application"), ("ASIA", "inbound_adapter"), ("EUROPE", "outbound_adapter"), ("MIDDLE EAST", "infrastructure")]


@query("role_layer_mask", with_(NATIONS) + ", r(grp, role) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LAYERS) + "), n AS (SELECT id, r.role FROM nodes JOIN r USING (grp)), no(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in records.DENIED_ROLES) + "), h AS (SELECT DISTINCT src, dst FROM edges e JOIN n x ON e.src = x.id JOIN n y ON e.dst = y.id JOIN no ON x.role = a AND y.role = b WHERE src <> dst) SELECT 'layer_mask' AS metric, 'graph' AS scope, '' AS target, count(*)::DOUBLE AS value FROM h UNION ALL SELECT 'layer_mask', 'edge', concat(src, '→', dst), 1 FROM h")
def _(spark, d):
    g = derive.nations(spark, d)
    roles = spark.createDataFrame(LAYERS, "grp string, role string")
    named = Graph(g.nodes.drop("role").join(roles, "grp"), g.edges)
    return records.layer_mask_records(named)


@query("hierarchy_cycles", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + SCC + ", l AS (SELECT DISTINCT src AS id FROM edges WHERE src = dst), p AS (SELECT id, least(id, m) AS scc FROM s UNION SELECT id, id FROM l WHERE id NOT IN (SELECT id FROM s)), z AS (SELECT scc, count(*) AS n, string_agg(id, ',' ORDER BY id) AS members FROM p GROUP BY scc) SELECT CASE WHEN n >= 5 THEN 'critical' WHEN n >= 2 THEN 'high' ELSE 'medium' END AS severity, n::DOUBLE AS score, scc AS primary_id, members FROM z")
def _(spark, d):
    g = derive.nations(spark, d)
    return findings.hierarchy_cycles(Graph(g.nodes, g.edges.withColumn("kind", F.lit("part-of"))), Scratch(spark))


@query("children_by_parent", with_(SERVICES) + "SELECT DISTINCT src AS parent, dst AS child FROM edges WHERE kind = 'contains' UNION ALL SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls'")
def _(spark, d):
    """Of a graph with hierarchy edges only these, of one without all."""
    g = derive.services(spark, d)
    return findings.children_by_parent(g).unionByName(findings.children_by_parent(g.of_kind("calls")))


FOUND = """
, ent AS (SELECT src, child_kind, count(*) AS n FROM (SELECT DISTINCT e.src, e.dst, n.kind AS child_kind FROM edges e JOIN nodes n ON e.dst = n.id WHERE e.src <> e.dst) GROUP BY 1, 2),
tot AS (SELECT src, sum(n) AS f FROM ent GROUP BY src HAVING sum(n) >= 5), hub AS (SELECT src, -sum(n / f * log2(n / f)) AS h, max(f) AS f FROM ent JOIN tot USING (src) GROUP BY src),
fd AS (SELECT 'label_entropy_hub' AS detector, CASE WHEN h * f >= 40 THEN 'high' WHEN h * f >= 15 THEN 'medium' ELSE 'low' END AS severity, h * f AS score, src AS primary_id, src AS members FROM hub WHERE h > 0
  UNION ALL SELECT 'duplicate_titles', CASE WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'medium' WHEN n >= 3 THEN 'low' ELSE 'info' END, n, first, title FROM (SELECT trim(regexp_replace(lower(name), '[^\\pL\\pN]+', ' ', 'g')) AS title, count(*) AS n, min(id) AS first FROM nodes GROUP BY 1 HAVING count(*) >= 2) WHERE title <> '')"""


@query("find_generic", with_(TREE) + FOUND.lstrip("\n") + " SELECT detector, severity, round(score, 6)::DOUBLE AS score, primary_id, members FROM fd UNION ALL SELECT 'absent', 'error', NULL, '', 'not registered'")
def _(spark, d):
    out = findings.find(derive.containment(spark, d), Scratch(spark), ["label_entropy_hub", "duplicate_titles", "absent", "duplicate_titles"])
    return out.select("detector", "severity", *r6("score"), "primary_id", "members")


@query("rank_findings", with_(TREE) + FOUND.lstrip("\n") + " SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END DESC, round(score, 6) DESC, detector, primary_id, members) AS rank, detector, primary_id FROM fd QUALIFY rank <= 10")
def _(spark, d):
    """The first ten findings of a report."""
    from pyspark.sql.window import Window

    out = findings.find(derive.containment(spark, d), Scratch(spark), ["label_entropy_hub", "duplicate_titles"]).withColumn("score", F.round("score", 6))
    first = out.orderBy(*findings.ranked(out)).limit(10)
    return first.select(F.row_number().over(Window.orderBy(*findings.ranked(first))).cast("long").alias("rank"), "detector", "primary_id")


@query("roll_up_findings", with_(TREE) + FOUND.lstrip("\n") + " SELECT detector, count(*)::BIGINT AS findings, round(max(score), 6)::DOUBLE AS highest, round(sum(score), 4)::DOUBLE AS total, arg_max(severity, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END) AS severity FROM fd GROUP BY detector")
def _(spark, d):
    out = findings.roll_up(findings.find(derive.containment(spark, d), Scratch(spark), ["label_entropy_hub", "duplicate_titles"]))
    return out.select("detector", "findings", *r6("highest"), F.round("total", 4).alias("total"), "severity")


@query("motif_digest", with_(*_instances_sql(3)) + "SELECT canonical, 3 AS size, count(*)::BIGINT AS instances FROM f GROUP BY canonical HAVING count(*) >= 2 ORDER BY instances DESC, canonical LIMIT 5")
def _(spark, d):
    return findings.motif_digest(patterns.motif_groups(patterns.Threes(derive.services(spark, d), Scratch(spark)).counts(), counted=True), 5)


@query("status_counts", "SELECT s AS status, count(o_orderkey)::BIGINT AS n FROM (VALUES ('match'), ('near_match'), ('mismatch'), ('not_applicable')) v(s) LEFT JOIN orders ON s = CASE o_orderstatus WHEN 'O' THEN 'match' WHEN 'F' THEN 'mismatch' ELSE 'near_match' END GROUP BY s")
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "match").when(F.col("o_orderstatus") == "F", "mismatch").otherwise("near_match")
    return findings.status_counts(derive.table(spark, d, "orders").select(status.alias("status")))


LEVELS = SCC + """, p AS (SELECT n.id, least(n.id, coalesce(m, n.id)) AS scc FROM nodes n LEFT JOIN s USING (id)),
over AS (SELECT DISTINCT x.scc AS a, y.scc AS b FROM dir JOIN p x ON src = x.id JOIN p y ON dst = y.id WHERE x.scc <> y.scc)"""
DEPTHS = "depth AS (SELECT scc, 0 AS l FROM (SELECT DISTINCT scc FROM p) UNION SELECT b, l + 1 FROM depth JOIN over ON scc = a)"


@query("condensation_order", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + LEVELS + f", {DEPTHS} SELECT p.id, p.scc, max(l)::INTEGER AS level FROM p JOIN depth USING (scc) GROUP BY p.id, p.scc")
def _(spark, d):
    return findings.condensation_order(derive.nations(spark, d), Scratch(spark))


@query("layering_score", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + LEVELS + f", {DEPTHS}, o AS (SELECT p.id, row_number() OVER (ORDER BY max(l), p.scc, p.id) AS r FROM p JOIN depth USING (scc) GROUP BY p.id, p.scc) SELECT round(1 - count(*) FILTER (y.r < x.r) / count(*), 6) AS layering FROM edges JOIN o x ON src = x.id JOIN o y ON dst = y.id")
def _(spark, d):
    return findings.layering_score(derive.nations(spark, d), Scratch(spark)).select(*r6("layering"))


@query("cycles_missing", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + SCC + ", z AS (SELECT least(s.id, m) AS scc, count(*) AS size, count(*) FILTER (grp = 'nowhere') AS k FROM s JOIN nodes USING (id) GROUP BY 1) SELECT scc, size::BIGINT AS size FROM z WHERE size > 1 AND k = 0")
def _(spark, d):
    return findings.cycles_missing(derive.nations(spark, d), Scratch(spark), F.col("grp") == "nowhere")
