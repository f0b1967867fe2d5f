"""The graph server's tools: contracts, mutations, targets, catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import contracts, records, service, sets
from loomgraph.plans import oracle_graphs as sql
from loomgraph.plans.scratch import Scratch
from loomgraph.registry import query, with_
from loomgraph.sources import derive
from loomgraph.sources.documents import Store

NATIONS, TREE, SERVICES, TRADE = sql.NATIONS, sql.CONTAINMENT, sql.SERVICES, sql.TRADE

#: Suppliers of a year: types and functions with attributes, routes from customers' segments.
VARIANT = """
{p}n AS (SELECT concat('s', s_suppkey) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'function' WHEN s_suppkey % 7 = 0 THEN 'env_var' ELSE 'type' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN lower(s_name) ELSE s_name END AS name, count(*) AS calls, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS back
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE year(o_orderdate) = {y} GROUP BY s_suppkey, s_name),
{p}c AS (SELECT *, CASE WHEN kind = 'env_var' THEN 'env_var' WHEN kind = 'function' AND back > 0 THEN 'http_handler' WHEN kind = 'type' AND name <> lower(name) THEN 'dto' ELSE '' END AS contract, CASE WHEN name <> lower(name) THEN 'public' ELSE 'private' END AS visibility FROM {p}n)"""


def _variant(spark, d, year: int) -> Graph:
    """A graph of one year's lines: suppliers as nodes with attributes, a route to each supplier that took a line back."""
    lines = derive.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = derive.table(spark, d, "orders").where(F.year("o_orderdate") == year).select("o_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("s_suppkey"))
    rows = rows.agg(F.count("*").alias("calls"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("back")).join(derive.table(spark, d, "supplier"), "s_suppkey")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "function").when(F.col("s_suppkey") % 7 == 0, "env_var").otherwise("type")
    name = F.when(F.col("s_suppkey") % 5 == 0, F.lower("s_name")).otherwise(F.col("s_name"))
    nodes = rows.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), kind.alias("kind"), name.alias("name"), F.create_map(F.lit("calls"), F.col("calls").cast("string"), F.lit("back"), F.col("back").cast("string")).alias("attrs"))
    edges = nodes.where(F.col("attrs")["back"] != "0").select(F.lit("router").alias("src"), F.col("id").alias("dst"), F.lit("route_registers").alias("kind"))
    return Graph(nodes, edges)


A, B = VARIANT.format(p="a", y=1995), VARIANT.format(p="b", y=1996)


@query("contracts_tag", with_(A) + "SELECT id, CASE WHEN contract <> '' THEN 'contract' ELSE '' END AS tags, contract, CASE WHEN contract <> '' THEN visibility ELSE '' END AS visibility FROM ac")
def _(spark, d):
    g = service.tag_contracts(_variant(spark, d, 1995))
    return g.nodes.select("id", service.attr("tags").alias("tags"), service.attr("contract_kind").alias("contract"), service.attr("visibility").alias("visibility"))


@query("contracts_list", with_(A) + "SELECT id, name, kind, contract AS contract_kind, visibility FROM ac WHERE contract = 'http_handler' AND visibility = 'public'")
def _(spark, d):
    return service.list_contracts(service.tag_contracts(_variant(spark, d, 1995)), "http_handler", "public")


@query(
    "contracts_diff",
    with_(A, B)
    + """, x AS (SELECT * FROM ac WHERE contract <> ''), y AS (SELECT * FROM bc WHERE contract <> '')
SELECT id, 'removed' AS change, '' AS field, '' AS old, '' AS new FROM x ANTI JOIN y USING (id) UNION ALL SELECT id, 'added', '', '', '' FROM y ANTI JOIN x USING (id)
UNION ALL SELECT id, 'changed', 'calls', x.calls::VARCHAR, y.calls::VARCHAR FROM x JOIN y USING (id) WHERE x.calls <> y.calls UNION ALL SELECT id, 'changed', 'back', x.back::VARCHAR, y.back::VARCHAR FROM x JOIN y USING (id) WHERE x.back <> y.back""",
)
def _(spark, d):
    return service.diff_contracts(*(service.tag_contracts(_variant(spark, d, y)) for y in (1995, 1996)))


@query(
    "contracts_export",
    with_(A)
    + """, e AS (SELECT 'path' AS section, concat('get /', regexp_replace(left(name, 12), '[^A-Za-z0-9\\-_]', '_', 'g')) AS key, id FROM ac WHERE contract = 'http_handler' UNION ALL SELECT 'schema', left(name, 12), id FROM ac WHERE contract = 'dto'), o AS (SELECT section, key, min(id) AS owner FROM e GROUP BY 1, 2)
SELECT CASE WHEN id = o.owner THEN section ELSE 'collision' END AS section, key, id AS owner FROM e JOIN o USING (section, key)""",
)
def _(spark, d):
    """Names are cut short here, so that some collide."""
    g = service.tag_contracts(_variant(spark, d, 1995))
    return service.openapi(Graph(g.nodes.withColumn("name", F.substring("name", 1, 12)), g.edges)).select("section", "key", "owner")


@query("attribute_diff", with_(A, B) + "SELECT id, CASE WHEN a.calls <> b.calls THEN concat(a.calls, '>', b.calls) END AS calls, CASE WHEN a.back <> b.back THEN concat(a.back, '>', b.back) END AS back, 'back,calls' AS keys FROM ac a JOIN bc b USING (id)")
def _(spark, d):
    a, b = (_variant(spark, d, y).nodes.select("id", F.col("attrs").alias(n)) for y, n in ((1995, "x"), (1996, "y")))
    rows = a.join(b, "id").select("id", sets.attribute_diff(F.col("x"), F.col("y")).alias("diff"), F.array_join(service.union_of_keys(F.col("x"), F.col("y")), ",").alias("keys"))
    told = lambda n: F.array_join(F.try_element_at("diff", F.lit(n)), ">").alias(n)
    return rows.select("id", told("calls"), told("back"), "keys")


@query("mutations", with_(A) + "SELECT id, kind, CASE WHEN id = 'new' THEN '2.5' WHEN calls > 85 THEN '1.5' ELSE '' END AS weight FROM (SELECT id, kind, calls FROM ac UNION ALL SELECT 'new', 'type', 0)")
def _(spark, d):
    """A node added twice, an edge to nowhere, two updates of one weight and an activation."""
    g = _variant(spark, d, 1995)
    new = spark.createDataFrame([("new", "type"), ("new", "type"), ("s1", "other")], "id string, kind string").select("id", "kind", F.expr("cast(map() as map<string,string>)").alias("attrs"))
    edges = spark.createDataFrame([("new", "nowhere", "calls")], "src string, dst string, kind string")
    busy = g.nodes.where(F.col("attrs")["calls"].cast("int") > 85).select("id")
    weights = service.activate(busy, 1.5).unionByName(spark.createDataFrame([("new", 1.0), ("new", 1.5)], "id string, delta double"))
    known = g.nodes.where("id = 's1'").count()
    out = service.apply_mutations(g, new if known else new.where("id <> 's1'"), edges, weights)
    return out.nodes.select("id", "kind", service.attr("weight").alias("weight"))


@query("mutation_edges", with_(A) + "SELECT count(*)::BIGINT + 1 AS edges, true AS both_ends FROM ac WHERE back > 0")
def _(spark, d):
    g = _variant(spark, d, 1995)
    router = spark.createDataFrame([("router", "function"), ("sink", "type")], "id string, kind string").select("id", "kind", F.expr("cast(map() as map<string,string>)").alias("attrs"))
    edges = spark.createDataFrame([("router", "sink", "calls"), ("router", "sink", "calls"), ("router", "nowhere", "calls")], "src string, dst string, kind string")
    out = service.apply_mutations(g, router, edges)
    return out.edges.agg(F.count("*").alias("edges")).crossJoin(F.broadcast(out.dangling().agg((F.count("*") == 0).alias("both_ends"))))


FIRST = ", f AS (SELECT src, dst FROM edges ORDER BY src, dst LIMIT 1)"


def _first_edge(g: Graph) -> tuple[str, str]:
    r = g.edges.agg(F.min(F.struct("src", "dst")).alias("e")).first()["e"]
    return r["src"], r["dst"]


@query("mutate_redirect", with_(NATIONS) + FIRST + " SELECT src, CASE WHEN (src, dst) IN (SELECT (src, dst) FROM f) THEN 'HUB' ELSE dst END AS dst FROM edges")
def _(spark, d):
    g = derive.nations(spark, d)
    return service.redirect(g, *_first_edge(g), "HUB").edges.select("src", "dst")


@query("mutate_reverse", with_(NATIONS) + FIRST + " SELECT CASE WHEN (src, dst) IN (SELECT (src, dst) FROM f) THEN dst ELSE src END AS src, CASE WHEN (src, dst) IN (SELECT (src, dst) FROM f) THEN src ELSE dst END AS dst FROM edges")
def _(spark, d):
    g = derive.nations(spark, d)
    return sets.reverse_edge(g, *_first_edge(g)).edges.select("src", "dst")


@query("mutate_invert", with_(NATIONS) + FIRST + " SELECT src, CASE WHEN (src, dst) IN (SELECT (src, dst) FROM f) THEN 'PORT' ELSE dst END AS dst, kind FROM edges UNION ALL SELECT dst, 'PORT', 'implements' FROM f")
def _(spark, d):
    g = derive.nations(spark, d)
    return service.invert_dependency(g, *_first_edge(g), "PORT").edges.select("src", "dst", "kind")


@query("mutate_remove_edge", with_(NATIONS) + FIRST + " SELECT src, dst FROM edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM f)")
def _(spark, d):
    g = derive.nations(spark, d)
    return sets.remove_edge(g, *_first_edge(g)).edges.select("src", "dst")


@query("mutate_move", with_(NATIONS) + " SELECT id, CASE WHEN id = 'NATION_3' THEN 'ATLANTIS' ELSE grp END AS grp FROM nodes")
def _(spark, d):
    return sets.move(derive.nations(spark, d), "NATION_3", "ATLANTIS").nodes.select("id", "grp")


@query("explicit_roles", with_(SERVICES) + "SELECT id, CASE WHEN kind = 'type' THEN 'domain' WHEN kind = 'method' THEN 'adapter' ELSE '' END AS role, CASE WHEN kind = 'type' THEN 'explicit' WHEN kind = 'method' THEN 'inferred' ELSE '' END AS source FROM nodes")
def _(spark, d):
    g = derive.services(spark, d)
    explicit = g.nodes.where("kind = 'type'").select("id", F.lit("domain").alias("role"))
    inferred = g.nodes.where("kind in ('type', 'method')").select("id", F.lit("adapter").alias("role"))
    return service.set_roles(g.nodes, explicit, inferred).select("id", "role", "source")


@query("contract_build", with_(TREE) + ", w(name) AS (VALUES ('NATION_1'), ('NATION_2'), ('NATION_10'), ('nothing')) SELECT w.name, n.id, CASE WHEN n.id IS NULL THEN 'unresolved' WHEN n.name = 'NATION_2' OR n.grp = (SELECT grp FROM nodes WHERE name = 'NATION_10') THEN 'excluded' ELSE 'marked' END AS state FROM w LEFT JOIN nodes n USING (name)")
def _(spark, d):
    """A path rule and a package rule: a nation's file is region/name.go, its package the region."""
    g = derive.containment(spark, d)
    region = g.nodes.where("name = 'NATION_10'").first()["grp"]
    nodes = g.nodes.withColumn("file", F.concat_ws("/", "grp", "name")).withColumn("qname", F.concat_ws(".", "grp", "name"))
    return service.build_contracts(Graph(nodes, g.edges), ["NATION_1", "NATION_2", "NATION_10", "nothing"], ["NATION_2"], [region])


RULES = [("ASIA", "EUROPE", "far"), ("ASIA", "EUROPE", "again"), ("AFRICA", "ASIA", "no road"), ("unknown", "ASIA", "unlabelled")]


@query("coupling_rules", with_(NATIONS, "nn AS (SELECT id, CASE WHEN grp = 'AMERICA' THEN 'unknown' ELSE grp END AS g FROM nodes WHERE id <> 'NATION_4')", "gr AS (SELECT a.g AS fg, b.g AS tg FROM edges e JOIN nn a ON src = a.id JOIN nn b ON dst = b.id)") + "SELECT fg AS from_group, tg AS to_group, count(*)::BIGINT AS edges, reason FROM gr JOIN (VALUES ('ASIA', 'EUROPE', 'far'), ('AFRICA', 'ASIA', 'no road'), ('unknown', 'ASIA', 'unlabelled')) r(fg, tg, reason) USING (fg, tg) GROUP BY fg, tg, reason")
def _(spark, d):
    g = derive.nations(spark, d)
    nodes = g.nodes.withColumn("role", F.when(F.col("grp") == "AMERICA", "").otherwise(F.col("grp")))
    return service.coupling_violations(Graph(nodes, g.edges), RULES, spark.createDataFrame([("NATION_4",)], "id string"))


@query("targets", with_(SERVICES) + "SELECT t AS target, 'node' AS item, kind, count(*)::BIGINT AS n FROM nodes, (VALUES ('first'), ('second')) v(t) GROUP BY t, kind UNION ALL SELECT t, 'edge', kind, count(*) FROM edges, (VALUES ('first'), ('second')) v(t) GROUP BY t, kind")
def _(spark, d):
    """Targets of one graph, stored, listed and shown; those of another graph aren't among them."""
    store = Store(spark, Scratch(spark).path("store"))
    g = derive.services(spark, d)
    for graph_id, name in (("a", "first"), ("a", "second"), ("b", "third")):
        service.put_target(store, graph_id, name, g)
    shown = [service.show_target(store, "a", n).select(F.lit(n).alias("target"), "item", "kind", "n") for n in service.list_targets(store, "a")]
    return shown[0].unionByName(shown[1])


def _snapshot(spark, d, year: int):
    e = derive.trade(spark, d).edges.where(F.col("year") == year)
    metrics = e.groupBy("kind").agg(F.count("*").cast("double").alias("value")).select(F.lit("metric").alias("item"), F.col("kind").alias("name"), "value", F.lit("").alias("state"))
    busy = e.groupBy(F.col("dst").alias("name")).agg(F.count("*").cast("double").alias("value"))
    motifs = busy.where("value >= 50").select(F.lit("motif").alias("item"), "name", "value", F.lit("").alias("state"))
    state = F.when(F.col("value") >= 100, "match").otherwise("mismatch")
    return metrics.unionByName(motifs).unionByName(busy.where("name like 's%'").select(F.lit("pattern").alias("item"), "name", F.lit(0.0).alias("value"), state.alias("state")))


SNAPSHOT = """{p}b AS (SELECT dst AS name, count(*)::DOUBLE AS value FROM edges WHERE year = {y} GROUP BY dst),
{p} AS (SELECT 'metric' AS item, kind AS name, count(*)::DOUBLE AS value, '' AS state FROM edges WHERE year = {y} GROUP BY kind UNION ALL SELECT 'motif', name, value, '' FROM {p}b WHERE value >= 50 UNION ALL SELECT 'pattern', name, 0, CASE WHEN value >= 100 THEN 'match' ELSE 'mismatch' END FROM {p}b WHERE name LIKE 's%')"""


@query("catalog_drift", with_(TRADE, SNAPSHOT.format(p="x", y=1995), SNAPSHOT.format(p="y", y=1996)) + "SELECT item, name, CASE WHEN x.state IS NULL THEN 'added' WHEN y.state IS NULL THEN 'removed' ELSE 'changed' END AS change, x.value AS old, y.value AS new FROM x FULL JOIN y USING (item, name) WHERE x.state IS NULL OR y.state IS NULL OR abs(x.value - y.value) > 1e-9 OR x.state <> y.state")
def _(spark, d):
    return service.catalog_drift(_snapshot(spark, d, 1995), _snapshot(spark, d, 1996))


@query("catalog_upsert", "SELECT year(o_orderdate) AS label, CASE WHEN year(o_orderdate) = 1996 THEN -1 ELSE count(*) END::BIGINT AS value FROM orders GROUP BY 1 UNION ALL SELECT 3000, -1")
def _(spark, d):
    rows = derive.table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("label")).agg(F.count("*").alias("value"))
    return records.upsert(rows, spark.createDataFrame([(1996, -1), (3000, -1)], "label long, value long"))


@query("compare_metrics", with_(TRADE, sql.UNDIRECTED) + "SELECT 'pairs' AS metric, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM edges WHERE year = 1996))::DOUBLE - (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM edges WHERE year = 1995)) AS delta UNION ALL SELECT 'broken', 'nan'::DOUBLE")
def _(spark, d):
    e = derive.trade(spark, d).edges

    def told(year):
        n = e.where(F.col("year") == year).select("src", "dst").distinct().agg(F.count("*").cast("double").alias("value"))
        good = n.select(F.lit("pairs").alias("metric"), F.lit("graph").alias("scope"), "value")
        return good.unionByName(n.select(F.lit("broken").alias("metric"), F.lit("error").alias("scope"), F.lit(None).cast("double").alias("value")))

    return service.compare_metrics(told(1995), told(1996))


@query("search", with_(TREE) + "SELECT id, name FROM nodes WHERE kind <> 'file' AND (contains(lower(name), 'er#0000000') OR contains(lower(id), 'er#0000000')) ORDER BY id LIMIT 30")
def _(spark, d):
    return service.search(derive.containment(spark, d), "ER#0000000")


@query("visibility", with_(SERVICES) + "SELECT id, CASE WHEN kind = 'type' THEN 'internal' WHEN regexp_matches(name, '^[A-Z]') THEN 'public' ELSE 'private' END AS visibility FROM nodes")
def _(spark, d):
    g = derive.services(spark, d)
    given = F.when(F.col("kind") == "type", F.create_map(F.lit("visibility"), F.lit("internal"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    return g.nodes.withColumn("attrs", given).select("id", service.visibility().alias("visibility"))


@query("incident_edges", with_(SERVICES) + "SELECT id, kind, 'out' AS way, count(*)::BIGINT AS n FROM (SELECT src AS id, kind FROM edges) GROUP BY 1, 2 UNION ALL SELECT id, kind, 'in', count(*) FROM (SELECT dst AS id, kind FROM edges) GROUP BY 1, 2")
def _(spark, d):
    e = derive.services(spark, d).edges
    out = e.groupBy(F.col("src").alias("id"), "kind").agg(F.lit("out").alias("way"), F.count("*").alias("n"))
    return out.unionByName(e.groupBy(F.col("dst").alias("id"), "kind").agg(F.lit("in").alias("way"), F.count("*").alias("n")))


@query("forbidden_roles", with_(NATIONS, "gr AS (SELECT DISTINCT src, dst, a.role AS fr, b.role AS tr FROM edges e JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id)") + "SELECT 'forbidden_role_edges' AS pattern, CASE WHEN count(*) = 0 THEN 'match' ELSE 'mismatch' END AS status, count(*)::BIGINT AS edges FROM gr WHERE (fr, tr) IN (('AFRICA', 'ASIA'), ('ASIA', 'AMERICA')) UNION ALL SELECT 'domain_core', 'not_applicable', 0 ORDER BY 1")
def _(spark, d):
    """The forbidden-edges pattern with a table, and a pattern that doesn't apply to the graph."""
    deny = spark.createDataFrame([("AFRICA", "ASIA"), ("ASIA", "AMERICA")], "from_group string, to_group string")
    hits = sets.layer_mask(derive.nations(spark, d), deny).agg(F.count("*").alias("edges"))
    out = hits.select(F.lit("forbidden_role_edges").alias("pattern"), F.when(F.col("edges") == 0, "match").otherwise("mismatch").alias("status"), "edges")
    return out.unionByName(hits.select(F.lit("domain_core").alias("pattern"), F.lit("not_applicable").alias("status"), F.lit(0).cast("long").alias("edges")))


@query("contract_noise_kinds", with_(SERVICES) + "SELECT dst AS contract, src AS id, n.kind FROM edges JOIN nodes n ON src = n.id WHERE edges.kind IN ('returns', 'implements') AND src <> dst GROUP BY ALL")
def _(spark, d):
    g = derive.services(spark, d)
    return contracts.producers(g, g.nodes.where("kind = 'type'").select("id"))
