"""Views, diagrams, owners, labels and the architecture's model."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import views
from loomgraph.plans import oracle_graphs as sql
from loomgraph.plans.scratch import Scratch
from loomgraph.registry import query, with_
from loomgraph.sources import derive

NATIONS, TREE, SERVICES = sql.NATIONS, sql.CONTAINMENT, sql.SERVICES
#: The containment tree with nations as files: a supplier's or customer's package is its region.
UP = "up AS (SELECT dst AS id, src AS ancestor, 1 AS depth FROM edges UNION ALL SELECT u.id, e.src, depth + 1 FROM up u JOIN edges e ON u.ancestor = e.dst)"
OWN = ", own AS (SELECT id, id AS package FROM nodes WHERE kind = 'package' UNION ALL SELECT u.id, arg_min(ancestor, (depth, ancestor)) FROM up u JOIN nodes p ON ancestor = p.id AND p.kind = 'package' GROUP BY u.id)"


@query("owning_packages", with_(TREE, UP, recursive=True) + OWN + " SELECT id, package FROM own")
def _(spark, d):
    return views.owners(derive.containment(spark, d), Scratch(spark))


@query("nearest_roles", with_(TREE, UP, recursive=True) + ", n AS (SELECT id, CASE WHEN kind = 'package' THEN concat('role of ', id) ELSE '' END AS role FROM nodes), a AS (SELECT id, id AS a, 0 AS depth FROM n UNION ALL FROM up) SELECT a.id, arg_min(n.role, (depth, a.a)) AS role FROM a JOIN n ON a.a = n.id AND n.role <> '' GROUP BY a.id")
def _(spark, d):
    g = derive.containment(spark, d)
    named = g.nodes.withColumn("role", F.when(F.col("kind") == "package", F.concat(F.lit("role of "), "id")).otherwise(""))
    return views.nearest_role(Graph(named, g.edges), Scratch(spark))


@query("view_packages", with_(NATIONS) + "SELECT 'node' AS item, id AS a, '' AS b, 0 AS weight FROM nodes UNION ALL SELECT 'edge', src, dst, 2 FROM edges")
def _(spark, d):
    g = views.view(derive.nations(spark, d), "packages", Scratch(spark))
    return g.nodes.select(F.lit("node").alias("item"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit(0).alias("weight")).unionByName(g.edges.select(F.lit("edge").alias("item"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight"))


@query("view_structure", with_(TREE) + ", k AS (SELECT id FROM nodes ORDER BY id LIMIT 220) SELECT (SELECT count(*) FROM k)::BIGINT AS nodes, count(*)::BIGINT AS edges, coalesce(sum(3), 0)::BIGINT AS weight FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)")
def _(spark, d):
    g = views.view(derive.containment(spark, d), "structure", Scratch(spark))
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(g.edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))))


@query("view_package", with_(TREE, UP, recursive=True) + OWN + ", s AS (SELECT n.id FROM nodes n JOIN own USING (id) WHERE package = 'ASIA' AND kind IN ('type', 'function') AND regexp_matches(name, '^[A-Z]')) SELECT id FROM s UNION SELECT ancestor FROM up WHERE id IN (FROM s)")
def _(spark, d):
    return views.package_surface(derive.containment(spark, d), "ASIA", Scratch(spark))


@query("view_neighbourhood", with_(SERVICES) + ", a AS (SELECT 's1' AS id), nb AS (SELECT src AS id, dst AS o FROM edges UNION SELECT dst, src FROM edges), b AS (FROM a UNION SELECT o FROM nb WHERE id IN (FROM a)), c AS (FROM b UNION SELECT o FROM nb WHERE id IN (FROM b)) FROM c UNION SELECT src FROM edges WHERE kind = 'contains' AND dst IN (FROM c)")
def _(spark, d):
    return views.neighbourhood(derive.services(spark, d), spark.createDataFrame([("s1",), ("absent",)], "id string"), Scratch(spark), 2)


def _paths() -> str:
    return "p AS (SELECT DISTINCT concat(p_brand, '/', replace(p_type, ' ', '/')) AS name FROM part)"


@query("short_labels", "WITH " + _paths() + ", s AS (SELECT name, n, CASE WHEN len(string_split(name, '/')) <= n THEN name ELSE array_to_string(string_split(name, '/')[-n:], '/') END AS label FROM p, (SELECT unnest(range(1, 9)) AS n)), k AS (SELECT n, label FROM s GROUP BY 1, 2 HAVING count(DISTINCT name) = 1), b AS (SELECT name, arg_min(label, n) AS label FROM s JOIN k USING (n, label) GROUP BY name) SELECT p.name, coalesce(b.label, p.name) AS label FROM p LEFT JOIN b USING (name)")
def _(spark, d):
    return views.short_labels(derive.table(spark, d, "part").select(F.concat_ws("/", "p_brand", F.replace("p_type", F.lit(" "), F.lit("/"))).alias("name")))


@query("package_edges", with_(NATIONS) + "SELECT DISTINCT src, dst, e.kind FROM edges e JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.grp <> 'ASIA' AND b.grp <> 'ASIA' AND src <> dst")
def _(spark, d):
    g = derive.nations(spark, d)
    return views.package_edges(g, g.nodes.where("grp <> 'ASIA'").select("id"))


CHANGES = ", ch AS (SELECT id, CASE WHEN id LIKE 'c%1' THEN 'added' WHEN id LIKE 's%' AND grp LIKE '%1' THEN 'removed' WHEN id = 'ASIA' THEN 'added' WHEN id = 'EUROPE' THEN 'changed' END AS change FROM nodes WHERE id LIKE 'c%1' OR (id LIKE 's%' AND grp LIKE '%1') OR id IN ('ASIA', 'EUROPE'))"


def _changes(nodes):
    sold = F.col("id").startswith("s") & F.col("grp").endswith("1")
    change = F.when(F.col("id").startswith("c") & F.col("id").endswith("1"), "added").when(sold, "removed").when(F.col("id") == "ASIA", "added").when(F.col("id") == "EUROPE", "changed")
    return nodes.select("id", change.alias("change")).where("change is not null")


@query("diff_packages", with_(TREE, UP, recursive=True) + OWN + CHANGES + ", r AS (SELECT package, max(CASE WHEN id = package AND change <> 'changed' THEN change END) AS own, CASE WHEN count(DISTINCT change) = 1 THEN max(change) ELSE 'changed' END AS status, count(*) AS items FROM ch JOIN own USING (id) GROUP BY package) SELECT package, coalesce(own, CASE WHEN status IN ('added', 'removed') THEN 'changed' ELSE status END) AS status, items::BIGINT AS items FROM r")
def _(spark, d):
    g, s = derive.containment(spark, d), Scratch(spark)
    return views.diff_packages(_changes(g.nodes), views.owners(g, s))


@query("diff_overlay", with_(TREE) + CHANGES + ", v AS (SELECT id FROM nodes WHERE kind IN ('package', 'function')) SELECT v.id, coalesce(change, '') AS mark FROM v LEFT JOIN (SELECT * FROM ch WHERE change <> 'removed') c USING (id) UNION ALL SELECT id, 'removed' FROM ch WHERE change = 'removed' AND id NOT IN (FROM v)")
def _(spark, d):
    g = derive.containment(spark, d)
    return views.overlay(g.nodes.where("kind in ('package', 'function')"), _changes(g.nodes), g.nodes)


@query("diagram_clusters", with_(TREE, UP, recursive=True) + OWN + " SELECT n.id, n.name AS label, CASE WHEN n.kind = 'package' THEN '' ELSE coalesce(package, '') END AS cluster FROM nodes n LEFT JOIN own USING (id)")
def _(spark, d):
    return views.clusters(derive.containment(spark, d), Scratch(spark))


@query("diagrams", with_(NATIONS) + "SELECT 'package_deps' AS diagram, src, dst FROM edges WHERE src <> dst")
def _(spark, d):
    g = views.diagram(derive.nations(spark, d), "package_deps", Scratch(spark))
    return g.edges.select(F.lit("package_deps").alias("diagram"), "src", "dst")


@query("diagram_contracts", with_(SERVICES) + "SELECT DISTINCT src, dst FROM edges WHERE kind = 'implements'")
def _(spark, d):
    return views.diagram(derive.services(spark, d), "contract_port", Scratch(spark)).edges.select("src", "dst")


@query("diagram_calls", with_(SERVICES, "walk AS (SELECT min(src) AS id, 0 AS k FROM edges WHERE kind = 'calls' UNION SELECT dst, k + 1 FROM walk JOIN edges ON src = id AND kind = 'calls' WHERE k < 3)", recursive=True) + "SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls' AND src IN (SELECT id FROM walk) AND dst IN (SELECT id FROM walk)")
def _(spark, d):
    g = derive.services(spark, d)
    first = g.edges.where("kind = 'calls'").agg(F.min("src").alias("id"))
    return views.diagram(g, "call_flow", Scratch(spark), starts=first).edges.select("src", "dst")


@query("seed_resolution", "WITH p AS (SELECT concat('p', p_partkey) AS id, concat('ex.com/', p_brand, '.', p_name) AS qname FROM part), s(seed) AS (SELECT 'p7' UNION ALL SELECT min(p_name) FROM part UNION ALL SELECT 'nothing like it'), m AS (SELECT seed, CASE WHEN id = seed THEN 0 ELSE 1 END AS p, qname, id FROM s, p WHERE id = seed OR qname = seed OR ends_with(qname, '.' || seed) OR ends_with(qname, '/' || seed)) SELECT seed, arg_min(id, (p, qname, id)) AS id FROM m GROUP BY seed")
def _(spark, d):
    part = derive.table(spark, d, "part")
    nodes = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("ex.com/"), "p_brand", F.lit("."), "p_name").alias("qname"))
    out = None
    for seed in ("p7", part.agg(F.min("p_name")).first()[0], "nothing like it"):
        found = views.resolve_seed(nodes, seed).select(F.lit(seed).alias("seed"), "id")
        out = found if out is None else out.unionByName(found)
    return out


@query("architecture_model", with_(SERVICES, "nn AS (SELECT id, CASE WHEN id LIKE 'r:%' THEN 'package' ELSE kind END AS kind, name FROM nodes)", "ee AS (SELECT CASE WHEN kind = 'implements' THEN dst ELSE src END AS src, CASE WHEN kind = 'implements' THEN src ELSE dst END AS dst, CASE WHEN kind = 'implements' THEN 'contains' ELSE kind END AS kind FROM edges)") + "SELECT 'package' AS part, id, kind, name, '' AS owner FROM nn WHERE kind = 'package' UNION ALL SELECT 'symbol', n.id, n.kind, n.name, coalesce((SELECT min(src) FROM ee JOIN nn p ON src = p.id AND p.kind = 'package' WHERE ee.kind = 'contains' AND dst = n.id), '') FROM nn n WHERE kind <> 'package' UNION ALL SELECT DISTINCT 'dependency', concat(src, '->', dst), kind, '', '' FROM ee WHERE kind <> 'contains'")
def _(spark, d):
    """Regions as packages that contain their nations."""
    g = derive.services(spark, d)
    turn = F.col("kind") == "implements"
    edges = g.edges.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.when(turn, "contains").otherwise(F.col("kind")).alias("kind"), "seq")
    nodes = g.nodes.withColumn("kind", F.when(F.col("id").startswith("r:"), "package").otherwise(F.col("kind")))
    return views.model(Graph(nodes, edges), Scratch(spark))


@query("stereotypes", with_(NATIONS) + "SELECT DISTINCT role AS stereotype FROM nodes WHERE role <> '' UNION SELECT 'contract'")
def _(spark, d):
    g = derive.nations(spark, d)
    return views.stereotypes(g, g.nodes.where("grp = 'ASIA'").select("id"))


@query("package_projection", with_(TREE, UP, recursive=True) + OWN + """, s AS (SELECT package, kind, name FROM nodes JOIN own USING (id) WHERE kind IN ('type', 'function') AND id <> package AND regexp_matches(name, '^[A-Z]')),
r AS (SELECT DISTINCT package, kind, name FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY package, kind ORDER BY name) AS i FROM r), t AS (SELECT package, string_agg(name, ' ' ORDER BY CASE kind WHEN 'type' THEN 0 ELSE 1 END, i) AS text FROM q WHERE i <= CASE kind WHEN 'type' THEN 30 ELSE 40 END GROUP BY package)
SELECT n.id, concat('internal/', replace(n.id, ' ', '_'), '/x') AS path, concat('internal/', replace(n.id, ' ', '_')) AS grp, coalesce(text, '') AS text FROM nodes n LEFT JOIN t ON n.id = t.package WHERE n.kind = 'package'""")
def _(spark, d):
    g = derive.containment(spark, d)
    nodes = g.nodes.withColumn("qname", F.concat(F.lit("ex.com/m/internal/"), F.replace("id", F.lit(" "), F.lit("_")), F.lit("/x")))
    return views.package_projection(Graph(nodes, g.edges), Scratch(spark), "ex.com/m")


@query("region_files", "SELECT p_brand AS file, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS lines FROM part WHERE p_type IN (SELECT min(p_type) FROM part) GROUP BY p_brand")
def _(spark, d):
    part = derive.table(spark, d, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), "p_type")
    first = nodes.agg(F.min("p_type").alias("p_type"))
    out = views.region_files(Graph(nodes, nodes), nodes.join(F.broadcast(first), "p_type", "left_semi").select("id"))
    return out.select("file", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))
