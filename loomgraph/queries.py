"""Queries over the derived graphs, each with its DuckDB SQL where SQL can express it."""


from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.calculate import calculate
from loomgraph.functions import scalars
from loomgraph.graph import Graph
from loomgraph.operators import contracts, degrees, linalg, motifs, records, sets, statistics, traversal
from loomgraph.plans import oracle_graphs as sql
from loomgraph.plans.scratch import Scratch
from loomgraph.registry import ORACLES, QUERIES, query, r6, with_
from loomgraph.sources import derive
from loomgraph.streaming import transitions as stream

ALLOW = [("ASIA", "EUROPE"), ("EUROPE", "ASIA"), ("AMERICA", "ASIA"), ("AFRICA", "EUROPE"), ("EUROPE", "AMERICA")]
SINKS = ["MIDDLE EAST"]
DENY = [("AFRICA", "ASIA"), ("ASIA", "AMERICA"), ("EUROPE", "MIDDLE EAST")]


def _pairs(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "from_group string, to_group string")


def _values(rows: list[tuple[str, ...]]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"


GROUPED = "gr AS (SELECT e.*, a.grp AS fg, b.grp AS tg, a.role AS fr, b.role AS tr FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id)"
TRADE, NATIONS, TREE, PARTS = sql.TRADE, sql.NATIONS, sql.CONTAINMENT, sql.PARTS


# --- degrees and coupling ---------------------------------------------------------------------

BAG = "ca AS (SELECT dst AS id, count(*) AS ca FROM edges GROUP BY dst), ce AS (SELECT src AS id, count(*) AS ce FROM edges GROUP BY src)"


@query(
    "flagship_instability",
    with_(TRADE, BAG) + "SELECT n.id, coalesce(ca, 0)::BIGINT AS ca, coalesce(ce, 0)::BIGINT AS ce, round(CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0 END, 6) AS instability FROM nodes n LEFT JOIN ca USING (id) LEFT JOIN ce USING (id)",
)
def _(spark, d):
    return degrees.coupling(derive.trade(spark, d)).select("id", "ca", "ce", *r6("instability"))


FAN = sql.DIRECTED + ", o AS (SELECT src AS id, count(*) AS o FROM dir GROUP BY src), i AS (SELECT dst AS id, count(*) AS i FROM dir GROUP BY dst)"


@query("fan_in_out", with_(TRADE, FAN) + "SELECT n.id, coalesce(o, 0)::BIGINT AS fan_out, coalesce(i, 0)::BIGINT AS fan_in FROM nodes n LEFT JOIN o USING (id) LEFT JOIN i USING (id)")
def _(spark, d):
    return degrees.fan(derive.trade(spark, d))


@query("degree", with_(NATIONS) + ", x AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) SELECT n.id, count(x.id)::BIGINT AS degree FROM nodes n LEFT JOIN x USING (id) GROUP BY n.id")
def _(spark, d):
    return degrees.degree(derive.nations(spark, d))


@query("sinks", with_(TREE) + "SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE src <> dst)")
def _(spark, d):
    return degrees.sinks(derive.containment(spark, d))


@query("sources", with_(NATIONS) + "SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges WHERE src <> dst)")
def _(spark, d):
    return degrees.sources(derive.nations(spark, d))


@query("dead_items", with_(PARTS) + "SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges)")
def _(spark, d):
    g = derive.cooccurrence(spark, d)
    return degrees.dead_items(g.nodes, g.edges)


@query(
    "instability_records",
    with_(TRADE, FAN)
    + """, d AS (SELECT n.id, n.role, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM nodes n LEFT JOIN o USING (id) LEFT JOIN i USING (id) WHERE coalesce(o, 0) + coalesce(i, 0) > 0)
SELECT 'node' AS scope, id AS target, round(o / (o + i), 6) AS value FROM d UNION ALL SELECT 'region', role, round(sum(o) / sum(o + i), 6) FROM d GROUP BY role UNION ALL SELECT 'graph', '', round(avg(o / (o + i)), 6) FROM d""",
)
def _(spark, d):
    return degrees.instability(derive.trade(spark, d)).select("scope", "target", *r6("value"))


@query("quotient_multi", with_(TRADE, GROUPED) + "SELECT fg AS from_group, tg AS to_group, count(*)::BIGINT AS weight FROM gr WHERE fg <> tg GROUP BY fg, tg")
def _(spark, d):
    return degrees.quotient(derive.trade(spark, d))


@query("quotient_distinct", with_(TRADE, GROUPED) + "SELECT fg AS from_group, tg AS to_group, count(DISTINCT (src, dst))::BIGINT AS weight FROM gr WHERE fg <> tg GROUP BY fg, tg")
def _(spark, d):
    return degrees.quotient(derive.trade(spark, d), distinct=True)


@query("layer_collapse", with_(TRADE, GROUPED) + "SELECT fr AS from_group, tr AS to_group, count(DISTINCT (src, dst))::BIGINT AS edges FROM gr WHERE src <> dst GROUP BY fr, tr")
def _(spark, d):
    return degrees.layer_collapse(derive.trade(spark, d))


@query(
    "transpose_difference",
    with_(NATIONS, sql.DIRECTED) + ", o AS (SELECT * FROM dir ANTI JOIN (SELECT dst AS src, src AS dst FROM dir) r USING (src, dst)) SELECT src, dst, 1 AS sign FROM o UNION ALL SELECT dst, src, -1 FROM o",
)
def _(spark, d):
    return degrees.transpose_difference(derive.nations(spark, d).directed())


@query(
    "role_coupling",
    with_(NATIONS, GROUPED) + ", k AS (SELECT fr, tr, seq, concat(src, '->', dst) AS e, row_number() OVER (PARTITION BY fr, tr ORDER BY seq, concat(src, '->', dst)) AS r FROM gr) SELECT fr AS from_group, tr AS to_group, count(*)::BIGINT AS edges, string_agg(e, ',' ORDER BY r) FILTER (r <= 5) AS evidence FROM k GROUP BY fr, tr",
)
def _(spark, d):
    return degrees.role_coupling(derive.nations(spark, d))


@query(
    "purity_scores",
    with_(TRADE, GROUPED) + f", ok(fr, tr) AS {_values(ALLOW)} SELECT fr AS from_group, count(*)::BIGINT AS total, count(ok.fr)::BIGINT AS kept, round(count(ok.fr) / count(*), 6) AS purity FROM gr LEFT JOIN ok USING (fr, tr) GROUP BY fr",
)
def _(spark, d):
    return degrees.purity(derive.trade(spark, d), _pairs(spark, ALLOW)).select("from_group", "total", "kept", *r6("purity"))


@query("cut_quality", with_(TRADE, GROUPED) + "SELECT count(*) FILTER (fg = tg)::BIGINT AS intra, count(*) FILTER (fg <> tg)::BIGINT AS inter FROM gr")
def _(spark, d):
    return degrees.cut_quality(derive.trade(spark, d))


@query("community_tallies", with_(TRADE, GROUPED) + "SELECT least(fr, tr) AS a, greatest(fr, tr) AS b, count(*)::BIGINT AS edges FROM gr GROUP BY 1, 2")
def _(spark, d):
    return degrees.community_tallies(derive.trade(spark, d), "role")


MODULARITY = """
, m AS (SELECT count(*) AS m FROM und), l AS (SELECT id, {0} AS c FROM nodes),
dc AS (SELECT c, count(*) AS d FROM both_ways JOIN l USING (id) GROUP BY c),
lc AS (SELECT x.c, count(*) AS l FROM und JOIN l x ON a = x.id JOIN l y ON b = y.id WHERE x.c = y.c GROUP BY x.c)
SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 6) AS q FROM dc LEFT JOIN lc USING (c), m"""


@query("modularity_labels", with_(NATIONS, sql.UNDIRECTED) + MODULARITY.format("grp"))
def _(spark, d):
    return degrees.modularity(derive.nations(spark, d)).select(*r6("q"))


@query("modularity_containment", with_(TREE, sql.UNDIRECTED) + MODULARITY.format("coalesce(grp, '')"))
def _(spark, d):
    return degrees.modularity(derive.containment(spark, d)).select(*r6("q"))


@query(
    "label_entropy",
    with_(TREE)
    + """, c AS (SELECT DISTINCT src, dst FROM edges), k AS (SELECT src, n.kind, count(*) AS n FROM c JOIN nodes n ON dst = n.id GROUP BY src, n.kind),
t AS (SELECT src, sum(n) AS fan_out FROM k GROUP BY src HAVING sum(n) >= 5)
SELECT src, max(fan_out)::BIGINT AS fan_out, round(-sum(n / fan_out * log2(n / fan_out)), 6) + 0 AS entropy, round(-sum(n / fan_out * log2(n / fan_out)) * max(fan_out), 6) + 0 AS score FROM k JOIN t USING (src) GROUP BY src""",
)
def _(spark, d):
    return degrees.label_entropy(derive.containment(spark, d)).select("src", "fan_out", (F.round("entropy", 6) + 0.0).alias("entropy"), (F.round("score", 6) + 0.0).alias("score"))


@query(
    "file_statistics",
    with_(TREE) + ", f AS (SELECT n.id, count(e.dst) AS symbols FROM nodes n LEFT JOIN edges e ON e.src = n.id WHERE n.kind = 'file' GROUP BY n.id), m AS (SELECT median(symbols) AS median FROM f) SELECT id, symbols::BIGINT AS symbols, median::DOUBLE AS median, symbols >= greatest(3 * median, 20) AS outlier FROM f, m",
)
def _(spark, d):
    return degrees.file_statistics(derive.containment(spark, d))


@query(
    "majority_parent",
    with_(TRADE) + ", c AS (SELECT role AS community, grp AS parent, count(*) AS n FROM nodes GROUP BY 1, 2) SELECT community, arg_min(parent, (-n, parent)) AS parent, max(n)::BIGINT AS votes, sum(n)::BIGINT AS size FROM c GROUP BY community",
)
def _(spark, d):
    return degrees.majority_parent(derive.parties(spark, d).select(F.col("role").alias("community"), F.col("grp").alias("parent")))


# --- projections and filters ------------------------------------------------------------------


@query("undirected_projection", with_(NATIONS, sql.UNDIRECTED) + "SELECT a, b FROM und")
def _(spark, d):
    return derive.nations(spark, d).undirected()


@query("typed_dedup", with_(TRADE) + "SELECT src, dst, kind, min(seq)::BIGINT AS seq FROM edges GROUP BY src, dst, kind")
def _(spark, d):
    return derive.trade(spark, d).typed().edges.select("src", "dst", "kind", "seq")


@query("induced_subgraph", with_(TRADE) + ", s AS (SELECT id FROM nodes WHERE role = 'ASIA') SELECT src, dst, count(*)::BIGINT AS n FROM edges WHERE src IN (FROM s) AND dst IN (FROM s) AND kind IN ('calls', 'returns') GROUP BY src, dst")
def _(spark, d):
    g = derive.trade(spark, d)
    return g.induced(g.nodes.where("role = 'ASIA'").select("id")).of_kind("calls", "returns").edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("drop_foreign", with_(TRADE) + "SELECT count(*)::BIGINT AS edges, count(DISTINCT src)::BIGINT AS callers FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.role <> 'AFRICA' AND b.role <> 'AFRICA'")
def _(spark, d):
    return derive.trade(spark, d).without_foreign(F.col("role") == "AFRICA").edges.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("callers"))


@query("dangling_edges", with_(PARTS) + "SELECT src, dst, kind FROM edges WHERE (src NOT IN (SELECT id FROM nodes WHERE grp <> 'Brand#11') OR dst NOT IN (SELECT id FROM nodes WHERE grp <> 'Brand#11'))")
def _(spark, d):
    g = derive.cooccurrence(spark, d)
    return Graph(g.nodes.where("grp <> 'Brand#11'"), g.edges).dangling().select("src", "dst", "kind")


@query("graph_query", with_(TRADE) + "SELECT id, name FROM nodes WHERE kind = 'type' AND contains(lower(name), '1') AND starts_with(grp, 'NATION_1')")
def _(spark, d):
    return derive.parties(spark, d).where((F.col("kind") == "type") & F.lower("name").contains("1") & F.col("grp").startswith("NATION_1")).select("id", "name")


SELECTORS = [("nation/*/function", "edge"), ("nation/NATION_1*/**", "inner"), ("**/type", "adapter")]


@query(
    "role_globs",
    with_(TRADE) + "SELECT id, CASE WHEN regexp_matches(concat('nation/', grp, '/', kind), '^nation/[^/]*/function$') THEN 'edge' WHEN regexp_matches(concat('nation/', grp, '/', kind), '^nation/NATION_1[^/]*/.*$') THEN 'inner' WHEN regexp_matches(concat('nation/', grp, '/', kind), '^.*/type$') THEN 'adapter' ELSE '' END AS role FROM nodes",
)
def _(spark, d):
    return derive.parties(spark, d).select("id", scalars.resolve_role(F.concat(F.lit("nation/"), "grp", F.lit("/"), "kind"), SELECTORS).alias("role"))


@query("node_layers", with_(TREE) + "SELECT CASE WHEN kind IN ('package', 'file') THEN 'structure' WHEN kind = 'type' THEN 'model' ELSE 'behavior' END AS layer, count(*)::BIGINT AS nodes FROM nodes GROUP BY 1")
def _(spark, d):
    return derive.containment(spark, d).nodes.groupBy(scalars.node_layer(F.col("kind")).alias("layer")).agg(F.count("*").alias("nodes"))


@query("edge_kinds", with_(TRADE) + "SELECT kind, count(*)::BIGINT AS edges, count(DISTINCT (src, dst))::BIGINT AS pairs FROM edges GROUP BY kind")
def _(spark, d):
    return derive.trade(spark, d).edges.groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src", "dst").alias("pairs"))


# --- statistics and detectors -----------------------------------------------------------------

MZ = """, v AS (SELECT n.id, count(e.src) AS value FROM nodes n LEFT JOIN edges e ON e.dst = n.id GROUP BY n.id),
m AS (SELECT median(value) AS median FROM v), s AS (SELECT median(abs(value - median)) AS mad FROM v, m)"""


@query("modified_z", with_(TRADE) + MZ + " SELECT id, value::BIGINT AS value, median::DOUBLE AS median, mad::DOUBLE AS mad, round(CASE WHEN mad > 0 THEN 0.6745 * (value - median) / mad END, 6) AS z FROM v, m, s")
def _(spark, d):
    v = degrees.bag_degrees(derive.trade(spark, d)).select("id", F.col("ca").alias("value"))
    return statistics.modified_z(v).select("id", "value", "median", "mad", *r6("z"))


@query(
    "god_nodes",
    with_(TRADE)
    + """, i AS (SELECT dst AS id, count(*) AS i FROM edges WHERE src <> dst GROUP BY dst), o AS (SELECT src AS id, count(*) AS o FROM edges WHERE src <> dst GROUP BY src),
d AS (SELECT n.id, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM nodes n LEFT JOIN i USING (id) LEFT JOIN o USING (id)),
b AS (SELECT avg(i) + 2 * stddev_pop(i) AS bi, avg(o) + 2 * stddev_pop(o) AS bo FROM d) SELECT id, i::BIGINT AS fan_in, o::BIGINT AS fan_out FROM d, b WHERE i > bi OR o > bo""",
)
def _(spark, d):
    return statistics.god_nodes(derive.trade(spark, d))


@query("anomaly_rank", with_(NATIONS) + ", a AS (SELECT 'fan_in' AS metric, dst AS id, count(*)::DOUBLE AS score FROM edges GROUP BY dst UNION ALL SELECT 'weight', src, max(n)::DOUBLE FROM edges GROUP BY src) SELECT metric, id, score, row_number() OVER (ORDER BY score DESC, metric, id) AS rank FROM a")
def _(spark, d):
    e = derive.nations(spark, d).edges
    a = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("score")).select(F.lit("fan_in").alias("metric"), "id", "score")
    b = e.groupBy(F.col("src").alias("id")).agg(F.max("n").cast("double").alias("score")).select(F.lit("weight").alias("metric"), "id", "score")
    return statistics.rank_anomalies(a.unionByName(b))


@query("batch_topn", with_(TRADE) + "SELECT dst AS id, count(*)::BIGINT AS n FROM edges GROUP BY dst ORDER BY n DESC, id LIMIT 10")
def _(spark, d):
    return statistics.top(derive.trade(spark, d).edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), 10, F.desc("n"), F.col("id"))


@query("even_chunks", with_(NATIONS) + "SELECT id, ntile(4) OVER (ORDER BY id) AS chunk FROM nodes")
def _(spark, d):
    return statistics.even_chunks(derive.nations(spark, d).nodes.select("id"), 4)


@query("budgeted_batch", with_(NATIONS) + ", b AS (SELECT id, row_number() OVER (ORDER BY grp, id) AS place, sum(length(id) * 3 + 160) OVER (ORDER BY grp, id ROWS UNBOUNDED PRECEDING) AS spent FROM nodes) SELECT id, place, spent::BIGINT AS spent FROM b WHERE place <= 64 AND spent <= 2000")
def _(spark, d):
    rows = derive.nations(spark, d).nodes.select("id", "grp")
    return statistics.budgeted(rows, F.length("id") * 3 + 160, 2000, "grp", "id", cap=64).select("id", "place", "spent")


@query("size_histogram", with_(TREE) + ", g AS (SELECT grp, count(*) AS size FROM nodes GROUP BY grp) SELECT size::BIGINT AS size, count(*)::BIGINT AS groups FROM g GROUP BY size")
def _(spark, d):
    return statistics.histogram(derive.containment(spark, d).nodes, "grp")


@query("orphan_bucket", with_(PARTS) + ", o AS (SELECT kind, count(*) AS n FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges) GROUP BY kind) SELECT kind, n::BIGINT AS orphans, CASE WHEN n >= 25 THEN 'high' WHEN n >= 10 THEN 'medium' WHEN n >= 3 THEN 'low' ELSE 'info' END AS severity FROM o")
def _(spark, d):
    return statistics.orphans(derive.cooccurrence(spark, d))


@query(
    "duplicate_titles",
    "WITH k AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^\\pL\\pN]+', ' ', 'g')) AS title FROM part) SELECT title, count(*)::BIGINT AS n, min(id) AS first_id, CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) >= 5 THEN 'medium' WHEN count(*) >= 3 THEN 'low' ELSE 'info' END AS severity FROM k WHERE title <> '' GROUP BY title HAVING count(*) >= 2",
)
def _(spark, d):
    return statistics.duplicate_titles(derive.table(spark, d, "part").withColumnRenamed("p_partkey", "id"), "p_name")


@query("structural_parent", with_(TREE) + "SELECT dst AS id, min(src) AS parent FROM edges WHERE src <> dst GROUP BY dst")
def _(spark, d):
    return statistics.structural_parent(derive.containment(spark, d))


@query(
    "flat_star",
    with_(TREE)
    + """, u AS (SELECT DISTINCT src, dst FROM edges), r AS (SELECT u.src, count(*) AS c, count(*) FILTER (u.dst NOT IN (SELECT src FROM u)) AS l FROM u GROUP BY u.src)
SELECT src AS id, c::BIGINT AS children, l::BIGINT AS leaves, ceil(l / 12)::BIGINT AS groups, c - l + ceil(l / 12) <= 12 AS feasible, round(c / 12 * (l / c), 6) AS score FROM r WHERE c > 12 AND l / c >= 0.7""",
)
def _(spark, d):
    return statistics.flat_stars(derive.containment(spark, d)).select("id", "children", "leaves", "groups", "feasible", *r6("score"))


@query(
    "sweep_cut",
    with_(NATIONS, sql.UNDIRECTED)
    + """, w AS (SELECT id, count(*) AS deg FROM both_ways GROUP BY id), k AS (SELECT n.id, row_number() OVER (ORDER BY coalesce(deg, 0) DESC, n.id) AS place, coalesce(deg, 0) AS deg FROM nodes n LEFT JOIN w USING (id)),
t AS (SELECT sum(deg) AS t FROM k), p AS (SELECT k.place, k.id, (SELECT count(*) FROM und JOIN k x ON a = x.id JOIN k y ON b = y.id WHERE (x.place <= k.place) <> (y.place <= k.place)) AS cut, (SELECT sum(deg) FROM k z WHERE z.place <= k.place) AS volume FROM k)
SELECT place, id, cut::BIGINT AS cut, volume::BIGINT AS volume, round(cut / least(volume, t - volume), 6) AS conductance FROM p, t WHERE least(volume, t - volume) > 0""",
)
def _(spark, d):
    g = derive.nations(spark, d)
    w = g.nodes.select("id").join(g.neighbours().groupBy("id").agg(F.count("*").alias("w")), "id", "left").select("id", F.coalesce("w", F.lit(0)).alias("weight"))
    return statistics.sweep_cut(g, w).select("place", "id", "cut", "volume", *r6("conductance"))


# --- traversal and fix-points -----------------------------------------------------------------


@query("neighbors", with_(TRADE) + ", s AS (SELECT id FROM nodes WHERE kind = 'type') SELECT dst AS id, src AS other FROM edges WHERE kind = 'calls' AND dst IN (FROM s) GROUP BY 1, 2")
def _(spark, d):
    g = derive.trade(spark, d)
    return traversal.neighbors(g, g.nodes.where("kind = 'type'").select("id"), "in", ("calls",))


@query("khop", with_(PARTS, sql.UNDIRECTED, "walk AS (SELECT 'p1' AS id, 0 AS depth UNION SELECT other, depth + 1 FROM walk JOIN both_ways USING (id) WHERE depth < 3)", recursive=True) + "SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id")
def _(spark, d):
    g = derive.cooccurrence(spark, d)
    return traversal.khop(g, spark.createDataFrame([("p1",)], "id string"), 3, Scratch(spark))


@query("reachable", with_(NATIONS, sql.DIRECTED, "walk AS (SELECT 'NATION_7' AS id UNION SELECT dst FROM walk JOIN dir ON src = id)", recursive=True) + "SELECT id FROM walk")
def _(spark, d):
    return traversal.reachable(derive.nations(spark, d).directed(), spark.createDataFrame([("NATION_7",)], "id string"), Scratch(spark)).select("id")


PATHS = "walk AS (SELECT '{0}' AS id, ['{0}'] AS path UNION ALL SELECT dst, list_append(path, dst) FROM walk JOIN dir ON src = id WHERE len(path) < 7 AND NOT list_contains(path, dst))"


@query("shortest_path", with_(NATIONS, sql.DIRECTED, PATHS.format("NATION_7"), recursive=True) + ", b AS (SELECT id, min(len(path)) AS n FROM walk GROUP BY id) SELECT w.id, (n - 1)::INTEGER AS hops, array_to_string(min(path), '>') AS path FROM walk w JOIN b ON w.id = b.id AND len(path) = n GROUP BY w.id, n")
def _(spark, d):
    return traversal.shortest_paths(derive.nations(spark, d).directed(), "NATION_7", Scratch(spark), 6).select("id", "hops", F.array_join("path", ">").alias("path"))


CLOSURE = "reach AS (SELECT src, dst FROM dir UNION SELECT r.src, d.dst FROM reach r JOIN dir d ON r.dst = d.src)"


@query("transitive_closure", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + "SELECT src, dst FROM reach")
def _(spark, d):
    return traversal.closure(derive.nations(spark, d).directed(), Scratch(spark))


@query("weak_components", with_(PARTS, sql.UNDIRECTED, "walk AS (SELECT id, id AS c FROM nodes UNION SELECT b.other, w.c FROM walk w JOIN both_ways b ON w.id = b.id WHERE w.c < b.other)", recursive=True) + "SELECT id, min(c) AS component FROM walk GROUP BY id")
def _(spark, d):
    return traversal.components(derive.cooccurrence(spark, d), Scratch(spark))


SCC = ", s AS (SELECT a.src AS id, min(a.dst) AS m FROM reach a JOIN reach b ON a.dst = b.src AND b.dst = a.src GROUP BY a.src)"


@query("strong_components", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + SCC + "SELECT n.id, least(n.id, coalesce(m, n.id)) AS scc FROM nodes n LEFT JOIN s USING (id)")
def _(spark, d):
    g = derive.nations(spark, d)
    return traversal.strong_components(g.nodes, g.directed(), Scratch(spark))


@query("cycle_rank", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + SCC + ", z AS (SELECT least(id, m) AS scc, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1) SELECT scc, n::BIGINT AS size FROM z")
def _(spark, d):
    g = derive.nations(spark, d)
    return traversal.strong_components(g.nodes, g.directed(), Scratch(spark)).groupBy("scc").agg(F.count("*").alias("size")).where("size > 1")


@query(
    "cycle_lengths",
    with_(NATIONS, sql.DIRECTED, "walk AS (SELECT src AS o, dst AS t, 1 AS k FROM dir UNION SELECT o, dst, k + 1 FROM walk JOIN dir ON t = src WHERE k < 8)", recursive=True) + "SELECT o AS id, min(k)::INTEGER AS length FROM walk WHERE o = t GROUP BY o",
)
def _(spark, d):
    return traversal.cycle_lengths(derive.nations(spark, d).directed(), Scratch(spark))


@query("topological_levels", with_(TREE, sql.DIRECTED, "walk AS (SELECT id, 0 AS l FROM nodes UNION SELECT dst, l + 1 FROM walk JOIN dir ON src = id)", recursive=True) + "SELECT id, max(l)::INTEGER AS level FROM walk GROUP BY id")
def _(spark, d):
    g = derive.containment(spark, d)
    return traversal.topological_levels(g.nodes, g.directed(), Scratch(spark))


@query("quotient_acyclic", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + "SELECT count(*) FILTER (src = dst) = 0 AS acyclic FROM reach")
def _(spark, d):
    g = derive.nations(spark, d)
    return traversal.acyclic(g.nodes, g.directed(), Scratch(spark))


@query("contains_tree", with_(TREE, "up AS (SELECT dst AS id, src AS ancestor, 1 AS depth FROM edges UNION ALL SELECT u.id, e.src, depth + 1 FROM up u JOIN edges e ON u.ancestor = e.dst)", recursive=True) + "SELECT id, ancestor, depth::INTEGER AS depth FROM up")
def _(spark, d):
    return traversal.containment_ancestors(derive.containment(spark, d), Scratch(spark))


def _ppr_sql(rounds: int, seed: str) -> str:
    out = [NATIONS, "t AS (SELECT src, count(*) AS t FROM edges GROUP BY src)", "st AS (SELECT e.src, e.dst, count(*) / max(t) AS share FROM edges e JOIN t USING (src) GROUP BY e.src, e.dst)"]
    out.append(f"h AS (SELECT id, CASE WHEN {seed} THEN 1.0 / (SELECT count(*) FROM nodes WHERE {seed}) ELSE 0 END::DOUBLE AS home, id NOT IN (SELECT src FROM t) AS dangling FROM nodes)")
    out.append("s0 AS MATERIALIZED (SELECT id, home AS score FROM h)")
    for i in range(rounds):
        out.append(
            f"s{i + 1} AS MATERIALIZED (SELECT h.id, 0.15 * home + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(score), 0) FROM s{i} JOIN h USING (id) WHERE dangling) * home) AS score "
            f"FROM h LEFT JOIN (SELECT dst AS id, sum(score * share) AS got FROM s{i} JOIN st ON s{i}.id = st.src GROUP BY dst) g USING (id))"
        )
    return "WITH " + ",\n".join(out) + f" SELECT id, round(score, 6) AS score FROM s{rounds}"


@query("personalised_pagerank", _ppr_sql(10, "grp = 'ASIA'"))
def _(spark, d):
    g = derive.nations(spark, d)
    return traversal.pagerank(g.nodes, g.edges, Scratch(spark), g.nodes.where("grp = 'ASIA'").select("id"), rounds=10).select("id", *r6("score"))


@query("pagerank", _ppr_sql(8, "true"))
def _(spark, d):
    g = derive.nations(spark, d)
    return traversal.pagerank(g.nodes, g.edges, Scratch(spark), rounds=8).select("id", *r6("score"))


WL1 = """
, n1 AS (SELECT src AS id, '>' || kind AS e, dst AS o FROM edges UNION ALL SELECT dst, '<' || kind, src FROM edges),
c AS (SELECT n1.id, e, n.kind AS l, count(*) AS n FROM n1 JOIN nodes n ON n1.o = n.id GROUP BY n1.id, e, n.kind),
s AS (SELECT id, string_agg(concat_ws(':', e, l, n), ',' ORDER BY concat_ws(':', e, l, n)) AS s FROM c GROUP BY id)
SELECT n.id, md5(concat_ws('|', n.kind, coalesce(s, ''))) AS label FROM nodes n LEFT JOIN s USING (id)"""


@query("wl_labels", with_(TREE) + WL1)
def _(spark, d):
    return traversal.wl_labels(derive.containment(spark, d), Scratch(spark), 1)


# --- triangles, curvature, motifs -------------------------------------------------------------

TRIANGLES = ", t AS (SELECT x.a AS x, x.b AS y, y.b AS z FROM und x JOIN und y ON x.b = y.a JOIN und w ON w.a = x.a AND w.b = y.b)"


@query("triangles", with_(PARTS, sql.UNDIRECTED) + TRIANGLES + "SELECT x, y, z FROM t")
def _(spark, d):
    return motifs.triangles(derive.cooccurrence(spark, d))


CURVATURE = (
    TRIANGLES
    + """, d AS (SELECT id, count(*) AS d FROM both_ways GROUP BY id), s AS (SELECT x AS a, y AS b FROM t UNION ALL SELECT x, z FROM t UNION ALL SELECT y, z FROM t), c AS (SELECT a, b, count(*) AS n FROM s GROUP BY a, b),
k AS (SELECT u.a, u.b, coalesce(n, 0)::BIGINT AS triangles, (4 - p.d - q.d + 3 * coalesce(n, 0))::BIGINT AS kappa FROM und u LEFT JOIN c USING (a, b) JOIN d p ON u.a = p.id JOIN d q ON u.b = q.id)"""
)


@query("curvature", with_(PARTS, sql.UNDIRECTED) + CURVATURE + "SELECT * FROM k")
def _(spark, d):
    return motifs.curvature(derive.cooccurrence(spark, d))


@query("curvature_tail", with_(PARTS, sql.UNDIRECTED) + CURVATURE + "SELECT a, b, kappa FROM k ORDER BY kappa, a, b LIMIT 10")
def _(spark, d):
    return statistics.top(motifs.curvature(derive.cooccurrence(spark, d), 10), 10, F.col("kappa"), F.col("a"), F.col("b")).select("a", "b", "kappa")


@query("two_hop", with_(NATIONS, sql.UNDIRECTED) + "SELECT id, other FROM both_ways UNION SELECT a.id, b.other FROM both_ways a JOIN both_ways b ON a.other = b.id WHERE a.id <> b.other")
def _(spark, d):
    return motifs.two_hop(derive.nations(spark, d))


SIGNATURES = """, n1 AS (SELECT src AS id, 'out:' || kind AS e FROM edges UNION ALL SELECT dst, 'in:' || kind FROM edges), c AS (SELECT id, e, count(*) AS n FROM n1 GROUP BY id, e),
s AS (SELECT n.id, concat_ws('|', max(n.kind), coalesce(string_agg(concat_ws('=', e, c.n), ';' ORDER BY concat_ws('=', e, c.n)), '')) AS signature FROM nodes n LEFT JOIN c USING (id) GROUP BY n.id)"""


@query("role_signatures", with_(NATIONS) + SIGNATURES + "SELECT id, signature FROM s")
def _(spark, d):
    return motifs.role_signatures(derive.nations(spark, d))


@query(
    "local_symmetry",
    with_(NATIONS, sql.UNDIRECTED) + SIGNATURES + ", h AS (SELECT id, other FROM both_ways UNION SELECT a.id, b.other FROM both_ways a JOIN both_ways b ON a.other = b.id WHERE a.id <> b.other), w AS (SELECT h.id, count(*) AS n FROM h JOIN s x ON h.id = x.id JOIN s y ON h.other = y.id WHERE x.signature = y.signature GROUP BY h.id) SELECT n.id, coalesce(w.n, 0)::BIGINT AS twins FROM nodes n LEFT JOIN w USING (id)",
)
def _(spark, d):
    return motifs.local_symmetry(derive.nations(spark, d))


@query(
    "motif3",
    with_(TRADE, sql.UNDIRECTED)
    + TRIANGLES
    + """, tk AS (SELECT list_sort([a.kind, b.kind, c.kind]) AS k FROM t JOIN nodes a ON x = a.id JOIN nodes b ON y = b.id JOIN nodes c ON z = c.id),
p AS (SELECT m.kind AS k, least(a.kind, b.kind) AS k1, greatest(a.kind, b.kind) AS k2 FROM both_ways u JOIN both_ways v ON u.id = v.id AND u.other < v.other ANTI JOIN und w ON w.a = least(u.other, v.other) AND w.b = greatest(u.other, v.other) JOIN nodes m ON u.id = m.id JOIN nodes a ON u.other = a.id JOIN nodes b ON v.other = b.id)
SELECT 'triangle' AS shape, array_to_string(k, ',') AS kinds, count(*)::BIGINT AS n FROM tk GROUP BY 2 UNION ALL SELECT 'path', concat(k, '(', k1, ',', k2, ')'), count(*)::BIGINT FROM p GROUP BY 2""",
)
def _(spark, d):
    return motifs.motif3(derive.trade(spark, d))


# --- sets and rules ---------------------------------------------------------------------------


def _year(spark, d, year):
    g = derive.trade(spark, d)
    edges = g.edges.where(F.col("year") == year)
    return Graph(g.nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_semi"), edges)


YEARS = ", e1 AS (SELECT DISTINCT concat_ws('|', src, kind, dst) AS key FROM edges WHERE year = 1995), e2 AS (SELECT DISTINCT concat_ws('|', src, kind, dst) AS key FROM edges WHERE year = 1996), n1 AS (SELECT src AS id FROM edges WHERE year = 1995 UNION SELECT dst FROM edges WHERE year = 1995), n2 AS (SELECT src AS id FROM edges WHERE year = 1996 UNION SELECT dst FROM edges WHERE year = 1996)"


@query(
    "graph_diff",
    with_(TRADE) + YEARS + " SELECT 'node' AS item, id AS key, 'removed' AS change FROM n1 ANTI JOIN n2 USING (id) UNION ALL SELECT 'node', id, 'added' FROM n2 ANTI JOIN n1 USING (id) UNION ALL SELECT 'edge', key, 'removed' FROM e1 ANTI JOIN e2 USING (key) UNION ALL SELECT 'edge', key, 'added' FROM e2 ANTI JOIN e1 USING (key)",
)
def _(spark, d):
    return sets.diff(_year(spark, d, 1995), _year(spark, d, 1996))


@query("graph_merge", with_(TRADE) + YEARS + " SELECT (SELECT count(*) FROM (FROM n1 UNION FROM n2))::BIGINT AS nodes, (SELECT count(*) FROM (FROM e1 UNION FROM e2))::BIGINT AS edges")
def _(spark, d):
    g = sets.merge(_year(spark, d, 1995), _year(spark, d, 1996))
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges")))


@query("metric_drift", with_(TRADE) + ", a AS (SELECT kind AS metric, count(*)::DOUBLE AS before FROM edges WHERE year = 1995 GROUP BY 1), b AS (SELECT kind AS metric, count(*)::DOUBLE AS after FROM edges WHERE year = 1996 GROUP BY 1) SELECT metric, before, after, after - before AS delta FROM a FULL JOIN b USING (metric)")
def _(spark, d):
    e = derive.trade(spark, d).edges
    count = lambda y: e.where(F.col("year") == y).groupBy(F.col("kind").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return sets.drift(count(1995), count(1996))


@query("variant_counts", with_(TRADE) + "SELECT year::INTEGER AS year, count(*)::BIGINT AS edges, count(DISTINCT src)::BIGINT AS sources FROM edges GROUP BY year")
def _(spark, d):
    return derive.trade(spark, d).edges.groupBy("year").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


@query(
    "policy_residual",
    with_(TRADE, GROUPED) + f", ok(fr, tr) AS {_values(ALLOW)} SELECT DISTINCT src, dst, fr AS from_group, tr AS to_group FROM gr WHERE fr <> tr AND (fr IN ('MIDDLE EAST') OR (fr, tr) NOT IN (SELECT (fr, tr) FROM ok))",
)
def _(spark, d):
    sinks = spark.createDataFrame([(x,) for x in SINKS], "from_group string")
    return sets.policy_residual(derive.trade(spark, d), _pairs(spark, ALLOW), sinks)


@query("baseline_policy", with_(NATIONS, GROUPED) + "SELECT DISTINCT fg AS from_group, tg AS to_group FROM gr WHERE fg <> tg")
def _(spark, d):
    return sets.baseline_policy(derive.nations(spark, d))


@query("layer_mask", with_(NATIONS, GROUPED) + f", no(fr, tr) AS {_values(DENY)} SELECT DISTINCT src, dst, fr AS from_group, tr AS to_group FROM gr JOIN no USING (fr, tr) WHERE src <> dst")
def _(spark, d):
    return sets.layer_mask(derive.nations(spark, d), _pairs(spark, DENY))


@query("mutate_merge_node", with_(NATIONS) + ", e AS (SELECT CASE WHEN src = 'NATION_3' THEN 'NATION_5' ELSE src END AS src, CASE WHEN dst = 'NATION_3' THEN 'NATION_5' ELSE dst END AS dst FROM edges) SELECT src, dst, count(*)::BIGINT AS n FROM e WHERE src <> dst GROUP BY src, dst")
def _(spark, d):
    return sets.merge_node(derive.nations(spark, d), "NATION_3", "NATION_5").edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("mutate_introduce", with_(NATIONS) + "SELECT src, CASE WHEN dst = 'NATION_3' THEN 'GATE' ELSE dst END AS dst FROM edges UNION ALL SELECT 'GATE', 'NATION_3'")
def _(spark, d):
    return sets.introduce(derive.nations(spark, d), "GATE", "package", "NATION_3").edges.select("src", "dst")


@query("accumulate", "SELECT event_type AS id, round(sum(value), 4) AS weight FROM events GROUP BY event_type")
def _(spark, d):
    rows = derive.table(spark, d, "events").select(F.col("event_type").alias("id"), F.col("value").alias("delta"))
    return sets.accumulate(rows).select("id", F.round("weight", 4).alias("weight"))


# --- vectors and dense kernels ----------------------------------------------------------------


def _vectors(spark, d):
    return derive.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


@query(
    "kmeans_assign",
    "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings), c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, vec AS centroid FROM (FROM v ORDER BY id LIMIT 4)), x AS (SELECT id, cluster, list_sum(list_transform(list_zip(vec, centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dd FROM v, c) SELECT id, arg_min(cluster, (dd, cluster))::INTEGER AS cluster FROM x GROUP BY id",
)
def _(spark, d):
    return linalg.kmeans(_vectors(spark, d), 4, Scratch(spark), rounds=0).select("id", "cluster")


def _kmeans_sql(rounds: int) -> str:
    out = ["v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)", "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, vec AS centroid FROM (FROM v ORDER BY id LIMIT 4))"]
    for i in range(rounds + 1):
        out.append(f"x{i} AS MATERIALIZED (SELECT id, arg_min(cluster, (dd, cluster)) AS cluster, min(dd) AS dd FROM (SELECT id, cluster, list_sum(list_transform(list_zip(vec, centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dd FROM v, c{i}) GROUP BY id)")
        cells = f"SELECT cluster, i, avg(e) AS e FROM (SELECT cluster, unnest(vec) AS e, unnest(range(len(vec))) AS i FROM v JOIN x{i} USING (id)) GROUP BY cluster, i"
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m.mean, c{i}.centroid) AS centroid FROM c{i} LEFT JOIN (SELECT cluster, list(e ORDER BY i) AS mean FROM ({cells}) GROUP BY cluster) m USING (cluster))")
    return "WITH " + ", ".join(out) + f" SELECT cluster::INTEGER AS cluster, count(*)::BIGINT AS members, round(sum(dd), 4) AS inertia FROM x{rounds} GROUP BY cluster"


@query("kmeans", _kmeans_sql(4))
def _(spark, d):
    return linalg.kmeans(_vectors(spark, d), 4, Scratch(spark), rounds=4).groupBy("cluster").agg(F.count("*").alias("members"), F.round(F.sum("distance"), 4).alias("inertia"))


@query("laplacian_spectrum", with_(PARTS, sql.UNDIRECTED, "walk AS (SELECT id, id AS c FROM nodes UNION SELECT b.other, w.c FROM walk w JOIN both_ways b ON w.id = b.id WHERE w.c < b.other)", recursive=True) + ", p AS (SELECT id, min(c) AS c FROM walk GROUP BY id) SELECT count(*)::BIGINT AS nodes, count(DISTINCT c)::BIGINT AS components, round((SELECT 2 * count(*) FROM und), 4)::DOUBLE AS total FROM p")
def _(spark, d):
    g, scratch = derive.cooccurrence(spark, d), Scratch(spark)
    s = linalg.spectral_summary(linalg.laplacian_spectrum(g, scratch)) if linalg.fits_kernel(g, scratch) else linalg.summary_by_joins(g, scratch)
    return s.select("nodes", "components", F.round("total", 4).alias("total"))


@query("spectral_gap")
def _(spark, d):
    return linalg.spectral_summary(linalg.laplacian_spectrum(derive.nations(spark, d), Scratch(spark)))


@query("trophic_levels")
def _(spark, d):
    return linalg.trophic_levels(derive.nations(spark, d), Scratch(spark))


@query("trophic_incoherence")
def _(spark, d):
    g, s = derive.nations(spark, d), Scratch(spark)
    return linalg.trophic_incoherence(g, s.save(linalg.trophic_levels(g, s)))


@query("articulation_points")
def _(spark, d):
    return linalg.articulation_points(derive.cooccurrence(spark, d), Scratch(spark))


@query(
    "articulation_services",
    with_(
        sql.SERVICES,
        sql.UNDIRECTED,
        "w0 AS (SELECT id, id AS c FROM nodes UNION SELECT b.other, w.c FROM w0 w JOIN both_ways b ON w.id = b.id WHERE w.c < b.other)",
        "walk AS (SELECT x.id AS gone, n.id, n.id AS c FROM nodes x, nodes n WHERE x.id <> n.id UNION SELECT w.gone, b.other, w.c FROM walk w JOIN both_ways b ON w.id = b.id AND b.other <> w.gone WHERE w.c < b.other)",
        recursive=True,
    )
    + """, root AS (SELECT id AS gone, min(c) AS r FROM w0 GROUP BY id), p AS (SELECT gone, id, min(c) AS c FROM walk GROUP BY gone, id),
first AS (SELECT id AS gone, min(other) AS f FROM both_ways GROUP BY id), near AS (SELECT DISTINCT p.gone, p.c FROM p JOIN both_ways b ON b.id = p.gone AND b.other = p.id),
size AS (SELECT p.gone, p.c, count(*) AS n, max(p.id = r) AS has_root, max(p.id = f) AS has_first, max(p.gone = r) AS is_root FROM p JOIN near USING (gone, c) JOIN root USING (gone) JOIN first USING (gone) GROUP BY p.gone, p.c),
cut AS (SELECT gone FROM size GROUP BY gone HAVING count(*) > 1)
SELECT gone AS id, max(n)::BIGINT AS guarded FROM size JOIN cut USING (gone) WHERE CASE WHEN is_root THEN NOT has_first ELSE NOT has_root END GROUP BY gone""",
)
def _(spark, d):
    return linalg.articulation_points(derive.services(spark, d), Scratch(spark))


def power_sql(rounds: int) -> str:
    """Power steps from equal entries; the nations that trade form one component."""
    out = [NATIONS, sql.UNDIRECTED, "x0 AS MATERIALIZED (SELECT id, 1 / sqrt(count(*) OVER ()) AS x FROM (SELECT DISTINCT id FROM both_ways))"]
    for i in range(rounds):
        out.append(f"y{i} AS MATERIALIZED (SELECT b.id, sum(x) AS y FROM both_ways b JOIN x{i} ON b.other = x{i}.id GROUP BY b.id), x{i + 1} AS MATERIALIZED (SELECT id, y / sqrt((SELECT sum(y * y) FROM y{i})) AS x FROM y{i})")
    return "WITH " + ",\n".join(out) + f" SELECT id, round(x, 6) AS centrality FROM x{rounds}"


@query("eigen_centrality", power_sql(100))
def _(spark, d):
    return linalg.eigen_centrality(derive.nations(spark, d), Scratch(spark)).select("id", *r6("centrality"))


@query("louvain")
def _(spark, d):
    return linalg.louvain(derive.cooccurrence(spark, d), Scratch(spark))


@query("spectral_bisection")
def _(spark, d):
    return linalg.spectral_bisection(derive.nations(spark, d), Scratch(spark))


# --- events as a graph ------------------------------------------------------------------------


@query("event_transitions", "WITH " + sql.TRANSITIONS + " SELECT src, dst, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM steps GROUP BY src, dst")
def _(spark, d):
    return derive.transitions(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    out = stream.windowed_counts(derive.table(spark, d, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query(
    "event_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*)::BIGINT AS events FROM s GROUP BY user_id, n",
)
def _(spark, d):
    out = stream.sessions(derive.table(spark, d, "events"))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events")


# --- contracts and patterns -------------------------------------------------------------------

CONTRACTS = sql.CONTRACTS


def _interfaces(g: Graph) -> DataFrame:
    return g.nodes.where("kind in ('interface', 'type')").select("id")


@query("contract_producers", with_(CONTRACTS) + "SELECT DISTINCT dst AS contract, src AS id, n.kind FROM edges JOIN nodes n ON src = n.id WHERE edges.kind IN ('returns', 'implements') AND dst IN (SELECT id FROM nodes WHERE kind IN ('interface', 'type'))")
def _(spark, d):
    g = derive.contracts(spark, d)
    return contracts.producers(g, _interfaces(g))


@query("contract_consumers", with_(CONTRACTS) + "SELECT DISTINCT dst AS contract, src AS id, CASE kind WHEN 'usesType' THEN 'user' ELSE 'embedder' END AS role FROM edges WHERE kind IN ('usesType', 'embeds') AND dst IN (SELECT id FROM nodes WHERE kind IN ('interface', 'type'))")
def _(spark, d):
    g = derive.contracts(spark, d)
    return contracts.consumers(g, _interfaces(g))


@query("contract_propagation", with_(CONTRACTS, "walk AS (SELECT id, 0 AS k FROM nodes WHERE id IN ('m:Brand#1', 'm:Brand#3') UNION SELECT e.src, 1 FROM walk w JOIN edges e ON e.dst = w.id AND e.kind = 'embeds')", recursive=True) + "SELECT id, CASE WHEN min(k) = 0 THEN 'explicit' ELSE 'embedded' END AS source FROM walk GROUP BY id")
def _(spark, d):
    g = derive.contracts(spark, d)
    return contracts.propagate(g, g.nodes.where("id in ('m:Brand#1', 'm:Brand#3')").select("id"), Scratch(spark))


@query("contract_fingerprint", with_(CONTRACTS) + ", m AS (SELECT DISTINCT dst AS id, concat_ws(':', kind, src) AS m FROM edges), t AS (SELECT id, string_agg(m, chr(10) ORDER BY m) AS m FROM m GROUP BY id) SELECT n.id, sha256(concat_ws(chr(10), n.id, n.kind, coalesce(t.m, ''))) AS fingerprint FROM nodes n LEFT JOIN t USING (id) WHERE n.kind = 'interface'")
def _(spark, d):
    g = derive.contracts(spark, d)
    return contracts.fingerprint(g, g.nodes.where("kind = 'interface'").select("id"))


@query("contract_classify", with_(CONTRACTS) + "SELECT id, CASE WHEN kind = 'interface' THEN 'interface' WHEN kind = 'function' AND id IN (SELECT src FROM edges WHERE kind = 'returns') THEN 'handler' WHEN kind = 'type' AND regexp_matches(name, '^[A-Z]') THEN 'dto' ELSE 'none' END AS contract_kind FROM nodes")
def _(spark, d):
    return contracts.classify(derive.contracts(spark, d))


@query("contract_kinds", with_(CONTRACTS) + "SELECT kind, count(*)::BIGINT AS nodes FROM nodes GROUP BY kind")
def _(spark, d):
    return derive.contracts(spark, d).nodes.groupBy("kind").agg(F.count("*").alias("nodes"))


@query("contract_resolution", with_(CONTRACTS) + ", w(name) AS (VALUES ('Brand#1'), ('Brand#11'), ('no such thing')), k AS (SELECT name, min(id) AS id FROM nodes GROUP BY name) SELECT name, id, CASE WHEN id IS NULL THEN 'unresolved' ELSE 'ok' END AS reason FROM w LEFT JOIN k USING (name)")
def _(spark, d):
    wanted = spark.createDataFrame([("Brand#1",), ("Brand#11",), ("no such thing",)], "name string")
    return contracts.resolve(wanted, derive.contracts(spark, d))


@query("boundary_context", with_(CONTRACTS) + ", r AS (SELECT id FROM nodes WHERE grp = 'Brand#11') SELECT src, dst, kind, CASE WHEN src IN (FROM r) THEN 'out' ELSE 'in' END AS way FROM edges WHERE (src IN (FROM r)) <> (dst IN (FROM r))")
def _(spark, d):
    g = derive.contracts(spark, d)
    return contracts.boundary(g, g.nodes.where("grp = 'Brand#11'").select("id"))


@query("call_flow", with_(CONTRACTS, "walk AS (SELECT 's1' AS id, 0 AS k UNION SELECT dst, k + 1 FROM walk JOIN edges ON src = id WHERE k < 3)", recursive=True) + "SELECT id, min(k)::INTEGER AS depth FROM walk GROUP BY id")
def _(spark, d):
    g = derive.contracts(spark, d)
    return traversal.reachable(g.edges.select("src", "dst").distinct(), spark.createDataFrame([("s1",)], "id string"), Scratch(spark), 3)


@query("external_noise", with_(CONTRACTS) + ", f AS (SELECT id FROM nodes WHERE kind = 'function' AND (right(id, 1) IN ('1', '2', '3', '4', '5', '6', '7'))), x AS (SELECT dst AS id, count(*) AS n, count(*) FILTER (src IN (FROM f)) AS k FROM edges JOIN nodes t ON dst = t.id AND t.kind = 'type' WHERE edges.kind IN ('returns', 'usesType') AND src <> dst GROUP BY dst) SELECT id, n::BIGINT AS inbound, k::BIGINT AS foreign_inbound, round(k / n, 6) AS share FROM x WHERE n >= 5 AND k / n >= 0.7")
def _(spark, d):
    g = derive.contracts(spark, d)
    foreign = g.nodes.where(F.substring("id", -1, 1).isin(list("1234567")) & (F.col("kind") == "function")).select("id")
    return contracts.external_noise(g, foreign, kinds=("returns", "usesType")).select("id", "inbound", "foreign_inbound", *r6("share"))


@query(
    "verify_pattern",
    with_(CONTRACTS)
    + """, a AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'returns'), b AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'implements'), c AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'embeds')
SELECT a.src AS maker, a.dst AS impl, b.dst AS iface, c.dst AS base FROM a JOIN b ON a.dst = b.src JOIN c ON b.dst = c.src""",
)
def _(spark, d):
    roles = {"maker": "function", "impl": "type", "iface": "interface", "base": "interface"}
    return contracts.match_pattern(derive.contracts(spark, d), roles, [("maker", "impl", "returns"), ("iface", "base", "embeds"), ("impl", "iface", "implements")])


@query("metric_records")
def _(spark, d):
    return records.run_metrics(derive.nations(spark, d), Scratch(spark))


@query("metric_cycle_records", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + SCC + ", z AS (SELECT least(id, m) AS scc, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1) SELECT 'cycle_rank' AS metric, 'graph' AS scope, '' AS target, (SELECT count(*) FROM z)::DOUBLE AS value UNION ALL SELECT 'cycle_rank', 'region', scc, n::DOUBLE FROM z UNION ALL SELECT 'zero', 'graph', '', 0 UNION ALL SELECT 'nothing', 'error', 'unknown metric', NULL")
def _(spark, d):
    return records.run_metrics(derive.nations(spark, d), Scratch(spark), ["cycle_rank", "zero", "nothing", "zero"])


@query("metric_snapshot", with_(NATIONS, sql.UNDIRECTED) + CURVATURE + "SELECT 'now' AS label, 'curvature' AS metric, round(avg(kappa), 9) AS value FROM k")
def _(spark, d):
    return records.snapshot(records.run_metrics(derive.nations(spark, d), Scratch(spark), ["curvature"]), "now")


@query("detect_outliers", with_(TRADE) + MZ.replace("count(e.src) AS value", "count(e.src)::DOUBLE AS value") + " SELECT 'fan_in' AS metric, id, round(coalesce(0.6745 * (value - median) / nullif(mad, 0), value), 6) AS score FROM v, m, s WHERE CASE WHEN mad > 0 THEN 0.6745 * (value - median) / mad >= 3.5 ELSE value >= 2 END")
def _(spark, d):
    v = degrees.bag_degrees(derive.trade(spark, d)).select(F.lit("fan_in").alias("metric"), F.lit("node").alias("scope"), F.col("id").alias("target"), F.col("ca").cast("double").alias("value"))
    return records.detect(v, "fan_in", "node", 3.5, 2).select("metric", "id", *r6("score"))


@query("best_proposals", with_(NATIONS) + ", p AS (SELECT src AS metric, dst AS target, n::DOUBLE AS score, seq FROM edges UNION ALL SELECT src, dst, n::DOUBLE, seq + 10 FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY metric, target ORDER BY score DESC, seq) AS r FROM p) SELECT metric, target, score, seq::BIGINT AS seq FROM r WHERE r = 1")
def _(spark, d):
    e = derive.nations(spark, d).edges.select(F.col("src").alias("metric"), F.col("dst").alias("target"), F.col("n").cast("double").alias("score"), F.col("seq").cast("long").alias("seq"))
    return records.best_per_group(e.unionByName(e.withColumn("seq", F.col("seq") + 10)))


@query(
    "conflict_free_proposals",
    with_(NATIONS, "o AS (SELECT row_number() OVER (ORDER BY n DESC, concat(src, '>', dst)) AS r, concat(src, '>', dst) AS id, n::DOUBLE AS score, [src, dst] AS members FROM edges)", "g AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS taken, '' AS id, 0::DOUBLE AS score, false AS kept UNION ALL SELECT o.r, CASE WHEN list_has_any(taken, members) THEN taken ELSE list_concat(taken, members) END, o.id, o.score, NOT list_has_any(taken, members) FROM g JOIN o ON o.r = g.r + 1)", recursive=True) + "SELECT id, score FROM g WHERE kept",
)
def _(spark, d):
    e = derive.nations(spark, d).edges
    return records.without_conflicts(e.select(F.concat_ws(">", "src", "dst").alias("id"), F.col("n").cast("double").alias("score"), F.array("src", "dst").alias("members")), Scratch(spark)).select("id", "score")


# --- more set operations and findings ---------------------------------------------------------


@query("focus_diff", with_(TRADE, "y AS (SELECT * FROM edges)") + ", n1 AS (SELECT src AS id FROM y WHERE year = 1995 UNION SELECT dst FROM y WHERE year = 1995), a AS (SELECT src AS id FROM y WHERE year = 1996 UNION SELECT dst FROM y WHERE year = 1996), new AS (SELECT id FROM a WHERE id NOT IN (FROM n1)), c AS (SELECT dst AS id FROM y WHERE year = 1996 AND src IN (FROM new) UNION SELECT src FROM y WHERE year = 1996 AND dst IN (FROM new)) SELECT id, 'added' AS mark FROM new UNION ALL SELECT id, 'context' FROM c WHERE id NOT IN (FROM new)")
def _(spark, d):
    return sets.focus_diff(_year(spark, d, 1995), _year(spark, d, 1996), Scratch(spark))


@query("target_verify", with_(TRADE) + "SELECT DISTINCT src, dst FROM edges WHERE year = 1995 AND (src, dst) NOT IN (SELECT (src, dst) FROM edges WHERE year = 1996)")
def _(spark, d):
    e = derive.trade(spark, d).edges
    return sets.missing(e.where("year = 1995"), e.where("year = 1996"), "src", "dst")


@query("field_history", with_(TRADE) + ", v AS (SELECT year, count(*) FILTER (dst = 's1') AS n FROM edges GROUP BY year) SELECT year::INTEGER AS variant, CASE WHEN n > 0 THEN n::VARCHAR ELSE '' END AS value FROM v")
def _(spark, d):
    rows = derive.trade(spark, d).edges.groupBy(F.col("year").alias("variant"), F.col("dst").alias("id")).agg(F.count("*").alias("value"))
    return sets.history(rows, "s1")


@query("parent_mismatch", with_(TRADE) + ", c AS (SELECT role AS community, grp AS parent, count(*) AS n FROM nodes GROUP BY 1, 2), b AS (SELECT community, arg_min(parent, (-n, parent)) AS usual, sum(n) AS size, max(n) AS top FROM c GROUP BY community) SELECT community, usual, (size - top)::BIGINT AS outliers, size::BIGINT AS size, round((size - top) / size, 6) AS ratio, CASE WHEN (size - top) / size >= 0.5 THEN 'high' WHEN (size - top) / size >= 0.25 THEN 'medium' ELSE 'low' END AS severity FROM b WHERE size > top")
def _(spark, d):
    rows = derive.parties(spark, d).select("id", F.col("role").alias("community"), F.col("grp").alias("parent"))
    return statistics.parent_mismatch(rows).select("community", "usual", "outliers", "size", *r6("ratio"), "severity")


@query("component_histogram", with_(PARTS, sql.UNDIRECTED, "walk AS (SELECT id, id AS c FROM nodes UNION SELECT b.other, w.c FROM walk w JOIN both_ways b ON w.id = b.id WHERE w.c < b.other)", recursive=True) + ", p AS (SELECT id, min(c) AS c FROM walk GROUP BY id), z AS (SELECT count(*) AS size FROM p GROUP BY c) SELECT size::BIGINT AS size, count(*)::BIGINT AS groups FROM z GROUP BY size")
def _(spark, d):
    return statistics.histogram(traversal.components(derive.cooccurrence(spark, d), Scratch(spark)), "component")


@query("quotient_members", with_(NATIONS, GROUPED) + "SELECT fg AS from_group, tg AS to_group, count(DISTINCT concat(src, '->', dst))::BIGINT AS weight, string_agg(DISTINCT concat(src, '->', dst), ',' ORDER BY concat(src, '->', dst)) AS edges FROM gr WHERE fg <> tg GROUP BY fg, tg")
def _(spark, d):
    return degrees.quotient_members(derive.nations(spark, d))


@query("calculate_cycles", with_(NATIONS, sql.DIRECTED, CLOSURE, recursive=True) + SCC + ", z AS (SELECT id, least(id, m) AS scc FROM s) SELECT scc, count(*)::BIGINT AS size, string_agg(id, ',' ORDER BY id) AS members FROM z GROUP BY scc HAVING count(*) > 1")
def _(spark, d):
    return calculate("cycles", derive.nations(spark, d), Scratch(spark))


from loomgraph import suites  # noqa: E402, F401  the queries of the suites register themselves
