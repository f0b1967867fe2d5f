"""Documents, folders and stores written and read again, reports and diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import degrees, records
from loomgraph.plans import oracle_graphs as sql
from loomgraph.plans.scratch import Scratch
from loomgraph.registry import query, with_
from loomgraph.sources import derive, documents

NATIONS, TREE, SERVICES, CONTRACTS = sql.NATIONS, sql.CONTAINMENT, sql.SERVICES, sql.CONTRACTS
SHAPE = "SELECT 'node' AS item, id AS a, kind AS b, name AS c FROM nodes UNION ALL SELECT 'edge', src, dst, kind FROM edges"


def _rows(g: Graph):
    return g.nodes.select(F.lit("node").alias("item"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("name").alias("c")).unionByName(g.edges.select(F.lit("edge").alias("item"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("kind").alias("c")))


@query("json_document", with_(TREE) + SHAPE)
def _(spark, d):
    path = Scratch(spark).path("json")
    documents.write_json(derive.containment(spark, d), path)
    return _rows(documents.read_json(spark, path))


@query("json_lines", with_(CONTRACTS) + SHAPE)
def _(spark, d):
    path = Scratch(spark).path("lines")
    documents.write_lines(derive.contracts(spark, d), path)
    return _rows(documents.read_lines(spark, path))


@query("graphml_document", with_(SERVICES) + SHAPE)
def _(spark, d):
    path = Scratch(spark).path("graphml")
    documents.write_graphml(derive.services(spark, d), path)
    return _rows(documents.read_graphml(spark, path))


@query("foreign_filter", with_(SERVICES, "x AS (SELECT * FROM nodes WHERE NOT (kind = 'function'))") + "SELECT 'node' AS item, id AS a, kind AS b, name AS c FROM x UNION ALL SELECT 'edge', src, dst, kind FROM edges WHERE src IN (SELECT id FROM x) AND dst IN (SELECT id FROM x)")
def _(spark, d):
    """Functions are foreign here: the reader leaves them and their edges out."""
    g = derive.services(spark, d)
    marks = F.when(F.col("kind") == "function", F.create_map(F.lit("foreign"), F.lit("true"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    path = Scratch(spark).path("json")
    documents.write_json(Graph(g.nodes.withColumn("attrs", marks), g.edges), path)
    return _rows(documents.read_json(spark, path, foreign=False))


@query("package_granularity", with_(NATIONS) + "SELECT 'node' AS item, 'pkg/' || id AS a, 'package' AS b, 'pkg/' || id AS c FROM nodes UNION ALL SELECT DISTINCT 'edge', 'pkg/' || src, 'pkg/' || dst, 'dependsOn' FROM edges WHERE src <> dst")
def _(spark, d):
    g = derive.nations(spark, d)
    path = Scratch(spark).path("json")
    documents.write_json(Graph(g.nodes.withColumn("qname", F.concat(F.lit("pkg/"), "id")), g.edges), path)
    return _rows(documents.read_json(spark, path, granularity="package"))


@query("shape_graphml", with_(TREE) + "SELECT id, name AS label FROM nodes")
def _(spark, d):
    """The flavour of memory graphs: the title is the label."""
    g = derive.containment(spark, d)
    path = Scratch(spark).path("graphml")
    titled = g.nodes.select("id", "kind", F.lit("x").alias("name"), F.create_map(F.lit("memory_title"), F.col("name")).alias("attrs"))
    documents.write_graphml(Graph(titled, g.edges), path)
    return documents.read_graphml(spark, path, "shape").nodes.select("id", F.col("name").alias("label"))


@query("record_documents", with_(NATIONS, sql.UNDIRECTED) + ", d AS (SELECT id, count(*) AS n FROM both_ways GROUP BY id) SELECT 'degree' AS metric, 'node' AS scope, id AS target, n::DOUBLE AS value FROM d")
def _(spark, d):
    n = derive.nations(spark, d).neighbours().groupBy("id").agg(F.count("*").cast("double").alias("value"))
    rows = n.select(F.lit("degree").alias("metric"), F.lit("node").alias("scope"), F.col("id").alias("target"), "value")
    path = Scratch(spark).path("records")
    documents.write_records(rows, path)
    return documents.read_records(spark, path, "metric string, scope string, target string, value double").select(*records.RECORD)


@query("graph_store", with_(TREE) + "SELECT v AS variant, (SELECT count(*) FROM nodes)::BIGINT AS nodes, (SELECT count(*) FROM edges)::BIGINT AS edges FROM (VALUES ('actual'), ('draft')) t(v)")
def _(spark, d):
    """Two saves of one variant, a fork of it, and a variant taken away: what is listed and what it holds."""
    store = documents.Store(spark, Scratch(spark).path("store"))
    g = derive.containment(spark, d)
    store.save("actual", g.without_foreign(F.col("kind") == "type"))
    store.save("actual", g)
    store.fork("actual", "draft")
    store.save("old", g)
    store.save("old", g, gone=True)
    out = [store.checkout(v) for v in store.list()]
    return out[0].unionByName(out[1])


@query("metric_cache", with_(NATIONS, sql.UNDIRECTED) + ", d AS (SELECT id, count(*) AS n FROM both_ways GROUP BY id) SELECT turn, turn > 0 AS hit, sum(n)::BIGINT AS total FROM d, (VALUES (0), (1)) t(turn) GROUP BY turn")
def _(spark, d):
    """A result is computed once for a graph's content and then read."""
    store = documents.Store(spark, Scratch(spark).path("store"))
    store.save("actual", derive.nations(spark, d))
    out = []
    for turn in (0, 1):
        rows, hit = store.cached("actual", "degree", lambda g: g.neighbours().groupBy("id").agg(F.count("*").alias("n")))
        out.append(rows.agg(F.lit(turn).alias("turn"), F.lit(hit).alias("hit"), F.sum("n").alias("total")))
    return out[0].unionByName(out[1])


@query("mutation_log", "SELECT event_type AS tool, count(*)::BIGINT AS calls, round(sum(value), 4) AS weight FROM events GROUP BY 1")
def _(spark, d):
    """Mutations appended as JSON lines in two batches, replayed as a stream into weights."""
    scratch = Scratch(spark)
    root = scratch.path("store")
    store = documents.Store(spark, root)
    rows = derive.table(spark, d, "events").select(F.col("event_type").alias("tool"), "value", "event_id")
    store.append("mutations", rows.where("event_id % 2 = 0"))
    store.append("mutations", rows.where("event_id % 2 = 1"))
    stream = spark.readStream.schema("tool string, value double, event_id long").json(f"{root}/mutations")
    out = scratch.path("replayed")
    # only appended rows are written; the sums are over what the stream has delivered
    run = stream.writeStream.format("parquet").option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.parquet(out).groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("weight"))


@query("diagram_d2", with_(SERVICES) + ", n AS (SELECT id, name, CASE WHEN grp <> '' THEN '\"' || grp || '\".\"' || id || '\"' ELSE '\"' || id || '\"' END AS spot FROM nodes) SELECT 0 AS place, spot || ': \"' || name || '\"' AS text FROM n UNION ALL SELECT 1, a.spot || ' -> ' || b.spot || ': \"' || kind || '\"' FROM edges JOIN n a ON src = a.id JOIN n b ON dst = b.id")
def _(spark, d):
    g = derive.services(spark, d)
    nodes = g.nodes.select("id", F.col("name").alias("label"), F.col("grp").alias("cluster"))
    return documents.d2_lines(nodes, g.edges.select("src", "dst", F.col("kind").alias("label"))).select("place", "text")


@query("markdown_report", with_(NATIONS, "gr AS (SELECT a.grp AS fg, b.grp AS tg FROM edges e JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id)") + "SELECT 2 AS place, concat('| ', fg, ' | ', tg, ' | ', count(*), ' |') AS text FROM gr WHERE fg <> tg GROUP BY fg, tg UNION ALL SELECT 0, '| from_group | to_group | weight |' UNION ALL SELECT 1, '|---|---|---|'")
def _(spark, d):
    return documents.markdown_table(degrees.quotient(derive.nations(spark, d)), ["from_group", "to_group", "weight"])


@query("quotient_document", with_(NATIONS, "gr AS (SELECT a.grp AS fg, b.grp AS tg FROM edges e JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id)") + "SELECT fg AS src, tg AS dst, count(*)::VARCHAR AS weight FROM gr WHERE fg <> tg GROUP BY fg, tg")
def _(spark, d):
    """The quotient as GraphML with sizes and weights, read again."""
    g = derive.nations(spark, d)
    q = degrees.quotient(g)
    sizes = g.nodes.groupBy(F.col("grp").alias("id")).agg(F.create_map(F.lit("size"), F.count("*").cast("string")).alias("attrs"))
    edges = q.select(F.col("from_group").alias("src"), F.col("to_group").alias("dst"), F.lit("dependsOn").alias("kind"), F.create_map(F.lit("weight"), F.col("weight").cast("string")).alias("attrs"))
    path = Scratch(spark).path("quotient")
    documents.write_graphml(Graph(sizes.withColumn("kind", F.lit("package")), edges), path)
    return documents.read_graphml(spark, path).edges.select("src", "dst", F.col("attrs")["weight"].alias("weight"))


@query("dot_lines", with_(NATIONS) + "SELECT '  \"' || id || '\" [label=\"' || name || '\"];' AS value FROM nodes UNION ALL SELECT '  \"' || src || '\" -> \"' || dst || '\" [label=\"' || kind || '\"];' FROM edges")
def _(spark, d):
    from loomgraph.sources import graphs

    return graphs.to_dot(derive.nations(spark, d))


@query("embedding_vectors", "SELECT vec_id AS id, len(embedding)::INTEGER AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE embedding IS NOT NULL")
def _(spark, d):
    """A document {name: [floats]} written and read as a map, joined back as node vectors."""
    rows = derive.table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    path = Scratch(spark).path("vectors")
    rows.select(F.to_json(F.create_map("id", "vec")).alias("value")).write.text(path)
    back = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("id", "vec"))
    return back.select(F.col("id").cast("long").alias("id"), F.size("vec").alias("size"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
