"""Proposals, targets, patches and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import targets
from loomgraph.operators.targets import Proposal, TargetRole
from loomgraph.plans import oracle_graphs as sql
from loomgraph.registry import query, with_
from loomgraph.sources import derive

NATIONS, TREE, SERVICES = sql.NATIONS, sql.CONTAINMENT, sql.SERVICES
EXAMPLE = Proposal(
    "extract-1", "extract_interface", "k=3", 7.0, (TargetRole("Iface", "type"), TargetRole("Impl", "type", 3), TargetRole("Method", "method", 3)),
    (("Impl", "Iface", "implements"), ("Impl", "Method", "contains")), ({"Impl": "a", "Method": "m"}, {"Impl": "a", "Method": "n"}),
)


@query("target_expansion", "SELECT 'target:extract-1:Impl[' || i || ']' AS src, 'target:extract-1:Iface' AS dst, 'implements' AS kind FROM (SELECT unnest(range(3)) AS i) UNION ALL SELECT 'target:extract-1:Impl[' || i || ']', 'target:extract-1:Method[' || i || ']', 'contains' FROM (SELECT unnest(range(3)) AS i)")
def _(spark, d):
    return targets.expand_target(spark, EXAMPLE).edges


@query("target_missing", with_(SERVICES) + "SELECT 'node' AS item, 'type Iface' AS key UNION ALL SELECT 'edge', concat(s.name, ' calls Iface') FROM nodes s WHERE id = 's1'")
def _(spark, d):
    """A target that asks for one node and one edge that the graph hasn't, and for edges that it has."""
    g = derive.services(spark, d)
    own = g.nodes.select("id", "kind", "name")
    wanted = own.unionByName(spark.createDataFrame([("new", "type", "Iface")], "id string, kind string, name string"))
    edges = g.edges.where("kind = 'returns'").select("src", "dst", "kind").unionByName(spark.createDataFrame([("s1", "new", "calls")], "src string, dst string, kind string"))
    return targets.verify_target(Graph(wanted, edges), g)


@query("propose", with_(NATIONS) + ", a AS (SELECT src AS id, max(n)::DOUBLE AS score FROM edges GROUP BY src) SELECT id, CASE WHEN id IN (SELECT dst FROM edges) AND id LIKE '%1' THEN 'first' ELSE 'second' END AS rule, score FROM a WHERE (id IN (SELECT dst FROM edges) AND id LIKE '%1') OR id IN (SELECT id FROM nodes WHERE grp IN ('ASIA', 'AFRICA'))")
def _(spark, d):
    g = derive.nations(spark, d)
    anomalies = g.edges.groupBy(F.col("src").alias("id")).agg(F.max("n").cast("double").alias("score"))
    first = g.edges.where("dst like '%1'").select(F.col("dst").alias("id"))
    return targets.propose(anomalies, [("first", first), ("second", g.nodes.where("grp in ('ASIA', 'AFRICA')").select("id"))])


@query("rank_proposals", with_(NATIONS) + "SELECT src AS id, max(n)::DOUBLE AS score FROM edges GROUP BY src ORDER BY score DESC, id LIMIT 5")
def _(spark, d):
    e = derive.nations(spark, d).edges
    return targets.by_trigger(e.groupBy(F.col("src").alias("id")).agg(F.max("n").cast("double").alias("score")), 5)


@query("package_split", with_(TREE) + ", c AS (SELECT role AS id, count(*) AS n FROM nodes WHERE role <> '' GROUP BY role HAVING count(*) >= 20) SELECT id, n::BIGINT AS members, r AS role, 'package' AS kind FROM c, (VALUES ('CLIAdapter'), ('Orchestrator'), ('Reporter'), ('Contracts'), ('Storage')) v(r) WHERE id LIKE 'A%'")
def _(spark, d):
    """Regions whose name starts with A stand for command packages."""
    g = derive.containment(spark, d)
    named = g.nodes.withColumn("name", F.when(F.col("id").startswith("A"), F.concat(F.lit("cmd/"), "id")).otherwise(F.col("name")))
    sizes = g.nodes.where("role <> ''").groupBy(F.col("role").alias("target")).agg(F.count("*").cast("double").alias("value"))
    rows = sizes.select(F.lit("modularity").alias("metric"), F.lit("region").alias("scope"), "target", "value")
    return targets.package_splits(rows, Graph(named, g.edges))


# A patch for each customer: its orders are the selected nodes, operations and assignments follow its lines.
PATCHES = """
p AS (SELECT c_custkey AS patch, c_custkey AS contract, CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END AS rationale, CASE WHEN c_acctbal > 9000 THEN 0 ELSE 1 END AS sources FROM customer),
op AS (SELECT o_custkey AS patch, o_orderkey AS seq, CASE o_orderpriority WHEN '5-LOW' THEN 'retitle' WHEN '1-URGENT' THEN 'merge' ELSE 'annotate' END AS op, CASE WHEN o_totalprice > 430000 THEN -1 ELSE o_orderkey END AS target FROM orders),
sa AS (SELECT o_custkey AS patch, o_orderkey AS seq, o_orderkey AS node, CASE WHEN o_totalprice < 3000 THEN 'lost' ELSE 'kept' END AS outcome FROM orders WHERE o_totalprice >= 2000),
se AS (SELECT DISTINCT o_custkey AS contract, o_orderkey AS id FROM orders),
al AS (SELECT c_custkey AS contract, unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN ['retitle', 'annotate'] ELSE ['retitle', 'annotate', 'merge'] END) AS op FROM customer)"""


@query(
    "patch_validation",
    with_(PATCHES)
    + """, o1 AS (SELECT op.patch, seq, op.op, CASE WHEN al.op IS NULL THEN 'shape_change' WHEN se.id IS NULL THEN 'extra_node' END AS w FROM op LEFT JOIN al ON al.contract = op.patch AND al.op = op.op LEFT JOIN se ON se.contract = op.patch AND se.id = target),
o2 AS (SELECT patch, arg_min(w, seq) FILTER (w IS NOT NULL) AS w, max(op = 'merge') AS moves FROM o1 GROUP BY patch),
a2 AS (SELECT patch, arg_min('unknown_outcome', seq) FILTER (outcome = 'lost') AS w, count(DISTINCT node) AS covered FROM sa GROUP BY patch),
z AS (SELECT contract, count(*) AS size FROM se GROUP BY contract)
SELECT p.patch, coalesce(o2.w, a2.w, CASE WHEN coalesce(covered, 0) < coalesce(size, 0) THEN 'missing_node' END, CASE WHEN moves AND trim(rationale) = '' THEN 'missing_rationale' END, CASE WHEN sources = 0 THEN 'missing_sources' END, 'ok') AS verdict FROM p LEFT JOIN o2 USING (patch) LEFT JOIN a2 USING (patch) LEFT JOIN z ON z.contract = p.patch""",
)
def _(spark, d):
    customer, orders = derive.table(spark, d, "customer"), derive.table(spark, d, "orders")
    key = F.col("c_custkey")
    patches = customer.select(key.alias("patch"), key.alias("contract"), F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_mktsegment")).alias("rationale"), F.when(F.col("c_acctbal") > 9000, 0).otherwise(1).alias("sources"))
    op = F.when(F.col("o_orderpriority") == "5-LOW", "retitle").when(F.col("o_orderpriority") == "1-URGENT", "merge").otherwise("annotate")
    price, order, owner = F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
    operations = orders.select(owner.alias("patch"), order.alias("seq"), op.alias("op"), F.when(price > 430000, F.lit(-1)).otherwise(order).alias("target"))
    assignments = orders.where(price >= 2000).select(owner.alias("patch"), order.alias("seq"), order.alias("node"), F.when(price < 3000, "lost").otherwise("kept").alias("outcome"))
    ops = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("retitle"), F.lit("annotate"))).otherwise(F.array(F.lit("retitle"), F.lit("annotate"), F.lit("merge")))
    return targets.check_patches(patches, operations, assignments, orders.select(owner.alias("contract"), order.alias("id")), customer.select(key.alias("contract"), F.explode(ops).alias("op")))


@query("contract_check", "WITH s AS (SELECT o_custkey AS contract, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS contract, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'no kind' WHEN n IS NULL THEN 'nothing selected' WHEN c_mktsegment = 'MACHINERY' THEN 'unknown operation' ELSE '' END AS fault FROM customer LEFT JOIN s ON contract = c_custkey")
def _(spark, d):
    c = derive.table(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") == "FURNITURE", "").otherwise("orphan_bucket")
    selected = derive.table(spark, d, "orders").select(F.col("o_custkey").alias("contract"), F.col("o_orderkey").cast("string").alias("id"))
    allowed = c.select(F.col("c_custkey").alias("contract"), F.when(F.col("c_mktsegment") == "MACHINERY", "burn").otherwise("merge").alias("op"))
    return targets.check_contracts(c.select(F.col("c_custkey").alias("contract"), kind.alias("kind")), selected, allowed)


@query("patch_parse", "SELECT event_id AS id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def _(spark, d):
    """Replies with the JSON in a fenced block and bare ones."""
    e = derive.table(spark, d, "events").select(F.col("event_id").alias("id"), "props")
    reply = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.col("props"))
    block = targets.fenced_json(reply)
    key = F.json_object_keys("props")[0]
    return e.select("id", F.try_element_at(F.from_json(block, "map<string,string>"), key).alias("first_value"))


ORPHANS = "o AS (SELECT event_id AS id, concat(event_type, ' ', user_id) AS label, CASE WHEN event_type = 'purchase' THEN 'working' ELSE 'long' END AS memory_type, event_type AS entity_type, concat(event_type, ', user', user_id) AS labels FROM events)"


@query("orphan_batch", f"WITH {ORPHANS}, w AS (SELECT * FROM o WHERE memory_type = 'working' ORDER BY label, id LIMIT 64), b AS (SELECT id, 'memoryType:WORKING' AS bucket, row_number() OVER (ORDER BY label, id) AS place, 7000 + sum(3 * length(concat('{{\"id\":', id, ',\"label\":\"', label, '\"}}')) + 160) OVER (ORDER BY label, id ROWS UNBOUNDED PRECEDING) AS spent FROM w) SELECT id, bucket, place, spent::BIGINT AS spent FROM b WHERE spent <= 12000")
def _(spark, d):
    return targets.orphan_batch(_orphans(spark, d))


def _orphans(spark, d):
    e = derive.table(spark, d, "events")
    kind = F.col("event_type")
    return e.select(F.col("event_id").alias("id"), F.concat_ws(" ", kind, "user_id").alias("label"), F.when(kind == "purchase", "working").otherwise("long").alias("memory_type"), kind.alias("entity_type"), F.concat(kind, F.lit(", user"), "user_id").alias("labels"))


@query("orphan_contract", f"WITH {ORPHANS}, c AS (SELECT l, count(*) AS n FROM (SELECT unnest([entity_type, 'user' || split_part(label, ' ', 2)]) AS l FROM o WHERE memory_type = 'long') GROUP BY l ORDER BY n DESC, l LIMIT 1), w AS (SELECT o.* FROM o, c WHERE memory_type = 'long' AND (entity_type = l OR 'user' || split_part(label, ' ', 2) = l) ORDER BY label, id LIMIT 64), b AS (SELECT (SELECT l FROM c) AS bucket, 7000 + sum(3 * length(concat('{{\"id\":', id, ',\"label\":\"', label, '\"}}')) + 160) OVER (ORDER BY label, id ROWS UNBOUNDED PRECEDING) AS spent FROM w) SELECT bucket, count(*)::BIGINT AS selected, ceil(count(*) / 12)::BIGINT AS groups, false AS deletable FROM b WHERE spent <= 12000 GROUP BY bucket")
def _(spark, d):
    """Without working or episodic memories the bucket is the most common label."""
    return targets.batch_contract(targets.orphan_batch(_orphans(spark, d).where("memory_type = 'long'").withColumn("entity_type", F.lit("note"))))


@query("feasibility", "SELECT 'needs_review' AS status, 'a' AS reused, 'converged' AS same, 'improved' AS fewer, 'regressed' AS more, 'flat_star_hub hub' AS batch")
def _(spark, d):
    """A proposal whose samples share an Impl; steps that change nothing, less and more; the next batch without an anchor."""
    status, reused = targets.feasibility(EXAMPLE.samples, 20, 7)
    same, fewer, more = (targets.convergence((10, 20), (10, n), True)[0] for n in (20, 19, 21))
    batch = " ".join(targets.next_batch(9, False, [("other", True, 1.0), ("hub", True, 2.0), ("best", False, 9.0)]))
    return spark.createDataFrame([(status, ",".join(reused), same, fewer, more, batch)], "status string, reused string, same string, fewer string, more string, batch string")
