"""The graph server's tools as operators: contract tags, lists, diffs and exports, mutations, targets, catalogues, configuration.

Graphs are variants in a ``Store``; nodes carry an attribute map ``attrs``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import excluded, first_of, in_package, join_tags, slugify_name, split_list
from loomgraph.graph import Graph
from loomgraph.operators.sets import attribute_diff
from loomgraph.sources.documents import Store

# Node kinds that are contracts by themselves, and the tag and attributes of a tagged node.
CONTRACT_KINDS = {
    "configschema": "config_schema", "config_schema": "config_schema", "eventpublisher": "event", "event_publisher": "event",
    "cliflag": "cli_flag", "cli_flag": "cli_flag", "envvar": "env_var", "env_var": "env_var", "httphandler": "http_handler", "http_handler": "http_handler",
}
TAG, KIND_ATTR, VISIBILITY_ATTR = "contract", "contract_kind", "visibility"


def attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def put(attrs: Column, **values: Column) -> Column:
    """A map with some values set."""
    new = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
    return F.map_concat(F.map_filter(attrs, lambda k, v: ~k.isin(*values)), new)


def visibility() -> Column:
    """The attribute, else public for a name whose first letter is a capital."""
    return F.coalesce(F.nullif(attr(VISIBILITY_ATTR), F.lit("")), F.when(F.coalesce("name", F.lit("")).rlike(r"^\p{Lu}"), "public").otherwise("private"))


def classified(g: Graph) -> DataFrame:
    """Nodes with contract ('' for none): by kind, a routed function or method, a public type."""
    routed = g.edges.where("kind = 'route_registers'").select(F.col("dst").alias("id")).distinct().withColumn("_routed", F.lit(True))
    kind = F.lower("kind")
    by_kind = F.element_at(F.create_map(*(F.lit(x) for kv in CONTRACT_KINDS.items() for x in kv)), kind)
    found = F.coalesce(F.when(kind.isin(*CONTRACT_KINDS), by_kind), F.when(F.coalesce("_routed", F.lit(False)) & kind.isin("function", "method"), "http_handler"), F.when((kind == "type") & (visibility() == "public"), "dto"), F.lit(""))
    return g.nodes.join(routed, "id", "left").withColumn("contract", found).drop("_routed")


def tag_contracts(g: Graph) -> Graph:
    """Contracts with their tag, kind and visibility among the attributes; other nodes as they are."""
    rows = classified(g)
    tagged = put(F.col("attrs"), tags=join_tags(split_list(attr("tags")), F.lit(TAG)), **{KIND_ATTR: F.col("contract"), VISIBILITY_ATTR: visibility()})
    return Graph(rows.withColumn("attrs", F.when(F.col("contract") != "", tagged).otherwise(F.col("attrs"))).drop("contract"), g.edges)


def list_contracts(g: Graph, kind: str = "", visible: str = "") -> DataFrame:
    """id, name, kind, contract_kind and visibility of the tagged nodes, of one kind or visibility if asked."""
    rows = g.nodes.where(F.array_contains(split_list(attr("tags")), TAG))
    rows = rows.select("id", "name", "kind", attr(KIND_ATTR).alias("contract_kind"), attr(VISIBILITY_ATTR).alias("visibility"))
    rows = rows.where(F.col("contract_kind") == kind) if kind else rows
    return rows.where(F.col("visibility") == visible) if visible else rows


def diff_contracts(a: Graph, b: Graph, scope: str = "") -> DataFrame:
    """(id, change, field, old, new): contracts added and removed, and each field of those that changed, kind and name as __kind and __name."""

    def own(g: Graph, names: tuple[str, ...]) -> DataFrame:
        wanted = F.array_contains(split_list(attr("tags")), TAG) & (F.lit(True) if not scope else attr(KIND_ATTR) == scope)
        full = put(F.col("attrs"), __kind=F.col("kind"), __name=F.coalesce("name", F.lit("")))
        return g.nodes.where(wanted).select("id", full.alias(names[0]))

    both = own(a, ("x",)).join(own(b, ("y",)), "id", "full")
    blank = [F.lit("").alias(c) for c in ("field", "old", "new")]
    gone = both.where("y is null").select("id", F.lit("removed").alias("change"), *blank)
    new = both.where("x is null").select("id", F.lit("added").alias("change"), *blank)
    fields = both.where("x is not null and y is not null").select("id", F.explode(attribute_diff(F.col("x"), F.col("y"))).alias("field", "v"))
    return gone.unionByName(new).unionByName(fields.select("id", F.lit("changed").alias("change"), "field", F.col("v")[0].alias("old"), F.col("v")[1].alias("new")))


def openapi(g: Graph) -> DataFrame:
    """(section, key, owner, body): a path and method for each handler, a schema for each dto; a key that two nodes claim is an error row.

    A collision keeps the smallest id as owner and has the section ``collision`` for the others.
    """
    rows = g.nodes.where(F.array_contains(split_list(attr("tags")), TAG))
    path = F.coalesce(F.nullif(first_of(F.col("attrs"), "http_path", "path"), F.lit("")), F.concat(F.lit("/"), slugify_name(F.col("name"))))
    method = F.coalesce(F.nullif(F.lower(first_of(F.col("attrs"), "http_method", "method")), F.lit("")), F.lit("get"))
    operation = F.to_json(F.struct(F.col("id").alias("operationId"), F.col("name").alias("summary")))
    handlers = rows.where(attr(KIND_ATTR) == "http_handler").select(F.lit("path").alias("section"), F.concat_ws(" ", method, path).alias("key"), "id", operation.alias("body"))
    title = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("id"))
    schema = F.to_json(F.struct(F.lit("object").alias("type"), title.alias("title")))
    schemas = rows.where(attr(KIND_ATTR) == "dto").select(F.lit("schema").alias("section"), title.alias("key"), "id", schema.alias("body"))
    every = handlers.unionByName(schemas)
    owners = every.groupBy("section", "key").agg(F.min("id").alias("owner"))
    out = every.join(owners, ["section", "key"])
    first = F.col("id") == F.col("owner")
    return out.select(F.when(first, F.col("section")).otherwise("collision").alias("section"), "key", F.col("id").alias("owner"), F.when(first, F.col("body")).alias("body"))


# --- mutations --------------------------------------------------------------------------------


def apply_mutations(g: Graph, nodes: DataFrame | None = None, edges: DataFrame | None = None, weights: DataFrame | None = None) -> Graph:
    """A graph after a batch of mutations.

    ``nodes`` (id, kind, attrs) and ``edges`` (src, dst, kind, attrs) are added if new; an edge needs
    both ends. ``weights`` (id, delta) are summed into the attribute weight, which starts at 0: the
    order of the batch doesn't matter.
    """
    own, ends = g.nodes, g.edges
    if nodes is not None:
        fresh = nodes.dropDuplicates(["id"]).join(own.select("id"), "id", "left_anti")
        own = own.unionByName(fresh.select("id", "kind", "attrs"), allowMissingColumns=True)
    if edges is not None:
        fresh = edges.dropDuplicates(["src", "dst", "kind"]).join(ends.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
        for end in ("src", "dst"):
            fresh = fresh.join(own.select(F.col("id").alias(end)), end, "left_semi")
        ends = ends.unionByName(fresh, allowMissingColumns=True)
    if weights is not None:
        total = weights.groupBy("id").agg(F.sum("delta").alias("_delta"))
        now = F.coalesce(attr("weight").try_cast("double"), F.lit(0.0)) + F.col("_delta")
        own = own.join(total, "id", "left").withColumn("attrs", F.when(F.col("_delta").isNotNull(), put(F.col("attrs"), weight=now.cast("string"))).otherwise(F.col("attrs"))).drop("_delta")
    return Graph(own, ends)


def activate(ids: DataFrame, weight: float) -> DataFrame:
    """The deltas that activating nodes (column id) stands for."""
    return ids.select("id", F.lit(weight).alias("delta"))


def redirect(g: Graph, src: str, dst: str, to: str) -> Graph:
    """Point the first edge from ``src`` to ``dst`` at ``to``."""
    hit = (F.col("src") == src) & (F.col("dst") == dst)
    first = g.edges.where(hit).agg(F.min("seq").alias("_first"))
    rows = g.edges.crossJoin(F.broadcast(first))
    return Graph(g.nodes, rows.withColumn("dst", F.when(hit & (F.col("seq") == F.col("_first")), to).otherwise(F.col("dst"))).drop("_first"))


def invert_dependency(g: Graph, src: str, dst: str, port: str) -> Graph:
    """Put a port between two nodes: the first edge from ``src`` goes to the port, and ``dst`` implements it."""
    spark = g.nodes.sparkSession
    turned = redirect(g, src, dst, port).edges
    fill = lambda schema, values: spark.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields))
    return Graph(g.nodes.unionByName(fill(g.nodes.schema, {"id": port, "kind": "type", "name": port})), turned.unionByName(fill(turned.schema, {"src": dst, "dst": port, "kind": "implements"})))


# --- roles, contracts by configuration --------------------------------------------------------


def set_roles(nodes: DataFrame, explicit: DataFrame, inferred: DataFrame) -> DataFrame:
    """Nodes with role and its source: an explicit (id, role) wins over an inferred one, whatever the order they come in."""
    a = explicit.groupBy("id").agg(F.min("role").alias("_e"))
    b = inferred.groupBy("id").agg(F.min("role").alias("_i"))
    rows = nodes.drop("role").join(a, "id", "left").join(b, "id", "left")
    return rows.select(*[c for c in nodes.columns if c != "role"], F.coalesce("_e", "_i", F.lit("")).alias("role"), F.when(F.col("_e").isNotNull(), "explicit").when(F.col("_i").isNotNull(), "inferred").otherwise("").alias("source"))


def build_contracts(g: Graph, wanted: list[str], excludes: list[str], packages: list[str]) -> DataFrame:
    """(name, id, state): configured names resolved to nodes: marked, unresolved, or excluded by a path rule or a package.

    ``g.nodes`` has name, file and qname.
    """
    spark = g.nodes.sparkSession
    names = spark.createDataFrame([(w,) for w in wanted], "name string")
    known = g.nodes.groupBy("name").agg(F.min(F.struct("id", "file", "qname")).alias("n"))
    rows = names.join(known, "name", "left")
    out = excluded(F.col("n.file"), excludes) if excludes else F.lit(False)
    for p in packages:
        out = out | in_package(F.col("n.qname"), p)
    state = F.when(F.col("n").isNull(), "unresolved").when(F.coalesce(out, F.lit(False)), "excluded").otherwise("marked")
    return rows.select("name", F.col("n.id").alias("id"), state.alias("state"))


def coupling_rules(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Forbidden (from, to, reason) rules of a configuration, the first of duplicates; a rule without an end is an error."""
    out: dict[tuple[str, str], str] = {}
    for a, b, reason in rules:
        if not a or not b:
            raise ValueError("a coupling rule needs from and to")
        out.setdefault((a, b), reason)
    return [(a, b, r) for (a, b), r in out.items()]


def coupling_violations(g: Graph, rules: list[tuple[str, str, str]], external: DataFrame | None = None, unknown: str = "unknown") -> DataFrame:
    """(from_group, to_group, edges, reason) of the role pairs that rules forbid; nodes without a role are ``unknown``, external ones are left out."""
    from loomgraph.operators.degrees import with_groups

    spark = g.nodes.sparkSession
    nodes = g.nodes if external is None else g.nodes.join(external, "id", "left_anti")
    named = Graph(nodes.withColumn("role", F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(unknown))), g.edges)
    rows = with_groups(named, "role").groupBy("from_group", "to_group").agg(F.count("*").alias("edges"))
    return rows.join(spark.createDataFrame(coupling_rules(rules), "from_group string, to_group string, reason string"), ["from_group", "to_group"]).select("from_group", "to_group", "edges", "reason")


# --- targets and catalogues -------------------------------------------------------------------

TARGET = "target/"


def put_target(store: Store, graph_id: str, name: str, g: Graph) -> None:
    store.save(f"{TARGET}{graph_id}/{name}", g)


def list_targets(store: Store, graph_id: str) -> list[str]:
    prefix = f"{TARGET}{graph_id}/"
    return [v.removeprefix(prefix) for v in store.list(prefix)]


def show_target(store: Store, graph_id: str, name: str) -> DataFrame:
    """A target's shape: nodes by kind and edges by kind."""
    g = store.load(f"{TARGET}{graph_id}/{name}")
    part = lambda df, item: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), "kind", "n")
    return part(g.nodes, "node").unionByName(part(g.edges, "edge"))


METRIC_EPSILON = 1e-9


def catalog_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(item, name, change, old, new) of two snapshots (item, name, value, state): metrics, motifs and patterns.

    A metric changes by more than METRIC_EPSILON, a motif by its count, a pattern by its state or
    score. What only one side has is added or removed.
    """
    keys = ["item", "name"]
    a = before.select(*keys, F.struct("value", "state").alias("x"))
    b = after.select(*keys, F.struct("value", "state").alias("y"))
    both = a.join(b, keys, "full")
    moved = F.abs(F.coalesce("x.value", F.lit(0.0)) - F.coalesce("y.value", F.lit(0.0))) > METRIC_EPSILON
    other = F.coalesce("x.state", F.lit("")) != F.coalesce("y.state", F.lit(""))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(moved | other, "changed")
    return both.select(*keys, change.alias("change"), F.col("x.value").alias("old"), F.col("y.value").alias("new")).where("change is not null")


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, delta) of graph-scope records: b minus a, NaN where a side failed or lacks it."""
    own = lambda r, c: r.where("scope in ('graph', 'error')").groupBy("metric").agg(F.max(F.when(F.col("scope") == "graph", F.col("value"))).alias(c))
    return own(a, "x").join(own(b, "y"), "metric", "full").select("metric", F.coalesce(F.col("y") - F.col("x"), F.lit(float("nan"))).alias("delta"))


def union_of_keys(*maps: Column) -> Column:
    """The distinct keys of some maps, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(F.map_keys(m) for m in maps)))))


def search(g: Graph, text: str, most: int = 30) -> DataFrame:
    """(id, name) of up to ``most`` (80 at most) nodes whose name, qualified name or id has ``text``, whatever its case; files and control flow are left out."""
    skipped = ("file", "loop", "branch", "goroutine", "defer", "channelop", "syncprim")
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("name", "qname", "id") if c in g.nodes.columns]
    rows = g.nodes.where(~F.col("kind").isin(*skipped)).where(reduce(Column.__or__, (F.lower(c).contains(text.lower()) for c in fields)))
    return rows.orderBy("id").limit(min(most, 80)).select("id", "name")
