"""Commands over a graph document, and tools over a store of graphs: a name, its options, a DataFrame.

``python -m loomgraph COMMAND GRAPH [key=value ...]`` reads a graph (.graphml, .json or a folder of JSON
lines), runs a command and prints its rows as JSON lines, or writes them to ``out=FOLDER`` in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import config
from loomgraph.calculate import calculate
from loomgraph.functions.scalars import split_list
from loomgraph.graph import Graph
from loomgraph.operators import contracts, degrees, findings, linalg, motifs, patterns, records, service, sets, spectral, statistics, targets, traversal, views
from loomgraph.plans.scratch import Scratch
from loomgraph.sources import documents

Options = dict[str, str]
COMMANDS: dict[str, Callable[[Graph, Scratch, Options], DataFrame]] = {}


def command(name: str):
    def add(f):
        COMMANDS[name] = f
        return f

    return add


def read_graph(spark: SparkSession, path: str, options: Options | None = None) -> Graph:
    options = options or {}
    if path.endswith((".graphml", ".xml")):
        return documents.with_defaults(documents.read_graphml(spark, path, options.get("flavour", "generic")))
    if path.endswith(".json"):
        return documents.read_json(spark, path, options.get("foreign", "true") == "true", options.get("granularity", "symbol"))
    return documents.read_lines(spark, path)


def grouped(g: Graph, name: str) -> Graph:
    """The graph with the attribute ``name`` as its grouping and role columns."""
    value = F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))
    return Graph(g.nodes.withColumn("grp", value).withColumn("role", value), g.edges)


def _names(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(x.strip(),) for x in text.split(",") if x.strip()], "id string")


@command("graph")
def _(g, s, o):
    part = lambda df, item: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), "kind", "n")
    return part(g.nodes, "node").unionByName(part(g.edges, "edge"))


@command("view")
def _(g, s, o):
    starts = _names(g.nodes.sparkSession, o.get("seed", ""))
    out = views.view(g, o.get("name", "packages"), s, int(o.get("limit", "0")), o.get("package", ""), starts, int(o.get("depth", "1")))
    return out.edges.select("src", "dst", "kind", "weight")


@command("contracts")
def _(g, s, o):
    tagged = service.tag_contracts(g)
    found = service.list_contracts(tagged, o.get("kind", ""), o.get("visibility", ""))
    made = contracts.producers(g, found.select("id")).groupBy(F.col("contract").alias("id")).agg(F.count("*").alias("producers"))
    return found.join(made, "id", "left").na.fill(0, ["producers"])


@command("metrics")
def _(g, s, o):
    return records.run_metrics(grouped(g, o.get("group", "role")), s, o["names"].split(",") if "names" in o else None)


@command("anomalies")
def _(g, s, o):
    return findings.detect(records.run_metrics(grouped(g, o.get("group", "role")), s, ["cycle_rank", "local_symmetry", "spectral_gap"]))


@command("pkg-graph")
def _(g, s, o):
    return views.package_projection(g, s, o.get("module", ""))


@command("embed")
def _(g, s, o):
    return embed(g.nodes.select("id", F.coalesce("name", F.lit("")).alias("text")), HashedWords(int(o.get("size", "64"))))


@command("verify")
def _(g, s, o):
    with open(o["skeleton"], encoding="utf-8") as f:
        return patterns.verify(g, config.parse_skeleton(f.read()))


@command("propose")
def _(g, s, o):
    found = [patterns.instances(g, k, s) for k in (3, 4)]
    return patterns.extract_interface(s.save(reduce(DataFrame.unionByName, found), "instances"), g)


@command("optimize")
def _(g, s, o):
    stars = statistics.flat_stars(g).select("id", "score").withColumn("kind", F.lit("flat_star_hub"))
    return targets.by_trigger(stars, int(o.get("limit", "5")))


@command("optimize-batch")
def _(g, s, o):
    degree = degrees.degree(g).where("degree = 0").select("id")
    value = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    rows = g.nodes.join(degree, "id").select("id", F.col("name").alias("label"), value("memoryType").alias("memory_type"), value("entityType").alias("entity_type"), value("labels").alias("labels"))
    return targets.orphan_batch(rows)


@command("patterns")
def _(g, s, o):
    foreign = g.nodes.where(F.coalesce(F.try_element_at("attrs", F.lit("foreign")), F.lit("")) == "true").select("id")
    noise = contracts.external_noise(g, foreign).agg(F.count("*").alias("n"))
    report = noise.select(F.lit("external_noise").alias("pattern"), F.when(F.col("n") > 0, "match").otherwise("mismatch").alias("status"))
    blank = g.nodes.sparkSession.createDataFrame([("domain_core", "not_applicable"), ("forbidden_role_edges", "not_applicable")], "pattern string, status string")
    return report.unionByName(blank)


@command("coupling")
def _(g, s, o):
    return degrees.role_coupling(grouped(g, o.get("group", "role")))


@command("graphml-scan")
def _(g, s, o):
    out = findings.find(grouped(g, o.get("group", "role")), s, o["names"].split(",") if "names" in o else None)
    return out.orderBy(*findings.ranked(out))


@command("diagram")
def _(g, s, o):
    kind = o.get("kind", "package_deps")
    d = views.diagram(g, kind, s, o.get("foreign") == "true", _names(g.nodes.sparkSession, o.get("seed", "")))
    boxes = views.clusters(g, s).join(d.nodes.select("id"), "id", "left_semi")
    return documents.d2_lines(boxes, d.edges.select("src", "dst", F.col("kind").alias("label"))).orderBy("place", "key").select("text")


@command("export")
def _(g, s, o):
    return views.model(g, s)


@command("catalog")
def _(g, s, o):
    return records.snapshot(records.run_metrics(grouped(g, o.get("group", "role")), s, ["components", "scc", "cycle_rank", "curvature"]), o.get("label", "now"))


@command("spectral")
def _(g, s, o):
    return spectral.report(g, s, int(o.get("max", "10")))


@command("communities")
def _(g, s, o):
    return linalg.louvain(g, s, resolution=float(o.get("resolution", "1")))


@command("analyze")
def _(g, s, o):
    return records.run_metrics(grouped(g, o.get("group", "role")), s).where("scope in ('graph', 'error')")


@command("calculate")
def _(g, s, o):
    return calculate(o["name"], grouped(g, o.get("group", "role")), s)


@command("quotient")
def _(g, s, o):
    if "partition" in o:
        return degrees.quotient_members(grouped(g, o["partition"]))
    parts = linalg.louvain(g, s).select("id", F.col("community").alias("grp"))
    return degrees.quotient_members(Graph(g.nodes.select("id").join(parts, "id"), g.edges))


@command("policy")
def _(g, s, o):
    with open(o["rules"], encoding="utf-8") as f:
        rules = config.parse_policy(f.read())
    spark = g.nodes.sparkSession
    allow = spark.createDataFrame(list(rules.allow), "from_group string, to_group string")
    return sets.policy_residual(grouped(g, rules.partition), allow, spark.createDataFrame([(x,) for x in rules.sink], "from_group string"))


@command("diff")
def _(g, s, o):
    return sets.diff(g, read_graph(g.nodes.sparkSession, o["after"], o), ("kind", "name"))


@command("drift")
def _(g, s, o):
    other = read_graph(g.nodes.sparkSession, o["after"], o)
    told = [records.run_metrics(grouped(x, o.get("group", "role")), s, ["components", "scc", "curvature"]) for x in (g, other)]
    return service.compare_metrics(*told)


@command("curvature")
def _(g, s, o):
    k = motifs.curvature(g.undirected())
    most = int(o.get("top", "10"))
    low = statistics.top(k, most, F.col("kappa"), F.col("a"), F.col("b")).withColumn("tail", F.lit("low"))
    high = statistics.top(k, most, F.desc("kappa"), F.col("a"), F.col("b")).withColumn("tail", F.lit("high"))
    near = g.neighbours()
    both = low.unionByName(high)
    shared = both.join(near.select(F.col("id").alias("a"), "other"), "a").join(near.select(F.col("id").alias("b"), "other"), ["b", "other"])
    common = shared.groupBy("a", "b", "tail").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("shared"))
    return both.join(common, ["a", "b", "tail"], "left").na.fill("", ["shared"])


@command("ppr")
def _(g, s, o):
    starts = g.nodes.sparkSession.range(1).select(F.explode(split_list(F.lit(o["seeds"]))).alias("id"))
    out = traversal.pagerank(g.nodes, g.edges, s, starts, rounds=int(o.get("rounds", "20")))
    return statistics.top(out, int(o.get("top", "20")), F.desc("score"), F.col("id"))


@command("region")
def _(g, s, o):
    return spectral.local_partition(g, _names(g.nodes.sparkSession, o["seeds"]), s)


# --- embeddings -------------------------------------------------------------------------------


class HashedWords:
    """An embedding provider without a model: words hashed into ``size`` signed cells, scaled to length 1.

    A provider has a ``name`` and ``embed(text column) -> array<double> column``.
    """

    def __init__(self, size: int = 64):
        self.size, self.name = size, f"hashed-words-{size}"

    def embed(self, text):
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        cells = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(self.size)).alias("i"), F.when(F.pmod(F.xxhash64(w, F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("x")))
        zeros = F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: i.cast("long"))
        # a value is bound by an array of one, so that it is worked out once a row and not at each of its uses
        bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
        total = lambda found, i: F.aggregate(found, F.lit(0.0), lambda a, c: F.when(c["i"] == i, a + c["x"]).otherwise(a))
        raw = bound(cells, lambda found: F.transform(zeros, lambda i: total(found, i)))
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return bound(raw, lambda v: bound(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def embed(rows: DataFrame, provider, known: DataFrame | None = None) -> DataFrame:
    """(id, vec) of rows (id, text); vectors that ``known`` (key, vec) has by provider and text are taken from it."""
    keyed = rows.withColumn("key", F.sha2(F.concat_ws("|", F.lit(provider.name), "text").cast("binary"), 256))
    if known is None:
        return keyed.select("id", provider.embed(F.col("text")).alias("vec"))
    had = keyed.join(known.select("key", "vec"), "key", "left")
    return had.select("id", F.coalesce("vec", provider.embed(F.col("text"))).alias("vec"))


# --- tools over a store -----------------------------------------------------------------------


def _rows(df: DataFrame, most: int = 1000) -> list[dict]:
    """The first rows of a result as objects: what a tool's reply can hold."""
    return [json.loads(x) for x in df.limit(most).toJSON().collect()]


class Tools:
    """Tool calls by name over a store: each takes the variant's name and arguments and returns plain data.

    Calls that change a graph save a new variant and append to the mutation log.
    """

    def __init__(self, store: documents.Store):
        self.store, self.spark = store, store.spark

    def names(self) -> list[str]:
        return sorted({"graph_list", "graph_checkout", "graph_fork", "graph_merge", "graph_diff", "graph_compare_metrics", "graph_drift", "graph_metrics_list", "graph_query", "graph_neighbors", "graph_path", "graph_activate", "graph_add_node", "graph_add_edge", "graph_update_weight", "contracts_tag", "contracts_list", "contracts_diff", "contracts_consumers", "contracts_producers", "contracts_export", "target_put", "target_list", "target_show", *(f"graph_metric_{m}" for m in records.METRICS)})

    def call(self, tool: str, /, **args):
        if tool not in self.names():
            raise ValueError(f"unknown tool {tool!r}")
        s = Scratch(self.spark)
        if tool.startswith("graph_metric_"):
            metric = tool.removeprefix("graph_metric_")
            rows, hit = self.store.cached(args["graph"], metric, lambda g: records.run_metrics(grouped(g, "role"), s, [metric]))
            return {"cached": hit, "records": _rows(rows)}
        return getattr(self, f"_{tool}")(s, **args)

    def _graph_list(self, s):
        return self.store.list()

    def _graph_checkout(self, s, graph):
        return _rows(self.store.checkout(graph))[0]

    def _graph_fork(self, s, graph, to, force=False):
        self.store.fork(graph, to, force)
        return self._graph_checkout(s, to)

    def _graph_merge(self, s, graph, other, to=None):
        self.store.save(to or graph, sets.merge(self.store.load(graph), self.store.load(other)))
        return self._graph_checkout(s, to or graph)

    def _graph_diff(self, s, graph, other):
        return _rows(sets.diff(self.store.load(graph), self.store.load(other), ("kind", "name")))

    def _graph_compare_metrics(self, s, graph, other, names=("components", "scc")):
        return _rows(service.compare_metrics(*(records.run_metrics(grouped(self.store.load(x), "role"), s, list(names)) for x in (graph, other))))

    def _graph_drift(self, s, graph, target, names=("components", "scc")):
        return self._graph_compare_metrics(s, graph, f"{service.TARGET}{graph}/{target}", names)

    def _graph_metrics_list(self, s):
        return sorted(records.METRICS)

    def _graph_query(self, s, graph, text, limit=30):
        return _rows(service.search(self.store.load(graph), text, limit))

    def _graph_neighbors(self, s, graph, id, direction="both", kinds=None):
        return _rows(traversal.neighbors(self.store.load(graph), _names(self.spark, id), direction, tuple(kinds) if kinds else None))

    def _graph_path(self, s, graph, start, end):
        found = traversal.shortest_paths(self.store.load(graph).directed(), start, s).where(F.col("id") == end).collect()
        return list(found[0]["path"]) if found else None

    def _changed(self, tool, graph, g, **args):
        self.store.save(graph, g)
        row = self.spark.createDataFrame([(tool, graph, json.dumps(args, sort_keys=True))], "tool string, graph string, args string")
        self.store.append("mutations", row.withColumn("at", F.current_timestamp()).coalesce(1))
        return args

    def _graph_add_node(self, s, graph, id, kind, attrs=None):
        row = self.spark.createDataFrame([(id, kind, attrs or {})], "id string, kind string, attrs map<string,string>")
        return self._changed("graph_add_node", graph, service.apply_mutations(self.store.load(graph), nodes=row), id=id, kind=kind)

    def _graph_add_edge(self, s, graph, src, dst, kind, attrs=None):
        row = self.spark.createDataFrame([(src, dst, kind, attrs or {}, 0)], "src string, dst string, kind string, attrs map<string,string>, seq long")
        return self._changed("graph_add_edge", graph, service.apply_mutations(self.store.load(graph), edges=row), src=src, dst=dst, kind=kind)

    def _graph_update_weight(self, s, graph, id, delta):
        row = self.spark.createDataFrame([(id, float(delta))], "id string, delta double")
        return self._changed("graph_update_weight", graph, service.apply_mutations(self.store.load(graph), weights=row), id=id, delta=delta)

    def _graph_activate(self, s, graph, ids, weight=1.0):
        rows = service.activate(_names(self.spark, ",".join(ids)), float(weight))
        return self._changed("graph_activate", graph, service.apply_mutations(self.store.load(graph), weights=rows), ids=list(ids), weight=weight)

    def _contracts_tag(self, s, graph):
        self.store.save(graph, service.tag_contracts(self.store.load(graph)))
        return self._contracts_list(s, graph)

    def _contracts_list(self, s, graph, kind="", visibility=""):
        return _rows(service.list_contracts(self.store.load(graph), kind, visibility).orderBy("id"))

    def _contracts_diff(self, s, graph, other, scope=""):
        return _rows(service.diff_contracts(self.store.load(graph), self.store.load(other), scope))

    def _contracts_consumers(self, s, graph, id):
        return _rows(contracts.consumers(self.store.load(graph), _names(self.spark, id)))

    def _contracts_producers(self, s, graph, id):
        return _rows(contracts.producers(self.store.load(graph), _names(self.spark, id)))

    def _contracts_export(self, s, graph):
        rows = _rows(service.openapi(self.store.load(graph)))
        if clash := [r for r in rows if r["section"] == "collision"]:
            raise ValueError(f"{clash[0]['key']} is claimed twice")
        paths: dict[str, dict] = {}
        for r in rows:
            if r["section"] == "path":
                method, path = r["key"].split(" ", 1)
                paths.setdefault(path, {})[method] = json.loads(r["body"])
        return {"openapi": "3.0.0", "paths": paths, "components": {"schemas": {r["key"]: json.loads(r["body"]) for r in rows if r["section"] == "schema"}}}

    def _target_put(self, s, graph, name, source):
        service.put_target(self.store, graph, name, self.store.load(source))
        return self._target_list(s, graph)

    def _target_list(self, s, graph):
        return service.list_targets(self.store, graph)

    def _target_show(self, s, graph, name):
        return _rows(service.show_target(self.store, graph, name))


def serve(tools: Tools, port: int = 8080):
    """An HTTP server of tool calls: GET /tools, GET /graphs, POST /tools/NAME with a JSON object. The caller runs and stops it."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def _say(self, status: int, body) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            known = {"/tools": tools.names, "/graphs": lambda: tools.call("graph_list")}
            self._say(200, known[self.path]()) if self.path in known else self._say(404, {"error": "not found"})

        def do_POST(self):
            args = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
            try:
                self._say(200, tools.call(self.path.removeprefix("/tools/"), **args))
            except (KeyError, TypeError, ValueError) as e:
                self._say(400, {"error": str(e)})

        def log_message(self, *_):
            return

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve_lines(tools: Tools, source, sink) -> None:
    """Tool calls as JSON lines {id, tool, args} from ``source``, each answered by {id, result} or {id, error} on ``sink``."""
    for line in source:
        if not line.strip():
            continue
        ask: dict = {}
        try:
            ask = json.loads(line)
            told = {"id": ask.get("id"), "result": tools.names() if ask["tool"] == "list" else tools.call(ask["tool"], **ask.get("args", {}))}
        except (KeyError, TypeError, ValueError) as e:
            told = {"id": ask.get("id") if isinstance(ask, dict) else None, "error": str(e)}
        sink.write(json.dumps(told) + "\n")
        sink.flush()


def run(spark: SparkSession, name: str, path: str, options: Options) -> DataFrame:
    if name not in COMMANDS:
        raise ValueError(f"unknown command {name!r}; known: {', '.join(sorted(COMMANDS))}")
    return COMMANDS[name](read_graph(spark, path, options), Scratch(spark), options)
