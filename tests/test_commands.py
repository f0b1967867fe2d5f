"""Commands, tools, configuration and operators on small graphs with known results."""

import io
import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from loomgraph import commands, config
from loomgraph.functions import scalars
from loomgraph.graph import Graph
from loomgraph.operators import findings, patterns, records, service, spectral, targets, traversal, views
from loomgraph.plans.scratch import Scratch
from loomgraph.sources.documents import Store, write_graphml

NODES = [("p", "package", "P", "ex.com/p", {"role": "domain"}), ("q", "package", "Q", "ex.com/q", {"role": "infrastructure"}), ("T", "type", "Thing", "ex.com/p.Thing", {}), ("m", "method", "Do", "ex.com/p.Thing.Do", {}), ("f", "function", "run", "ex.com/q.run", {"labels": "a, b"})]
EDGES = [("p", "q", "dependsOn"), ("p", "T", "contains"), ("T", "m", "contains"), ("q", "f", "contains"), ("f", "m", "calls"), ("m", "f", "calls")]


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame(NODES, "id string, kind string, name string, qname string, attrs map<string,string>")
    edges = spark.createDataFrame([(*e, i) for i, e in enumerate(EDGES)], "src string, dst string, kind string, seq long")
    return Graph(nodes, edges)


def graph(spark, pairs, kind="calls", node="function"):
    ids = sorted({x for p in pairs for x in p})
    return Graph(
        spark.createDataFrame([(i, node, i, "", "") for i in ids], "id string, kind string, name string, grp string, role string"),
        spark.createDataFrame([(a, b, kind, n) for n, (a, b) in enumerate(pairs)], "src string, dst string, kind string, seq long"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_commands_on_a_document(spark, small, tmp_path):
    path = f"{tmp_path}/g.graphml"
    write_graphml(small, path)
    (tmp_path / "rules").write_text(json.dumps({"partition": "role", "allow": [{"from": "infrastructure", "to": "domain"}]}))
    (tmp_path / "skeleton").write_text(json.dumps({"target_subgraph": {"roles": [{"id": "t", "kind": "type"}, {"id": "x", "kind": "method"}], "edges": [{"from": "t", "to": "x", "kind": "contains"}]}}))
    more = {"policy": {"rules": str(tmp_path / "rules")}, "verify": {"skeleton": str(tmp_path / "skeleton")}, "diff": {"after": path}, "drift": {"after": path}, "calculate": {"name": "cycles"}, "ppr": {"seeds": "f"}, "region": {"seeds": "f"}, "metrics": {"names": "components,scc,nothing"}, "graphml-scan": {"names": "orphan_bucket,hierarchy_cycle"}}
    found = {}
    whole = commands.read_graph(spark, path)
    s = Scratch(spark)
    whole = Graph(s.save(whole.nodes, "nodes"), s.save(whole.edges, "edges"))
    for name in ("graph", "metrics", "policy", "verify", "diff", "calculate", "ppr", "contracts", "coupling", "diagram", "export", "pkg-graph", "patterns", "view", "quotient"):
        found[name] = commands.COMMANDS[name](whole, s, more.get(name, {"partition": "role"} if name == "quotient" else {})).collect()
    assert sum(r.n for r in found["graph"]) == len(NODES) + len(EDGES)
    assert {(r.metric, r.scope): r.value for r in found["metrics"]} == {("components", "graph"): 1.0, ("scc", "graph"): 4.0, ("nothing", "error"): None}
    assert sorted((r.src, r.dst) for r in found["policy"]) == [("p", "T"), ("p", "q"), ("q", "f")] and found["diff"] == []
    assert [(r.status, r.detail) for r in found["verify"]] == [("match", "1")]
    assert [(r.size, r.members) for r in found["calculate"]] == [(2, "f,m")]
    assert [r.id for r in found["contracts"]] == ["T"] and found["ppr"][0].id in ("f", "m")
    assert any("->" in r.text for r in found["diagram"])
    with pytest.raises(ValueError):
        commands.run(spark, "nothing", path, {})


def test_tools_over_http(spark, small, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.save("actual", small)
    tools = commands.Tools(store)
    assert tools.call("graph_path", graph="actual", start="p", end="m") == ["p", "T", "m"]
    tools.call("graph_add_node", graph="actual", id="n", kind="type")
    tools.call("graph_add_edge", graph="actual", src="n", dst="T", kind="embeds")
    tools.call("graph_activate", graph="actual", ids=["n", "T"], weight=2)
    tools.call("graph_update_weight", graph="actual", id="n", delta=0.5)
    weights = {r.id: r.attrs.get("weight") for r in store.load("actual").nodes.collect()}
    assert weights["n"] == "2.5" and weights["T"] == "2.0" and weights["p"] is None
    assert {r.tool for r in spark.read.json(f"{store.root}/mutations").collect()} == {"graph_add_node", "graph_add_edge", "graph_activate", "graph_update_weight"}
    assert [r["id"] for r in tools.call("contracts_tag", graph="actual")] == ["T"]
    assert tools.call("contracts_export", graph="actual")["components"]["schemas"]["Thing"]["type"] == "object"
    assert tools.call("graph_fork", graph="actual", to="draft")["nodes"] == 6
    assert tools.call("contracts_diff", graph="actual", other="draft") == [] and tools.call("target_put", graph="actual", name="t", source="draft") == ["t"]
    assert not tools.call("graph_metric_components", graph="draft")["cached"] and tools.call("graph_metric_components", graph="draft")["cached"]
    server = commands.serve(tools, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    assert "draft" in json.load(urllib.request.urlopen(f"{base}/graphs"))
    ask = urllib.request.Request(f"{base}/tools/graph_query", json.dumps({"graph": "actual", "text": "THING"}).encode())
    assert {r["id"] for r in json.load(urllib.request.urlopen(ask))} == {"T", "m"}
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(urllib.request.Request(f"{base}/tools/nothing", b"{}"))
    server.shutdown()
    sink = io.StringIO()
    commands.serve_lines(tools, ['{"id": 1, "tool": "graph_list"}\n', '{"id": 2, "tool": "nothing"}', "no json", '{"id": 3, "tool": "list"}'], sink)
    told = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert told[0]["result"] == tools.call("graph_list") and "unknown" in told[1]["error"] and "error" in told[2] and "graph_path" in told[3]["result"]


def test_configuration(tmp_path):
    assert config.load_config(str(tmp_path)) == config.Config()
    path = tmp_path / config.CONFIG_NAME
    path.write_text(json.dumps({"contracts": ["ex.com/p.T"], "exclude": {"dirs": ["gen"]}, "roles": [{"glob": "x/**", "role": "domain"}], "coupling": {"forbidden": [{"from": "a", "to": "b", "reason": "first"}, {"from": "a", "to": "b", "reason": "second"}]}}))
    found = config.load_config(str(tmp_path))
    assert found.contracts == ("ex.com/p.T",) and found.exclude_dirs == ("gen",) and found.forbidden == (("a", "b", "first"),)
    for bad in ({"contract": []}, {"contracts": ["nodot"]}, {"exclude": {"folders": []}}, {"coupling": {"forbidden": [{"from": "a"}]}}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load_config(str(tmp_path))
    with pytest.raises(ValueError):
        config.parse_policy("{}")
    catalog = str(tmp_path / "catalog")
    config.save_catalog(catalog, [{"label": "b", "n": 1}, {"label": "a"}, {"label": "b", "n": 2}])
    assert config.load_catalog(catalog) == [{"label": "a"}, {"label": "b", "n": 2}] and config.load_catalog(str(tmp_path / "none")) == []


def test_package_folders(tmp_path):
    for f in ("a.go", "b/b.go", "b/c/c_test.go", "b/d/d.go", "vendor/v.go", "_x/x.go", ".h/h.go", "gen/g.go", "b/gen/g.go"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("")
    assert config.package_dirs(str(tmp_path)) == [".", "b", "b/d", "b/gen", "gen"]
    assert config.package_dirs(str(tmp_path), ("./b/...",), ("gen",), tests=True) == ["b", "b/c", "b/d"]
    assert config.package_dirs(str(tmp_path), ("b", "./..."), ("b/d",)) == [".", "b", "b/gen", "gen"] and config.package_dirs(str(tmp_path), ("b",)) == ["b"]


def test_long_paths_are_not_cut(spark):
    s = Scratch(spark)
    ids = [f"n{i:04}" for i in range(1001)]
    path = graph(spark, list(zip(ids, ids[1:])))
    assert traversal.acyclic(path.nodes, path.directed(), s).first().acyclic
    loop = graph(spark, [*zip(ids[:40], ids[1:40]), (ids[39], ids[0])])
    assert not traversal.acyclic(loop.nodes, loop.directed(), s).first().acyclic
    n = 66
    short = graph(spark, list(zip(ids[:n], ids[1 : n + 1])))
    end = {r.id: r for r in traversal.shortest_paths(short.directed(), ids[0], s).collect()}
    assert len(end) == n + 1 and end[ids[n]].hops == n and end[ids[n]].path == ids[: n + 1]
    assert traversal.closure(short.directed(), s).count() == n * (n + 1) // 2


def test_layer_mask_and_broken_metrics(spark, monkeypatch):
    g = graph(spark, [("d", "i"), ("i", "d"), ("d", "x")])
    role = F.when(F.col("id") == "d", "domain").when(F.col("id") == "i", "infrastructure").otherwise("")
    g = Graph(g.nodes.withColumn("role", role), g.edges)
    assert rows(records.layer_mask_records(g).select("scope", "target", "value")) == [("edge", "d→i", 1.0), ("graph", "", 1.0)]

    def broken(g, s):
        raise ValueError("no such thing")

    monkeypatch.setitem(records.METRICS, "broken", broken)
    told = records.run_metrics(g, Scratch(spark), ["broken", "components"]).collect()
    assert {(r.metric, r.scope, r.value) for r in told} == {("broken", "error", None), ("components", "graph", 1.0)}


def test_local_partition_of_two_cliques(spark):
    pairs = [("A1", "A2"), ("A1", "A3"), ("A2", "A3"), ("B1", "B2"), ("B1", "B3"), ("B2", "B3"), ("A3", "B1")]
    g = graph(spark, pairs)
    found = spectral.local_partition(g, spark.createDataFrame([("A1",)], "id string"), Scratch(spark), epsilon=1e-4).collect()
    assert sorted(r.id for r in found) == ["A1", "A2", "A3"] and abs(found[0].conductance - 1 / 7) < 1e-9


def test_choices_of_k():
    assert spectral.eigengap([0, 0, 1, 1.1, 9, 9.5], 5) == (4, 9 / 1.1) and spectral.eigengap([0, 1], 3) == (2, 0.0)
    assert spectral.knee([10, 9, 2, 1, 0.5, 0]) == 3 and spectral.knee([1, 1, 1]) == 2 and spectral.knee([5]) == 1
    ks = spectral.gap_candidates([0, 0.1, 0.2, 3.0, 3.1, 3.2])
    assert ks[0][0] == 3 and ks[0][3] == "strong" and spectral.gap_candidates([0.0]) == []
    import numpy as np

    x = np.array([[0.0, 0], [0.1, 0], [5, 5], [5.1, 5], [0, 0.1]])
    for how in ("norm", "index", "spread"):
        labels = spectral.lloyd(x, 2, how)
        assert len({labels[0], labels[1], labels[4]}) == 1 and labels[2] == labels[3] != labels[0]
    assert spectral.silhouette_of(x, labels) > 0.9 and spectral.lloyd(x, 9, "norm").tolist() == [0, 1, 2, 3, 4]


def test_spectral_clusters_find_cliques(spark):
    import itertools

    pairs = [(f"{c}{i}", f"{c}{j}") for c in "ABC" for i, j in itertools.combinations(range(4), 2)] + [("A0", "B0"), ("B1", "C0")]
    found = spectral.clusters(graph(spark, pairs), Scratch(spark)).collect()
    assert {r.k for r in found} == {3} and all({r.cluster for r in found if r.id[0] == c} == {f"{c}0"} for c in "ABC")


def test_motifs_by_brute_force(spark):
    """A planted shape, and the rule that members of one type don't count."""
    nodes = [("T", "type"), ("a", "method"), ("b", "method"), ("c", "method"), *((f"f{i}", "function") for i in range(6))]
    edges = [("T", x, "contains") for x in "abc"] + [("a", "b", "calls"), ("b", "c", "calls"), ("f0", "f1", "calls"), ("f1", "f2", "calls"), ("f3", "f4", "calls"), ("f4", "f5", "calls")]
    g = Graph(spark.createDataFrame(nodes, "id string, kind string"), spark.createDataFrame([(*e, 0) for e in edges], "src string, dst string, kind string, seq long"))
    found = patterns.instances(g, 3, Scratch(spark))
    assert rows(found.select(F.array_join("members", ""))) == [("f0f1f2",), ("f3f4f5",)]
    assert rows(patterns.motif_groups(found).select("instances", "canonical")) == [(2, "k=3;nodes=function,function,function;edges=0-calls->1|1-calls->2|")] or rows(patterns.motif_groups(found).select("instances")) == [(2,)]


def test_findings_keep_going(spark, monkeypatch):
    g = graph(spark, [("a", "b"), ("b", "a"), ("c", "c")], kind="part-of")

    def broken(g, s):
        raise RuntimeError("x")

    monkeypatch.setitem(findings.FINDINGS, "broken", broken)
    out = findings.find(g, Scratch(spark), ["broken", "hierarchy_cycle", "absent"])
    assert rows(out.select("detector", "severity", "members")) == [("absent", "error", "not registered"), ("broken", "error", "RuntimeError"), ("hierarchy_cycle", "high", "a,b"), ("hierarchy_cycle", "medium", "c")]


def test_scalars_of_odd_values(spark):
    r = spark.range(1).select(
        scalars.slug(F.lit("")).alias("a"), scalars.slug(F.lit("a/b c")).alias("b"), scalars.short_import_path(F.lit("a/b/c"), 0).alias("c"), scalars.split_identifier(F.lit("nodot"))["name"].alias("d"),
        scalars.fnv1a(F.lit("")).alias("e"), scalars.fnv1a(F.lit("foobar")).alias("f"), scalars.newton_sqrt(F.lit(-4)).alias("g"), scalars.round_half_away(F.lit(-2.5), 0).alias("h"), scalars.coerced_kind(F.lit("1e3")).alias("i"), scalars.exported(F.lit("")).alias("j"),
    ).first()
    assert tuple(r) == ("graph", "a_b_c", "a/b/c", "", "cbf29ce484222325", "85944171f73967e8", 0.0, -3.0, "float", False)


def test_targets_and_embeddings(spark, small):
    with pytest.raises(ValueError):
        targets.expand_target(spark, targets.Proposal("x", "r", "", 0, (targets.TargetRole("A", "type", 2), targets.TargetRole("B", "type", 3)), (("A", "B", "calls"),)))
    assert targets.parse_patch('Sure:\n```json\n{"a": 1}\n```\nbye') == {"a": 1} and targets.parse_patch('{"b": 2}') == {"b": 2}
    p = targets.Proposal("x", "r", "", 0, (targets.TargetRole("Port", "type"), targets.TargetRole("Impl", "type"), targets.TargetRole("Run", "method")), (("Impl", "Port", "implements"), ("Impl", "Run", "contains")))
    assert config.parse_skeleton(json.dumps({"target_subgraph": {"roles": [{"id": "Port", "kind": "type"}], "edges": []}})).roles[0].id == "Port"
    assert "type Port interface" in targets.source_stub(p, "x") and "func (x *Impl) Run()" in targets.source_stub(p, "x") and "kind: implements" in targets.skeleton_yaml(p)
    log = targets.optimise(3, lambda s: s or None, lambda s, p: s - 1, lambda s, p, m: "", lambda s: (s, 0), 10)
    assert [x["status"] for x in log] == ["improved", "improved", "improved", "empty"]
    vectors = commands.embed(small.nodes.select("id", F.col("name").alias("text")), commands.HashedWords(16)).collect()
    assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-9 for r in vectors)
    assert rows(views.owners(small, Scratch(spark))) == [("T", "p"), ("f", "q"), ("m", "p"), ("p", "p"), ("q", "q")]
    assert rows(service.search(small, "do").select("id")) == [("m",)]
