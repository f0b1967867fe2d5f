"""Closed-form graphs and brute force against the operators."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.graph import Graph
from loomgraph.operators import degrees, linalg, motifs, sets, statistics, traversal
from loomgraph.operators.components import connected_components
from loomgraph.plans.scratch import Scratch
from loomgraph.sources import documents
from loomgraph.streaming import transitions


def graph(spark, pairs, ids=(), kind="calls", groups=None):
    ids = sorted({x for p in pairs for x in p} | set(ids))
    nodes = spark.createDataFrame([(i, "function", i, (groups or {}).get(i, ""), (groups or {}).get(i, "")) for i in ids], "id string, kind string, name string, grp string, role string")
    edges = spark.createDataFrame([(a, b, kind, n) for n, (a, b) in enumerate(pairs)], "src string, dst string, kind string, seq long")
    return Graph(nodes, edges)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


CYCLE4 = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
TWO_TRIANGLES = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")]
PATH4 = [("a", "b"), ("b", "c"), ("c", "d")]


def test_cycles(spark):
    g = graph(spark, CYCLE4)
    assert {r.scc for r in traversal.strong_components(g.nodes, g.directed(), Scratch(spark)).collect()} == {"a"}
    assert rows(traversal.cycle_lengths(g.directed(), Scratch(spark))) == [(x, 4) for x in "abcd"]
    g = graph(spark, TWO_TRIANGLES)
    assert {r.scc for r in traversal.strong_components(g.nodes, g.directed(), Scratch(spark)).collect()} == {"a", "x"}
    g = graph(spark, PATH4)
    assert traversal.acyclic(g.nodes, g.directed(), Scratch(spark)).first()[0]
    assert rows(traversal.topological_levels(g.nodes, g.directed(), Scratch(spark))) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


@pytest.mark.parametrize("seed", range(3))
def test_random_reachability(spark, seed):
    rng = random.Random(seed)
    ids = [f"v{i:02d}" for i in range(14)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(20)]
    g, s = graph(spark, pairs, ids), Scratch(spark)
    reach = {(a, b) for a, b in pairs if a != b}
    while wider := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= wider
    assert set(rows(traversal.closure(g.directed(), s))) == reach
    want = {i: min([i, *(j for j in ids if (i, j) in reach and (j, i) in reach)]) for i in ids}
    assert dict(rows(traversal.strong_components(g.nodes, g.directed(), s))) == want
    both = {(a, b) for p in pairs for a, b in (p, p[::-1]) if a != b}
    part = {i: i for i in ids}
    for _ in ids:
        for a, b in both:
            part[b] = min(part[a], part[b])
    assert dict(rows(traversal.components(g, s))) == part


def test_components_edge_cases(spark):
    empty = spark.createDataFrame([], "u long, v long")
    assert rows(connected_components(empty, Scratch(spark))) == []
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, 4), (4, 3), (5, 4)], "u long, v long")
    assert rows(connected_components(odd, Scratch(spark))) == [(1, 1), (3, 3), (4, 3), (5, 3)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r.component for r in connected_components(chain, Scratch(spark)).collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100, 101 + i) for i in range(20)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (300, 300)]
    rng.shuffle(pairs)
    part = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(part[a], part[b])
            changed |= part[a] != low or part[b] != low
            part[a] = part[b] = low
    df = spark.createDataFrame([*pairs, (None, 1)], "u long, v long")
    assert dict(rows(connected_components(df, Scratch(spark)))) == part


def test_paths(spark):
    g = graph(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e")], ["z"])
    found = {r.id: r.path for r in traversal.shortest_paths(g.directed(), "a", Scratch(spark)).collect()}
    assert found["e"] == ["a", "b", "d", "e"] and "z" not in found
    seeds = spark.createDataFrame([("e",)], "id string")
    assert rows(traversal.khop(g, seeds, 1, Scratch(spark))) == [("d", 1), ("e", 0)]


def test_triangles_and_curvature(spark):
    rng = random.Random(1)
    ids = [f"n{i}" for i in range(12)]
    pairs = [p for p in itertools.combinations(ids, 2) if rng.random() < 0.4]
    near = {frozenset(p) for p in pairs}
    want = sorted(tuple(sorted(t)) for t in itertools.combinations(ids, 3) if all(frozenset(p) in near for p in itertools.combinations(t, 2)))
    g = graph(spark, pairs)
    assert rows(motifs.triangles(g.undirected())) == sorted(want, key=repr)
    degree = {i: sum(i in p for p in near) for i in ids}
    for r in motifs.curvature(g.undirected()).collect():
        assert r.kappa == 4 - degree[r.a] - degree[r.b] + 3 * sum({r.a, r.b} <= set(t) for t in want)


def test_motif3_counts_induced_paths(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    assert {(r.shape, r.n) for r in motifs.motif3(g).collect()} == {("triangle", 1), ("path", 2)}


def test_degrees_and_quotients(spark):
    groups = {"a": "x", "b": "x", "c": "y", "d": "y"}
    g = graph(spark, [("a", "c"), ("a", "c"), ("b", "d"), ("c", "c"), ("d", "a")], groups=groups)
    assert rows(degrees.quotient(g)) == [("x", "y", 3), ("y", "x", 1)]
    assert rows(degrees.quotient(g, distinct=True)) == [("x", "y", 2), ("y", "x", 1)]
    assert rows(degrees.bag_degrees(g)) == [("a", 1, 2), ("b", 0, 1), ("c", 3, 1), ("d", 1, 1)]
    assert rows(degrees.degree(g)) == [("a", 3), ("b", 1), ("c", 3), ("d", 2)]
    star = graph(spark, [("hub", f"l{i}") for i in range(4)])
    found = {(r.scope, r.target): r.value for r in degrees.instability(star).collect()}
    assert found["node", "hub"] == 1.0 and found["node", "l0"] == 0.0 and math.isclose(found["graph", ""], 0.2)


def test_modularity(spark):
    apart = graph(spark, TWO_TRIANGLES, groups={x: "1" if x in "abc" else "2" for x in "abcxyz"})
    assert math.isclose(degrees.modularity(apart).first()[0], 0.5)
    assert degrees.modularity(graph(spark, [("a", "a")])).first()[0] == 0.0


def test_policy_acceptance(spark):
    groups = {"a": "io", "b": "io", "c": "core", "d": "core"}
    g = graph(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("d", "c")], groups=groups)
    none = spark.createDataFrame([], "from_group string, to_group string")
    sinks = spark.createDataFrame([], "from_group string")
    found = sets.policy_residual(g, none, sinks).select("src", "dst")
    assert rows(found) == [("a", "c"), ("b", "c")]


def test_diff_merge_and_mutation(spark):
    a, b = graph(spark, [("a", "b"), ("b", "c")]), graph(spark, [("a", "b"), ("b", "d")])
    assert rows(sets.diff(a, b)) == sorted([("node", "c", "removed"), ("node", "d", "added"), ("edge", "b|calls|c", "removed"), ("edge", "b|calls|d", "added")])
    m = sets.merge(a, b)
    assert m.nodes.count() == 4 and m.edges.count() == 3
    assert rows(sets.remove_edge(a, "a", "b").edges.select("src", "dst")) == [("b", "c")]
    assert rows(sets.reverse_edge(a, "a", "b").edges.select("src", "dst")) == [("b", "a"), ("b", "c")]
    assert rows(sets.merge_node(a, "b", "a").edges.select("src", "dst")) == [("a", "c")]
    assert rows(sets.introduce(a, "n", "type", "c").edges.select("src", "dst")) == [("a", "b"), ("b", "n"), ("n", "c")]


def test_spectra(spark):
    s = Scratch(spark)
    path = linalg.spectral_summary(linalg.laplacian_spectrum(graph(spark, PATH4), s)).first()
    assert math.isclose(path.lambda2, 2 - math.sqrt(2), abs_tol=1e-9)
    clique = graph(spark, list(itertools.combinations("abcd", 2)))
    values = sorted(r.eigenvalue for r in linalg.laplacian_spectrum(clique, s).collect())
    assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(values, [0, 4, 4, 4]))
    islands = linalg.spectral_summary(linalg.laplacian_spectrum(graph(spark, TWO_TRIANGLES), s)).first()
    assert islands.components == 2 and islands.lambda2 < 1e-9


def test_trophic_chain(spark):
    g, s = graph(spark, [("top", "mid"), ("mid", "base")]), Scratch(spark)
    heights = linalg.trophic_levels(g, s)
    assert {r.id: round(r.height, 9) for r in heights.collect()} == {"top": 0, "mid": 1, "base": 2}
    assert abs(linalg.trophic_incoherence(g, heights).first().f0) < 1e-12


def test_articulation_and_louvain(spark):
    bridge = [("A1", "A2"), ("A2", "A3"), ("A1", "A3"), ("B1", "B2"), ("B2", "B3"), ("B1", "B3"), ("A3", "B1")]
    g, s = graph(spark, bridge), Scratch(spark)
    assert {r.id for r in linalg.articulation_points(g, s).collect()} == {"A3", "B1"}
    found = dict(rows(linalg.louvain(g, s)))
    assert len(set(found.values())) == 2 and found["A1"] == found["A2"] == found["A3"]
    sides = dict(rows(linalg.spectral_bisection(g, s)))
    assert sides["A1"] == sides["A2"] == sides["A3"] != sides["B1"]
    w = spark.createDataFrame([(x, 1.0 if x[0] == "A" else 0.5) for x in sides], "id string, weight double")
    best = min(statistics.sweep_cut(g, w).collect(), key=lambda r: r.conductance)
    assert best.place == 3 and math.isclose(best.conductance, 1 / 7)


def test_pagerank_sums_to_one(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")])
    assert math.isclose(traversal.pagerank(g.nodes, g.edges, Scratch(spark), rounds=15).agg(F.sum("score")).first()[0], 1.0)


def test_wl(spark):
    a, b = graph(spark, CYCLE4), graph(spark, [(x.upper(), y.upper()) for x, y in CYCLE4])
    s = Scratch(spark)
    assert math.isclose(traversal.wl_cosine(traversal.wl_labels(a, s, 2), traversal.wl_labels(b, s, 2)).first()[0], 1.0)
    assert traversal.wl_cosine(traversal.wl_labels(a, s, 2), traversal.wl_labels(graph(spark, PATH4), s, 2)).first()[0] < 1


def test_statistics(spark):
    v = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, 100.0)], "value double")
    z = {r.value: r.z for r in statistics.modified_z(v).collect()}
    assert math.isclose(z[100.0], 0.6745 * 97)
    same = spark.createDataFrame([(1.0,), (1.0,)], "value double")
    assert all(r.z is None for r in statistics.modified_z(same).collect())
    star = graph(spark, [("root", f"l{i:02d}") for i in range(20)], kind="part-of")
    hub = statistics.flat_stars(star).first()
    assert (hub.id, hub.children, hub.leaves, hub.groups, hub.feasible) == ("root", 20, 20, 2, True)


def test_globs_and_vectors(spark):
    row = spark.range(1).select(
        scalars.resolve_role(F.lit("a/b/c.go"), [("a/*.go", "no"), ("a/**", "yes")]).alias("role"), linalg.parse_vector(F.lit("1, 2.5 3")).alias("v"), linalg.parse_vector(F.lit("1,x")).alias("bad"), scalars.excluded(F.lit("x/vendor/y"), ["vendor"]).alias("ex")
    ).first()
    assert (row.role, row.v, row.bad, row.ex) == ("yes", [1.0, 2.5, 3.0], None, True)


def full_graph(spark):
    attrs = [("p", "package", "p<1>", "ex.com/p", "", 0, {}), ("t", "type", 'a "b" & c', "ex.com/p.T", "t.go", 7, {"role": "domain", "foreign": "true"}), ("q", "package", "", "ex.com/q", "", 0, {"note": " x|y "})]
    nodes = spark.createDataFrame(attrs, "id string, kind string, name string, qname string, file string, line int, attrs map<string,string>")
    ends = [("p", "t", "contains", {}, 0), ("p", "q", "dependsOn", {"kind": "k"}, 1), ("p", "q", "dependsOn", {"kind": "k"}, 1), ("q", "q", "dependsOn", {}, 2)]
    return Graph(nodes, spark.createDataFrame(ends, "src string, dst string, kind string, attrs map<string,string>, seq long"))


def told(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_documents_lose_nothing(spark, tmp_path):
    g = full_graph(spark)
    documents.write_json(g, f"{tmp_path}/json")
    documents.write_lines(g, f"{tmp_path}/lines")
    (part,) = list((tmp_path / "json").glob("part-*"))
    doc = json.loads(part.read_text())
    assert doc["version"] == 1 and [n["id"] for n in doc["nodes"]] == ["p", "q", "t"] and len(doc["edges"]) == 4
    own, ends = ("id", "kind", "name", "qname", "file", "line", "attrs"), ("src", "dst", "kind", "attrs")
    for back in (documents.read_json(spark, f"{tmp_path}/json"), documents.read_lines(spark, f"{tmp_path}/lines")):
        assert told(back.nodes, *own) == told(g.nodes, *own) and told(back.edges, *ends) == told(g.edges, *ends)
    near = documents.read_json(spark, f"{tmp_path}/json", foreign=False)
    assert rows(near.nodes.select("id")) == [("p",), ("q",)] and near.edges.count() == 3
    packages = documents.read_json(spark, f"{tmp_path}/json", granularity="package")
    assert rows(packages.nodes.select("id")) == [("ex.com/p",), ("ex.com/q",)] and rows(packages.edges.select("src", "dst")) == [("ex.com/p", "ex.com/q")]
    (tmp_path / "two.json").write_text('{"version": 2, "nodes": [], "edges": []}')
    with pytest.raises(ValueError):
        documents.read_json(spark, f"{tmp_path}/two.json")


def test_graphml_keys_and_errors(spark, tmp_path):
    g = full_graph(spark)
    documents.write_graphml(g, f"{tmp_path}/out")
    back = documents.read_graphml(spark, f"{tmp_path}/out")
    got = {r.id: r for r in back.nodes.collect()}
    assert got["t"].name == 'a "b" & c' and got["t"].qname == "ex.com/p.T" and got["t"].line == 7 and got["t"].attrs["role"] == "domain" and got["q"].attrs["note"] == "x|y"
    assert rows(back.edges.select("src", "dst")) == [("p", "q"), ("p", "q"), ("p", "t"), ("q", "q")]
    head = '<graphml><key id="k1" for="node" attr.name="archmotif_id"/><key id="k2" for="edge" attr.name="name"/><graph>'
    (tmp_path / "a.graphml").write_text(head + '<node id="x"><data key="k1"> own </data><data key="label">L</data><data key="k2">no</data></node><node id="y"/><edge source="x" target="y"><data key="label">uses</data></edge></graph></graphml>')
    a = documents.read_graphml(spark, f"{tmp_path}/a.graphml")
    assert rows(a.nodes.select("id", "name")) == [("own", "L"), ("y", "y")] and rows(a.edges.select("src", "dst", "kind")) == [("own", "y", "uses")]
    for name, body in (("dup", '<graphml><graph><node id="x"/><node id="x"/></graph></graphml>'), ("end", '<graphml><graph><node id="x"/><edge source="x" target="z"/></graph></graphml>')):
        (tmp_path / f"{name}.graphml").write_text(body)
        with pytest.raises(ValueError):
            documents.read_graphml(spark, f"{tmp_path}/{name}.graphml")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = transitions.running_activation(stream).writeStream.outputMode("update").format("memory").queryName("active").trigger(availableNow=True).start()
    run.awaitTermination()
    last = {r.event_type: r.events for r in spark.sql("select event_type, max(events) events from active group by event_type").collect()}
    assert last == {r.event_type: r.n for r in events.groupBy("event_type").agg(F.count("*").alias("n")).collect()}


def test_oracle_queries_on_the_small_table(spark):
    """A query of each kind against its SQL, on the smallest tables; the driver runs all of them."""
    import duckdb

    from loomgraph import queries

    base, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{base}/{t}.parquet'")
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    for name in ("flagship_instability", "quotient_distinct", "modularity_labels", "policy_residual", "curvature", "graph_diff", "strong_components", "pagerank", "dangling_edges", "role_coupling", "motif_groups_4", "patch_validation", "silhouette", "contracts_diff", "package_projection"):
        found = queries.QUERIES[name](spark, base)
        cur = con.execute(queries.ORACLES[name])
        names = [d[0] for d in cur.description]
        want = sorted((tuple(clean(v) for v in r) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(clean(r[n]) for n in names) for r in found.collect()), key=repr) == want, name
