"""Graphs beyond a dense kernel's size, with the bound lowered so that small ones are."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import blocks, components, findings, linalg, motifs, patterns, records, sparse, spectral, traversal
from loomgraph.plans.scratch import Scratch
from loomgraph.sources import graphs


def graph(spark, pairs, ids=(), kind="calls"):
    ids = sorted({x for p in pairs for x in p} | set(ids))
    nodes = spark.createDataFrame([(i, "function", i, "", "") for i in ids], "id string, kind string, name string, grp string, role string")
    edges = spark.createDataFrame([(a, b, kind, n) for n, (a, b) in enumerate(pairs)], "src string, dst string, kind string, seq long")
    return Graph(nodes, edges)


def test_gap_of_parts_beyond_a_kernel(spark, monkeypatch):
    monkeypatch.setattr(linalg, "MOST_NODES", 3)
    g, s = graph(spark, [(f"{c}0", f"{c}{i}") for c in "ab" for i in range(1, 6)]), Scratch(spark)
    told = records.run_metrics(g, s, ["spectral_gap", "eigenvalues"])
    assert sorted(map(tuple, told.collect())) == [("eigenvalues", "graph", "", 12.0), ("spectral_gap", "graph", "", 0.0)]
    assert [r.code for r in findings.detect(told, ["spectral_gap"]).collect()] == ["disconnected"]


def test_gap_of_one_part_is_the_kernels(spark):
    told = records.run_metrics(graph(spark, [("a", "b"), ("b", "c")]), Scratch(spark), ["spectral_gap"])
    assert told.first()["value"] == pytest.approx(1.0)


@pytest.mark.parametrize("seed", range(2))
def test_heights_beyond_a_kernel(spark, monkeypatch, seed):
    rng = random.Random(seed)
    tree = [(f"t{rng.randrange(i):02d}", f"t{i:02d}") for i in range(1, 20)] + [("t03", "t01")]
    ring = [(f"r{i:02d}", f"r{(i + 1) % 9:02d}") for i in range(9)] + [("r00", "r04"), ("r00", "r04"), ("r05", "x"), ("x", "y")]
    g, s = graph(spark, tree + ring + [("p", "q"), ("self", "self")], ["alone"]), Scratch(spark)
    want = dict(map(tuple, linalg.trophic_levels(g, s).collect()))
    monkeypatch.setattr(linalg, "MOST_NODES", 3)
    found = dict(map(tuple, linalg.trophic_levels(g, s).collect()))
    assert set(found) == set(want)
    assert np.allclose([found[k] for k in sorted(want)], [want[k] for k in sorted(want)], atol=1e-8)


def connected(near, gone):
    """The parts of what is left without a node."""
    left, out = set(near) - {gone}, []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            more = (near[todo.pop()] & left) - part
            left -= more
            part |= more
            todo += more
        out.append(part)
    return out


def test_cut_vertices_by_brute_force():
    rng = random.Random(5)
    for n in (2, 5, 9, 14):
        for extra in (0, 3, 8, 60):
            pairs = {tuple(sorted((rng.randrange(max(0, i - 4), i), i))) for i in range(1, n)}
            pairs |= {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(extra)) if a < b and (b < n // 2 or a >= n // 2)}
            near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(n)}
            want = {}
            for v in range(n):
                stays = min(near[0]) if v == 0 else 0
                if cut := [len(p) for p in connected(near, v) if stays not in p]:
                    want[v] = max(cut)
            a, b = np.array(sorted(pairs)).T
            assert linalg.cut_vertices(linalg.Sparse(n, a, b)) == want


def test_communities_of_a_component_beyond_a_dense_kernel(spark, monkeypatch):
    """Rings of cliques in one component, and a node alone."""
    monkeypatch.setattr(linalg, "MOST_NODES", 3)
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "abcd" for i, j in itertools.combinations(range(6), 2)] + [("a0", "b0"), ("b1", "c1"), ("c2", "d2"), ("d3", "a3")]
    found = dict(map(tuple, linalg.louvain(graph(spark, pairs, ["z"]), Scratch(spark)).collect()))
    want = {f"{c}{i}": f"{c}0" for c in "abcd" for i in range(6)} | {"z": "z"}
    assert found == want
    monkeypatch.setattr(linalg, "MOST_PAIRS", 3)
    assert dict(map(tuple, linalg.louvain(graph(spark, pairs, ["z"]), Scratch(spark)).collect())) == want


def test_hashed_words_are_worked_out_once_a_row(spark):
    """The plan holds the words' hashes once, however many cells and uses of the norm there are."""
    from loomgraph.commands import HashedWords

    df = spark.createDataFrame([(0, "a b c a"), (1, "")], "id int, t string").select("id", HashedWords(8).embed(F.col("t")).alias("v"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("xxhash64(") == 2, plan
    one, none = (r.v for r in df.orderBy("id").collect())
    assert sum(x * x for x in one) == pytest.approx(1.0) and none == [0.0] * 8


@pytest.mark.parametrize("seed", range(2))
def test_forms_of_three_without_a_list(spark, seed):
    """Numbers, type shapes and interfaces as from the list of all instances, which a hub makes long."""
    rng = random.Random(seed)
    kind = {f"{k[0]}{i}": k for k, n in (("type", 7), ("method", 7), ("function", 4)) for i in range(n)}
    ids, s = list(kind), Scratch(spark)
    hub = [("t0", x, k) for x, k in zip(ids[1:], itertools.cycle(["usesType", "returns"]))]
    some = [(rng.choice(ids), rng.choice(ids), rng.choice(["calls", "returns", "usesType"])) for _ in range(22)]
    does = [(f"t{rng.randrange(7)}", f"t{rng.randrange(7)}", "implements") for _ in range(8)]
    held = [(f"t{rng.randrange(7)}", f"m{i}", "contains") for i in range(6)] + [("t1", "m1", "contains")]
    more = [("m1", "t1", "returns"), ("m2", "t1", "returns"), ("m3", "m4", "calls")]
    nodes = spark.createDataFrame([(i, k, i, "", "") for i, k in kind.items()], "id string, kind string, name string, grp string, role string")
    edges = [(*e, n) for n, e in enumerate(hub[:: seed + 1] + some + does + held + more)]
    g = Graph(nodes, spark.createDataFrame([(a, b, k, n) for a, b, k, n in edges], "src string, dst string, kind string, seq long"))
    listed, threes = s.save(patterns.instances(g, 3, s)), patterns.Threes(g, s)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(threes.counts(), patterns.motif_groups(listed, 1))
    assert same(threes.type_shapes(), patterns.type_shapes(listed, g))
    assert same(threes.extract_interface(), patterns.extract_interface(listed, g))
    assert same(threes.extract_interface(1), patterns.extract_interface(listed, g, 1))
    assert threes.shut.count() < 6 * listed.count()


@pytest.mark.parametrize("most", [1 << 22, 20])
def test_triangles_of_components(spark, monkeypatch, most):
    """By component and, beyond its bound, by joins: triangles, sides and their number as by brute force; paths are not shuffled."""
    monkeypatch.setattr(sparse, "MOST_PAIRS", most)
    monkeypatch.setattr(sparse, "STEP", 7)
    rng = random.Random(3)
    pairs = {tuple(sorted((f"{c}{a}", f"{c}{b}"))) for c, n in (("p", 60), ("q", 12)) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(n)) if a != b}
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for p in pairs for x in p}
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    want = sorted(t for t in itertools.combinations(sorted(near), 3) if all(p in pairs for p in itertools.combinations(t, 2)))
    assert sorted(map(tuple, motifs.triangles(df).collect())) == want
    assert motifs.triangle_count(df).first()["t"] == len(want)
    kappa = sorted((a, b, len(near[a] & near[b]), 4 - len(near[a]) - len(near[b]) + 3 * len(near[a] & near[b])) for a, b in pairs)
    assert sorted(map(tuple, motifs.curvature(df).collect())) == kappa
    monkeypatch.setattr(sparse, "TABLE_BYTES", 1)
    assert sorted(map(tuple, motifs.triangles(df).collect())) == want
    assert motifs.triangles(df.limit(0)).count() == 0


def test_semantic_clusters_beyond_a_kernel(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) + 6 * np.eye(4)[i % 3]).tolist()) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, None)], "id long, vec array<double>")
    want = sorted(map(tuple, spectral.semantic_clusters(df, most=4).collect()))
    found = sorted(map(tuple, spectral.semantic_clusters(df, most=4, bound=20).collect()))
    assert [r[:3] for r in found] == [r[:3] for r in want] and len(found) == 60
    assert found[0][3] == pytest.approx(want[0][3])


@pytest.mark.parametrize("ending", ["", "\n", " <!-- a > b -->", " <!-- a > b -->\n"])
def test_a_document_is_read_in_pieces(spark, tmp_path, ending):
    """A document of one line, keys at its end, read by many tasks: no row is long, and its nodes are whole and in order."""
    data = "".join(f'<data key="k">{i} <!-- > -->é &gt; ]<x>no</x>no</data><data key="other">&#10;</data>' for i in range(3))
    nodes = "".join(f'<node id="n{i}">{data}</node><edge source="n{i}" target="n0" a="&gt;>"/>' for i in range(2000))
    text = f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="urn:g"><graph>{nodes}</graph><key id="k" for="node" attr.name="label"/></graphml>{ending}'
    for name in "ab":
        (tmp_path / f"{name}.graphml").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        pieces = graphs._pieces(spark, str(tmp_path))
        assert pieces.select("path", "start").distinct().count() > 4
        assert pieces.agg(F.max(F.length("part"))).first()[0] < len(text) / 20
        found = graphs.element_rows(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 8000
    assert sorted((r.seq, r.element, r.xml_id) for r in found) == sorted([(2 * i, "node", f"n{i}") for i in range(2000)] * 2 + [(2 * i + 1, "edge", "") for i in range(2000)] * 2)
    assert {tuple(sorted(r.attrs.items())) for r in found if r.element == "node"} == {(("label", "2 é > ]"), ("other", ""))}
    (tmp_path / "c.graphml").write_text(text[: len(text) // 2])
    with pytest.raises(Exception, match="no element found|unclosed token|not well-formed"):
        graphs.element_rows(spark, str(tmp_path / "c.graphml")).collect()


@pytest.mark.parametrize("most", [1 << 22, 20])
def test_graph_of_groups(spark, monkeypatch, most):
    """What is told of a graph by its groups is told by its pairs, which are not made: parts, curvature, moments, cut vertices."""
    monkeypatch.setattr(sparse, "MOST_PAIRS", most)
    rng = random.Random(4)
    sets = [rng.choices([f"{c}{i}" for i in range(n)], k=rng.randrange(1, 5)) for c, n, m in (("p", 40, 45), ("q", 9, 6), ("r", 6, 6)) for _ in range(m)]
    pairs = sorted({p for s in sets for p in itertools.combinations(sorted(set(s)), 2)})
    plain = graph(spark, pairs, {x for s in sets for x in s} | {"z"})
    groups = spark.createDataFrame([(n, x) for n, s in enumerate(sets) for x in s], "grp long, id string")
    none = plain.edges.withColumn("src", F.expr("assert_true(false, 'pairs are made')").cast("string"))
    g, rows = Graph(plain.nodes, none, groups), lambda df: sorted(map(tuple, df.collect()))
    same = lambda f: rows(f(g, Scratch(spark))) == rows(f(plain, Scratch(spark)))
    assert linalg.fits_kernel(g, Scratch(spark))
    assert rows(motifs.curvature(g)) == rows(motifs.curvature(plain.undirected()))
    assert same(lambda x, s: linalg.moments_by_joins(x, s)) and same(lambda x, s: linalg.articulation_points(x, s))
    for share in (1, 1000):
        parts = components.grouped_components(groups, Scratch(spark), share)[1]
        assert {r.id: r.component for r in parts.collect()}.items() <= dict(rows(traversal.components(plain, Scratch(spark)))).items()


def test_components_by_one_task_and_by_rounds(spark, monkeypatch):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    for kind in ("long", "string"):
        df = spark.createDataFrame(pairs, "u long, v long").select(*(F.col(c).cast(kind).alias(c) for c in "uv"))
        found = sorted(map(tuple, components.connected_components(df, Scratch(spark)).collect()))
        monkeypatch.setattr(components, "ONE_TASK", 30)
        some = sorted(map(tuple, components.connected_components(df, Scratch(spark)).collect()))
        monkeypatch.setattr(components, "ONE_TASK", 0)
        assert found == some == sorted(map(tuple, components.connected_components(df, Scratch(spark)).collect()))
        monkeypatch.undo()


@pytest.mark.parametrize("rows", [30, 1 << 21])
def test_groups_are_packed_by_component(spark, rows):
    """A row holds many sets, each whole; a row without a group or an id joins nothing; tasks' components are joined by the ids that they share."""
    rng = random.Random(6)
    sets = [rng.choices([f"{c}é{i}" for i in range(n)], k=rng.randrange(1, 6)) for c, n, m in (("p", 50, 40), ("q", 30, 9), ("r", 4, 5)) for _ in range(m)]
    cells = [(n, x) for n, s in enumerate(sets) for x in s]
    groups = spark.createDataFrame([*cells, (None, "pé0"), (None, "qé0"), (None, "ré0"), (0, None), (60, None)], "grp long, id string")
    parts, members = components.grouped_components(groups, Scratch(spark), rows)
    pairs = {p for s in sets for p in itertools.combinations(sorted(set(s)), 2)}
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for p in pairs for x in p}
    want = {x: min(part) for part in connected(near, None) for x in part}
    assert sorted(map(tuple, members.collect())) == sorted(want.items())
    found = parts.toArrow()
    assert len(found) < len(sets)
    assert sum(found["pairs"].to_pylist()) == sum(len(set(s)) * (len(set(s)) - 1) // 2 for s in sets)
    for part in set(want.values()):
        s = sparse.Sparse.of(found.filter([x == part for x in found["component"].to_pylist()]))
        assert {tuple(sorted((s.ids[a], s.ids[b]))) for a, b in zip(s.a, s.b)} == {p for p in pairs if want[p[0]] == part}
    none = components.grouped_components(groups.limit(0), Scratch(spark))
    assert [x.count() for x in none] == [0, 0]


@pytest.mark.parametrize("most", [1 << 22, 20])
def test_the_least_curvatures(spark, monkeypatch, most):
    """The first by (kappa, a, b) are among what is sent, and a component in a task sends no others; ids are ordered by code points."""
    monkeypatch.setattr(sparse, "MOST_PAIRS", most)
    rng = random.Random(8)
    pairs = {tuple(sorted((f"{c}{a}", f"{c}{b}"))) for c, n in (("p", 60), ("é", 9), ("\U0001f600", 9), ("～", 9)) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(n)) if a != b}
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    order = lambda r: (r.kappa, r.a, r.b)
    want = sorted(motifs.curvature(df).collect(), key=order)
    parts = traversal.components(graph(spark, sorted(pairs)), Scratch(spark)).select("component").distinct().count()
    for n in (0, 4, 1000):
        found = sorted(motifs.curvature(df, n).collect(), key=order)
        assert found[:n] == want[:n] and set(found) <= set(want)
        assert len(found) <= n * parts or most == 20


@pytest.mark.parametrize("table", [1 << 27, 1])
def test_sides_of_triangles(monkeypatch, table):
    """By rows of bits or, where those don't fit, by a list: the neighbours that a pair's ends share."""
    monkeypatch.setattr(sparse, "TABLE_BYTES", table)
    rng = random.Random(9)
    for n, m in ((2, 1), (64, 300), (150, 900)):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        rng.shuffle(pairs)
        near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for x in range(n)}
        for step in (7, 1 << 19):
            monkeypatch.setattr(sparse, "STEP", step)
            assert sparse.Sparse(n, *np.array(pairs).T).sides().tolist() == [len(near[a] & near[b]) for a, b in pairs]
    assert len(sparse.Sparse(0, *np.empty((2, 0), np.int64)).sides()) == 0


@pytest.mark.parametrize("most", [1 << 22, 25, 0])
def test_strong_components_by_one_task_and_by_colours(spark, monkeypatch, most):
    monkeypatch.setattr(traversal, "ONE_TASK", most)
    rng = random.Random(11)
    pairs = [(f"v{rng.randrange(30)}", f"v{rng.randrange(30)}") for _ in range(45)] + [("x", "y"), ("y", "x"), ("z", "z")]
    g = graph(spark, pairs)
    reach = {(a, b) for a, b in pairs}
    while wider := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= wider
    ids = {x for p in pairs for x in p}
    want = {i: min([i, *(j for j in ids if (i, j) in reach and (j, i) in reach)]) for i in ids}
    assert len(set(want.values())) < len(ids)
    assert dict(map(tuple, traversal.strong_components(g.nodes, g.directed(), Scratch(spark)).collect())) == want


def test_a_long_path_has_few_rounds(spark, monkeypatch):
    """A path against its ids, and a ring: as many tables as for a short one."""
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="cut": saved.append(name) or save(self, df, name))
    pairs = [(f"n{i:04d}", f"n{i - 1:04d}") for i in range(1, 3000)] + [(f"r{i:04d}", f"r{(i - 1) % 3000:04d}") for i in range(3000)]
    g = graph(spark, pairs)
    found = dict(map(tuple, traversal.strong_components(g.nodes, g.directed(), Scratch(spark)).collect()))
    assert found == {f"n{i:04d}": f"n{i:04d}" for i in range(3000)} | {f"r{i:04d}": "r0000" for i in range(3000)}
    assert len(saved) < 10


@pytest.mark.parametrize("kind", ["long", "string"])
def test_tasks_of_groups_have_few_nodes_in_common(spark, monkeypatch, kind):
    """A node is sent by the tasks whose range of keys has its groups, not by all; groups are whole, in whatever pieces they are dealt."""
    monkeypatch.setattr(components, "DEALT", 50, raising=False)
    monkeypatch.setattr(components, "LEAST_ZIPPED", 0, raising=False)
    rng = random.Random(8)
    sets = [[f"{c}-{x}" for x in rng.sample(range(30), 4)] for c in range(12) for _ in range(100)]
    cells = [({0: -(1 << 63), len(sets) - 1: (1 << 63) - 1}.get(n, n - 600), x) for n, s in enumerate(sets) for x in s]
    groups = spark.createDataFrame(rng.sample(cells, len(cells)), "grp long, id string").withColumn("grp", F.col("grp").cast(kind))
    found = components.grouped_components(groups, Scratch(spark), 400)[0].toArrow()
    assert len(set(found["component"].to_pylist())) == 12
    if kind == "long":  # twelve tasks; dealt by a hash, each has nearly every node
        assert sum(map(len, found["ids"].to_pylist())) < 2 * 12 * 30
    s = sparse.Sparse.of(found)
    assert {tuple(sorted((s.ids[a], s.ids[b]))) for a, b in zip(s.a, s.b)} == {p for x in sets for p in itertools.combinations(sorted(x), 2)}


@pytest.mark.parametrize("most", [3, 255, 256, 1 << 16, (1 << 31) - 1])
def test_numbers_are_zipped(most):
    rng = np.random.default_rng(1)
    for counts in ([0, 1, 3000, 2, 700], [1, 1, 2], [5], [0]):
        values = rng.integers(0, most, sum(counts), endpoint=True).astype(np.int32)
        found = [components._unzipped(x) for x in components._zipped(values, np.array(counts)).to_pylist()]
        assert [len(x) for x in found] == counts and np.concatenate(found).tolist() == values.tolist()


@pytest.fixture(scope="module")
def one_large():
    """Sets that are one component, with a hub, a chain and far pairs: the sets, pairs and neighbours."""
    rng = random.Random(4)
    sets = [rng.sample([f"p{i}" for i in range(60)], rng.randrange(2, 6)) for _ in range(50)]
    sets += [["p1", f"p{i}"] for i in range(100, 130)] + [[f"p{i}", f"p{i + 1}"] for i in range(120, 150)] + [["p1", f"p{i}"] for i in range(60)]
    pairs = sorted({p for s in sets for p in itertools.combinations(sorted(set(s)), 2)})
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return sets, pairs, near


def _large(spark, monkeypatch, sets):
    """The graph of the sets as a component of too many pairs for one task, in several blocks and dealt to several tasks; no paths may be joined."""
    for what, name, value in ((sparse, "MOST_PAIRS", 20), (blocks, "NEIGHBOURS", 250), (blocks, "STEP", 50), (components, "ROWS", 120)):
        monkeypatch.setattr(what, name, value)
    monkeypatch.setattr(motifs, "triangles_by_joins", None)
    groups = spark.createDataFrame([(n, x) for n, s in enumerate(sets) for x in s], "grp long, id string")
    return Graph(groups.select("id").distinct(), spark.createDataFrame([], "src string, dst string, kind string, seq long"), groups)


@pytest.mark.parametrize("named", [1 << 22, 5])
def test_triangles_of_a_large_component(spark, monkeypatch, one_large, named):
    sets, pairs, near = one_large
    monkeypatch.setattr(blocks, "MOST_NAMES", named)
    g = _large(spark, monkeypatch, sets)
    assert sorted(map(tuple, motifs.triangles(g).collect())) == [(a, b, c) for a, b in pairs for c in sorted(near[a] & near[b]) if c > b]


def test_moments_of_a_large_component(spark, monkeypatch, one_large):
    sets, pairs, near = one_large
    d = [len(x) for x in near.values()]
    want = (*(sum(x**k for x in d) for k in (1, 2, 3)), sum(len(near[a] & near[b]) for a, b in pairs) // 3)
    assert tuple(motifs.moments(_large(spark, monkeypatch, sets)).first()) == want


@pytest.mark.parametrize("least", [None, 7])
def test_curvature_of_a_large_component(spark, monkeypatch, one_large, least):
    sets, pairs, near = one_large
    want = [(a, b, t := len(near[a] & near[b]), 4 - len(near[a]) - len(near[b]) + 3 * t) for a, b in pairs]
    order = lambda r: (r[3], r[0], r[1])
    found = sorted(map(tuple, motifs.curvature(_large(spark, monkeypatch, sets), least).collect()), key=order)
    assert (found == sorted(want, key=order)) if least is None else (found[:least] == sorted(want, key=order)[:least] and len(found) < len(want))


def test_cut_vertices_of_a_large_component(spark, monkeypatch, one_large):
    sets, pairs, _ = one_large
    want = sorted(map(tuple, linalg.articulation_points(graph(spark, pairs), Scratch(spark)).collect()))
    monkeypatch.setattr(linalg, "parts", None)  # a component in one task
    g = _large(spark, monkeypatch, sets)
    assert len(want) > 20 and sorted(map(tuple, linalg.articulation_points(g, Scratch(spark)).collect())) == want
