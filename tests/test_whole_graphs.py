"""Queries over the derived graphs against brute force over all rows of the tables."""

import itertools
from collections import Counter, defaultdict

import pytest

from loomgraph.queries import QUERIES
from loomgraph.sources import derive

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def read(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(*columns).collect()]


@pytest.fixture(scope="module")
def parts(spark):
    """Every part's number, and the neighbours of each part in all orders."""
    orders = defaultdict(set)
    for o, p in read(spark, "lineitem", "l_orderkey", "l_partkey"):
        orders[o].add(p)
    near = {p: set() for (p,) in read(spark, "part", "p_partkey")}
    for a, b in itertools.chain.from_iterable(itertools.permutations(x, 2) for x in orders.values()):
        near[a].add(b)
    return near, orders


def test_part_edges_of_all_orders(spark, parts):
    _, orders = parts
    want = sorted((f"p{a}", f"p{b}", o) for o, x in orders.items() for a, b in itertools.combinations(sorted(x), 2))
    assert sorted(map(tuple, derive.cooccurrence(spark, SMALL).edges.select("src", "dst", "seq").collect())) == want


def test_part_queries_over_all_orders(spark, parts):
    near, _ = parts
    triangles = sum(len(near[a] & near[b]) for a in near for b in near[a]) // 6
    assert QUERIES["triangles"](spark, SMALL).count() == triangles
    kappa = {frozenset((f"p{a}", f"p{b}")): 4 - len(near[a]) - len(near[b]) + 3 * len(near[a] & near[b]) for a in near for b in near[a]}
    assert {frozenset((r.a, r.b)): r.kappa for r in QUERIES["curvature"](spark, SMALL).collect()} == kappa
    part = {}
    for p in near:
        if p not in part:
            todo, group = [p], {p}
            while todo:
                todo = [y for x in todo for y in near[x] if y not in group and not group.add(y)]
            part |= dict.fromkeys(group, min(f"p{x}" for x in group))
    assert dict(rows(QUERIES["weak_components"](spark, SMALL))) == {f"p{p}": c for p, c in part.items()}
    depth, front = {1: 0}, {1}
    for k in range(1, 4):
        front = {y for x in front for y in near[x]} - set(depth)
        depth |= dict.fromkeys(front, k)
    assert dict(rows(QUERIES["khop"](spark, SMALL))) == {f"p{p}": k for p, k in depth.items()}
    assert QUERIES["laplacian_spectrum"](spark, SMALL).first()[:3] == (len(near), len(set(part.values())), float(sum(map(len, near.values()))))


def test_returns_of_all_returned_lines(spark):
    orders = dict(read(spark, "orders", "o_orderkey", "o_custkey"))
    lines = read(spark, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    want = sorted((f"s{s}", f"c{orders[o]}", 10 * o + k) for o, k, s, flag in lines if flag == "R" and o in orders)
    back = derive.trade(spark, SMALL).edges.where("kind = 'returns'")
    assert sorted(map(tuple, back.select("src", "dst", "seq").collect())) == want


def test_contracts_of_all_parts(spark):
    used = {(f"s{s}", f"p{p}", "returns" if flag == "R" else "usesType") for s, p, flag in read(spark, "lineitem", "l_suppkey", "l_partkey", "l_returnflag")}
    brand = {f"p{p}": b for p, b in read(spark, "part", "p_partkey", "p_brand")}
    found = rows(QUERIES["contract_producers"](spark, SMALL).where("kind = 'function'"))
    assert found == sorted(((p, s, "function") for s, p, kind in used if kind == "returns"), key=repr)
    assert rows(QUERIES["contract_consumers"](spark, SMALL).where("role = 'user'")) == sorted(((p, s, "user") for s, p, kind in used if kind == "usesType"), key=repr)
    pattern = sorted((s, p, f"b:{brand[p]}", f"m:{brand[p][:7]}") for s, p, kind in used if kind == "returns")
    assert rows(QUERIES["verify_pattern"](spark, SMALL).select("maker", "impl", "iface", "base")) == pattern


def test_diff_motifs_and_dangling_of_all_edges(spark):
    g = derive.trade(spark, SMALL)
    kind = {i: k for i, k in map(tuple, g.nodes.select("id", "kind").collect())}
    edges = list(map(tuple, g.edges.select("src", "dst", "year").collect()))
    old, new = ([e[:2] for e in edges if e[2] == y] for y in (1995, 1996))
    added = {x for e in new for x in e} - {x for e in old for x in e}
    context = {x for a, b in new for x, y in ((a, b), (b, a)) if y in added} - added
    assert dict(rows(QUERIES["focus_diff"](spark, SMALL))) == dict.fromkeys(added, "added") | dict.fromkeys(context, "context")
    near = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    paths, closed = Counter(), Counter()
    for m in near:
        for a, b in itertools.combinations(sorted(near[m]), 2):
            if b in near[a]:
                closed[",".join(sorted((kind[m], kind[a], kind[b])))] += 1
            else:
                k1, k2 = sorted((kind[a], kind[b]))
                paths[f"{kind[m]}({k1},{k2})"] += 1
    want = [("path", k, n) for k, n in paths.items()] + [("triangle", k, n // 3) for k, n in closed.items()]
    assert rows(QUERIES["motif3"](spark, SMALL)) == sorted(want, key=repr)
    brand = {f"p{p}": b for p, b in read(spark, "part", "p_partkey", "p_brand")}
    parts = derive.cooccurrence(spark, SMALL).edges.select("src", "dst", "kind").collect()
    gone = sorted((tuple(r) for r in parts if "Brand#11" in (brand[r.src], brand[r.dst])), key=repr)
    assert gone and rows(QUERIES["dangling_edges"](spark, SMALL)) == gone
