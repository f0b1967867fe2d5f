"""Motifs with edge kinds, proposals on them, skeletons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import permutations
from loomgraph.operators import patterns
from loomgraph.operators.patterns import MOTIF_EDGES, MOTIF_NODES, Role, Skeleton
from loomgraph.plans import oracle_graphs as sql
from loomgraph.plans.scratch import Scratch
from loomgraph.registry import query, with_
from loomgraph.sources import derive

SERVICES = sql.SERVICES


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _instances_sql(size: int) -> list[str]:
    """Common table expressions up to f (members, canonical)."""
    cells = ", ".join(f"('{''.join(map(str, p))}', {i}, {x})" for p in permutations(size) for i, x in enumerate(p))
    out = [
        SERVICES,
        f"mn AS (SELECT id, kind FROM nodes WHERE kind IN {_in(MOTIF_NODES)})",
        f"me AS (SELECT DISTINCT src, dst, kind FROM edges WHERE kind IN {_in(MOTIF_EDGES)} AND src <> dst AND src IN (SELECT id FROM mn) AND dst IN (SELECT id FROM mn))",
        "nb AS (SELECT src AS id, dst AS other FROM me UNION SELECT dst, src FROM me)",
        "g2 AS (SELECT [id, other] AS m FROM nb WHERE id < other)",
    ]
    for k in range(3, size + 1):
        out.append(f"g{k} AS (SELECT DISTINCT list_sort(list_append(m, other)) AS m FROM (SELECT m, unnest(m) AS id FROM g{k - 1}) x JOIN nb USING (id) WHERE NOT list_contains(m, other))")
    out += [
        "et AS (SELECT id, id AS t FROM nodes WHERE kind = 'type' UNION ALL SELECT e.dst, min(e.src) FROM edges e JOIN nodes p ON e.src = p.id AND p.kind = 'type' JOIN nodes c ON e.dst = c.id AND c.kind <> 'type' WHERE e.kind = 'contains' GROUP BY e.dst)",
        f"el AS (SELECT m FROM (SELECT m, unnest(m) AS id FROM g{size}) x LEFT JOIN et USING (id) GROUP BY m HAVING count(*) FILTER (t IS NULL) > 0 OR count(DISTINCT t) > 1)",
        f"pm(p, i, x) AS (VALUES {cells})",
        f"nk AS (SELECT m, p, string_agg(kind, ',' ORDER BY x) AS ks FROM (SELECT m, unnest(m) AS id, unnest(range({size})) AS i FROM el) c JOIN mn USING (id) JOIN pm USING (i) GROUP BY m, p)",
        "ee AS (SELECT el.m, list_position(m, src) - 1 AS a, list_position(m, dst) - 1 AS b, me.kind FROM el, me WHERE list_contains(m, src) AND list_contains(m, dst))" if size == 3 else
        f"ee AS (SELECT c.m, c.i AS a, list_position(c.m, dst) - 1 AS b, me.kind FROM (SELECT m, unnest(m) AS id, unnest(range({size})) AS i FROM el) c JOIN me ON c.id = src WHERE list_contains(c.m, dst))",
        "ek AS (SELECT ee.m, q.p, string_agg(concat(q.x, '-', ee.kind, '->', r.x, '|'), '' ORDER BY q.x, r.x, ee.kind) AS es FROM ee JOIN pm q ON ee.a = q.i JOIN pm r ON ee.b = r.i AND q.p = r.p GROUP BY ee.m, q.p)",
        f"f AS (SELECT m, min(concat('k={size};nodes=', ks, ';edges=', es)) AS canonical FROM nk JOIN ek USING (m, p) GROUP BY m)",
    ]
    return out


def _groups_sql(size: int) -> str:
    return with_(*_instances_sql(size)) + f"SELECT canonical, {size} AS size, count(*)::BIGINT AS instances FROM f GROUP BY canonical HAVING count(*) >= 2"


@query("motif_groups_3", _groups_sql(3))
def _(spark, d):
    return patterns.motif_groups(patterns.Threes(derive.services(spark, d), Scratch(spark)).counts(), counted=True)


@query("motif_groups_4", _groups_sql(4))
def _(spark, d):
    return patterns.motif_groups(patterns.instances(derive.services(spark, d), 4, Scratch(spark)))


@query("motif_instances", with_(*_instances_sql(3)) + "SELECT array_to_string(m, ',') AS members, canonical FROM f")
def _(spark, d):
    return patterns.instances(derive.services(spark, d), 3, Scratch(spark)).select(F.array_join("members", ",").alias("members"), "canonical")


@query("enclosing_types", with_(SERVICES) + "SELECT id, id AS type FROM nodes WHERE kind = 'type' UNION ALL SELECT dst, min(src) FROM edges WHERE kind = 'contains' GROUP BY dst")
def _(spark, d):
    return patterns.enclosing_types(derive.services(spark, d))


FINGERPRINTS = "fp AS (SELECT n.id, concat('in:', count(*) FILTER (e.dst = n.id), ',out:', count(*) FILTER (e.src = n.id)) AS fingerprint FROM nodes n LEFT JOIN edges e ON e.kind <> 'contains' AND (e.src = n.id OR e.dst = n.id) WHERE n.kind = 'method' GROUP BY n.id)"


@query("method_fingerprints", with_(SERVICES, FINGERPRINTS) + "SELECT id, fingerprint FROM fp")
def _(spark, d):
    return patterns.method_fingerprints(derive.services(spark, d))


ROLES = [
    "im AS (SELECT m, canonical, (SELECT min(id) FROM mn WHERE mn.kind = 'method' AND list_contains(m, id)) AS method FROM f)",
    "ip AS (SELECT im.*, (SELECT min(src) FROM edges e WHERE e.kind = 'contains' AND e.dst = im.method AND list_contains(im.m, e.src)) AS impl FROM im)",
    "ir AS (SELECT ip.*, (SELECT arg_min(dst, (list_contains(ip.m, dst), dst)) FROM edges e WHERE e.kind = 'implements' AND e.src = ip.impl) AS iface FROM ip)",
]


@query("motif_roles", with_(*_instances_sql(3), *ROLES) + "SELECT array_to_string(m, ',') AS members, method, impl, iface FROM ir")
def _(spark, d):
    g = derive.services(spark, d)
    found = patterns.assign_roles(patterns.instances(g, 3, Scratch(spark)), g)
    return found.select(F.array_join("members", ",").alias("members"), "method", "impl", "iface")


TYPE_SHAPES = [
    "tc AS (SELECT f.canonical, f.m, e.src AS impl, e.dst AS iface FROM f JOIN edges e ON e.kind = 'implements' AND list_contains(f.m, e.src) AND list_contains(f.m, e.dst))",
    "ts AS (SELECT canonical, iface, count(DISTINCT m) AS instances, count(DISTINCT impl) AS impls FROM tc GROUP BY 1, 2)",
    "tb AS (SELECT canonical, arg_min(iface, (-instances, -impls, iface)) AS iface FROM ts GROUP BY canonical)",
    "tt AS (SELECT ts.* FROM ts JOIN tb USING (canonical, iface))",
]


@query("type_shapes", with_(*_instances_sql(3), *TYPE_SHAPES) + "SELECT canonical, iface, instances::BIGINT AS instances, impls::BIGINT AS impls FROM tt")
def _(spark, d):
    return patterns.Threes(derive.services(spark, d), Scratch(spark)).type_shapes()


@query(
    "extract_interface",
    with_(*_instances_sql(3), FINGERPRINTS, *ROLES, *TYPE_SHAPES)
    + """, per AS (SELECT canonical, count(*) AS instances, count(*) FILTER (method IS NOT NULL AND impl IS NOT NULL) AS whole, count(DISTINCT fingerprint) AS prints, count(DISTINCT impl) AS impls, min(iface) AS iface FROM ir LEFT JOIN fp ON ir.method = fp.id GROUP BY canonical HAVING count(*) >= 3)
SELECT canonical, 'method' AS shape, iface, instances::BIGINT AS instances, impls::BIGINT AS impls FROM per WHERE whole = instances AND prints = 1 AND iface IS NOT NULL
UNION ALL SELECT tt.canonical, 'type', tt.iface, tt.instances::BIGINT, tt.impls::BIGINT FROM tt JOIN per USING (canonical) WHERE NOT (whole = per.instances AND prints = 1 AND per.iface IS NOT NULL) AND tt.instances >= 3""",
)
def _(spark, d):
    return patterns.Threes(derive.services(spark, d), Scratch(spark)).extract_interface()


GOOD = Skeleton((Role("m", "method"), Role("impl", "type"), Role("iface", "type")), (("impl", "m", "contains"), ("impl", "iface", "implements"), ("m", "iface", "usesType")))
BAD = Skeleton((Role("f", "function", returns="type"), Role("impl", "type"), Role("iface", "type")), (("f", "impl", "returns"), ("impl", "iface", "implements"), ("impl", "f", "contains")))
ABSENT = Skeleton((Role("f", "function"), Role("lock", "syncprim"), Role("shaped", "method", params=("field",))), (("f", "lock", "calls"),))


@query(
    "verify_skeletons",
    with_(SERVICES)
    + """, ok AS (SELECT count(*) AS n FROM edges c JOIN edges i ON c.src = i.src JOIN edges u ON u.src = c.dst AND u.dst = i.dst WHERE c.kind = 'contains' AND i.kind = 'implements' AND u.kind = 'usesType')
SELECT 'good' AS skeleton, 'match' AS status, '' AS item, n::VARCHAR AS detail FROM ok UNION ALL SELECT 'bad', 'failing_edge', 'impl->f', 'contains'
UNION ALL SELECT 'absent', 'missing_role', 'lock', 'no candidate matching kind=syncprim' UNION ALL SELECT 'absent', 'missing_role', 'shaped', 'no candidate matching kind=method'""",
)
def _(spark, d):
    s = Scratch(spark)
    g = derive.services(spark, d)
    g = patterns.Graph(s.save(g.nodes, "nodes"), s.save(g.edges, "edges"))
    told = [patterns.verify(g, k).withColumn("skeleton", F.lit(n)) for n, k in (("good", GOOD), ("bad", BAD), ("absent", ABSENT))]
    return reduce(DataFrame.unionByName, told)


@query("skeleton_candidates", with_(SERVICES) + "SELECT 'returning' AS role, id FROM nodes WHERE kind = 'function' AND id IN (SELECT src FROM edges WHERE kind = 'returns') UNION ALL SELECT 'method', id FROM nodes WHERE kind = 'method'")
def _(spark, d):
    g = derive.services(spark, d)
    a = patterns.candidates(g, Role("f", "function", returns="type")).select(F.lit("returning").alias("role"), "id")
    return a.unionByName(patterns.candidates(g, Role("m", "method")).select(F.lit("method").alias("role"), "id"))
