"""Views of a typed graph for people: packages, structure, a package's surface, neighbourhoods, diffs, diagrams and the model export.

A view is a graph: the nodes that it keeps and the edges among them. A limit is part of a view, as
people read it; it takes the first nodes in the order of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import exported, short_import_path
from loomgraph.graph import Graph
from loomgraph.operators.traversal import containment_ancestors, spread
from loomgraph.plans.scratch import Scratch

# Limits of views, what a structure shows, and edge weights of layouts.
DEFAULT_LIMIT, MOST_LIMIT = 220, 1000
STRUCTURE = ("package", "file", "type", "function", "method", "field")
HEAVY, MIDDLE = ("contains",), ("dependsOn", "implements", "returns", "usesType")
CONTROL = ("loop", "branch", "goroutine", "defer", "channelop", "syncprim")
#: Steps of containment that an owner is looked for in.
MOST_UP = 16


def limit_of(asked: int | None) -> int:
    return min(asked or DEFAULT_LIMIT, MOST_LIMIT)


def kept(g: Graph, ids: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """(nodes, edges with weight, whether some were left out) of the first nodes in ``ids``."""
    most = limit_of(limit)
    first = ids.select("id").distinct().orderBy("id").limit(most)
    own = g.induced(first)
    weight = F.when(F.col("kind").isin(*HEAVY), 3).when(F.col("kind").isin(*MIDDLE), 2).otherwise(1)
    return own.nodes, own.edges.withColumn("weight", weight), F.lit(ids.select("id").distinct().count() > most)


def packages(g: Graph, external: bool = False) -> DataFrame:
    """Ids of packages with a qualified name that doesn't start with a dot; external ones (attribute foreign) only if asked."""
    qname = F.col("qname") if "qname" in g.nodes.columns else F.col("name")
    rows = g.nodes.where((F.col("kind") == "package") & (F.coalesce(qname, F.lit("")) != "") & ~F.coalesce(qname, F.lit("")).startswith("."))
    if not external and "attrs" in g.nodes.columns:
        rows = rows.where(F.coalesce(F.try_element_at("attrs", F.lit("foreign")), F.lit("")) != "true")
    return rows.select("id")


def structure(g: Graph, contracts: DataFrame | None = None) -> DataFrame:
    """Ids of packages, files, types, functions, methods and fields, and of contracts of other kinds."""
    own = g.nodes.where(F.col("kind").isin(*STRUCTURE)).select("id")
    return own if contracts is None else own.unionByName(contracts.select("id")).distinct()


def owners(g: Graph, scratch: Scratch, most: int = MOST_UP) -> DataFrame:
    """(id, package): the nearest package over containment in ``most`` steps; a package owns itself."""
    up = containment_ancestors(g, scratch, most)
    own = g.nodes.where("kind = 'package'").select("id")
    found = up.join(own.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").groupBy("id").agg(F.min(F.struct("depth", "ancestor")).alias("x")).select("id", F.col("x.ancestor").alias("package"))
    return own.select("id", F.col("id").alias("package")).unionByName(found.join(own, "id", "left_anti"))


def nearest_role(g: Graph, scratch: Scratch, most: int = MOST_UP) -> DataFrame:
    """(id, role): the role of the nearest container, or the node's own, that has one."""
    up = containment_ancestors(g, scratch, most).select("id", F.col("ancestor").alias("at"), "depth").unionByName(g.nodes.select("id", F.col("id").alias("at"), F.lit(0).alias("depth")))
    named = g.nodes.where("role <> ''").select(F.col("id").alias("at"), "role")
    return up.join(named, "at").groupBy("id").agg(F.min(F.struct("depth", "at", "role")).alias("x")).select("id", F.col("x.role").alias("role"))


def package_surface(g: Graph, package: str, scratch: Scratch, contracts: DataFrame | None = None) -> DataFrame:
    """Ids of a package's surface: exported symbols, contracts and their methods, with their containers and direct dependencies.

    Symbols are types, functions, methods and fields that the package owns.
    """
    held = owners(g, scratch).where(F.col("package") == package).select("id")
    symbols = g.nodes.join(held, "id", "left_semi").where(F.col("kind").isin("type", "function", "method", "field"))
    surface = symbols.where(exported(F.col("name"))).select("id")
    if contracts is not None:
        own = symbols.select("id").join(contracts.select("id"), "id", "left_semi")
        members = g.edges.where("kind = 'contains'").join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        surface = surface.unionByName(own).unionByName(members.join(g.nodes.where("kind = 'method'").select("id"), "id", "left_semi"))
    surface = scratch.save(surface.distinct(), "surface")
    up = containment_ancestors(g, scratch, MOST_UP).join(surface, "id", "left_semi").select(F.col("ancestor").alias("id"))
    uses = g.edges.where("kind = 'dependsOn'").join(surface.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    return surface.unionByName(up).unionByName(uses).distinct()


def neighbourhood(g: Graph, starts: DataFrame, scratch: Scratch, depth: int = 1, everything: bool = False) -> DataFrame:
    """Ids within 1 to 4 undirected steps, without files and control flow unless ``everything``; containers and the owning package are added."""
    depth = min(max(depth, 1), 4)
    shown = g.nodes if everything else g.nodes.where(~F.col("kind").isin("file", *CONTROL))
    near = g.induced(shown.select("id")).neighbours()
    found = scratch.save(spread(near, starts.join(g.nodes.select("id"), "id", "left_semi"), scratch, depth).select("id"), "near")
    parents = g.edges.where("kind = 'contains'").join(found.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    package = owners(g, scratch).join(found, "id", "left_semi").select(F.col("package").alias("id"))
    return found.unionByName(parents).unionByName(package).distinct()


VIEWS = ("packages", "structure", "package", "neighborhood")


def view(g: Graph, name: str, scratch: Scratch, limit: int | None = None, package: str = "", starts: DataFrame | None = None, depth: int = 1) -> Graph:
    """The nodes and weighted edges of a view by name; an unknown name is an error."""
    if name not in VIEWS:
        raise ValueError(f"unknown view {name!r}; known: {', '.join(VIEWS)}")
    ids = {
        "packages": lambda: packages(g),
        "structure": lambda: structure(g),
        "package": lambda: package_surface(g, package, scratch),
        "neighborhood": lambda: neighbourhood(g, starts, scratch, depth),
    }[name]()
    nodes, edges, _ = kept(g, ids, limit)
    return Graph(nodes, edges)


def short_labels(names: DataFrame, most: int = 8) -> DataFrame:
    """(name, label): the shortest path suffix of 1 to ``most`` segments that no other name has, else the name."""
    tries = names.select("name").distinct().select("name", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n"))
    suffix = F.lit(None).cast("string")
    for n in range(1, most + 1):
        suffix = F.when(F.col("n") == n, short_import_path(F.col("name"), n)).otherwise(suffix)
    tries = tries.withColumn("label", suffix)
    alone = tries.groupBy("n", "label").agg(F.countDistinct("name").alias("k"), F.min("name").alias("name")).where("k = 1")
    best = alone.groupBy("name").agg(F.min(F.struct("n", "label")).alias("b"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce(F.col("b.label"), F.col("name")).alias("label"))


def package_edges(g: Graph, ids: DataFrame) -> DataFrame:
    """Distinct (src, dst, kind) of the packages' own dependsOn edges among ``ids``: symbols' edges aren't rolled up."""
    own = g.nodes.where("kind = 'package'").select("id").join(ids, "id", "left_semi")
    return g.induced(own).edges.where("kind = 'dependsOn' and src <> dst").select("src", "dst", "kind").distinct()


# --- diffs ------------------------------------------------------------------------------------


def merged_status(statuses: Column) -> Column:
    """The status that a group of them folds to: one that all share, else changed."""
    kinds = F.array_distinct(statuses)
    return F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("changed")


def diff_packages(changes: DataFrame, held: DataFrame) -> DataFrame:
    """(package, status, items): packages that node changes (id, change) touch, by their owners (id, package).

    A package that is itself added or removed is so, whatever its symbols; else its status is that
    of its symbols if they agree.
    """
    rows = changes.join(held, "id")
    own = rows.where("id = package and change in ('added', 'removed')").select("package", F.col("change").alias("own"))
    folded = rows.groupBy("package").agg(merged_status(F.collect_set("change")).alias("status"), F.count("*").alias("items"))
    symbols = F.when(F.col("status").isin("added", "removed"), "changed").otherwise(F.col("status"))
    return folded.join(own, "package", "left").select("package", F.coalesce("own", symbols).alias("status"), "items")


def overlay(view_nodes: DataFrame, changes: DataFrame, before: DataFrame) -> DataFrame:
    """(id, mark): a view's nodes with added or changed, and the removed nodes of the base view ``before``."""
    marked = view_nodes.select("id").join(changes.where("change <> 'removed'"), "id", "left").select("id", F.coalesce("change", F.lit("")).alias("mark"))
    gone = before.select("id").join(changes.where("change = 'removed'").select("id"), "id", "left_semi").join(view_nodes.select("id"), "id", "left_anti")
    return marked.unionByName(gone.select("id", F.lit("removed").alias("mark")))


# --- diagrams and the model -------------------------------------------------------------------


def clusters(g: Graph, scratch: Scratch) -> DataFrame:
    """(id, label, cluster) of all nodes, clustered by owning package; packages stand outside."""
    held = owners(g, scratch).where("id <> package")
    return g.nodes.select("id", F.col("name").alias("label")).join(held, "id", "left").select("id", "label", F.coalesce("package", F.lit("")).alias("cluster"))


def diagram(g: Graph, kind: str, scratch: Scratch, foreign: bool = False, starts: DataFrame | None = None) -> Graph:
    """The graph of a diagram: package_deps, contract_port (interfaces and what implements them) or call_flow (from ``starts``)."""
    if kind == "package_deps":
        ids = packages(g, foreign)
        return Graph(g.nodes.join(ids, "id", "left_semi"), package_edges(g, ids))
    if kind == "contract_port":
        e = g.edges.where("kind = 'implements'").select("src", "dst", "kind").distinct()
    elif kind == "call_flow":
        calls = g.edges.where("kind in ('calls', 'callsFrom')")
        found = spread(calls.select(F.col("src").alias("id"), F.col("dst").alias("other")), starts, scratch, 3).select("id")
        e = Graph(g.nodes, calls).induced(found).edges.select("src", "dst", "kind").distinct()
    else:
        raise ValueError(f"unknown diagram {kind!r}")
    return Graph(g.nodes.join(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi"), e)


def resolve_seed(nodes: DataFrame, seed: str) -> DataFrame:
    """The id that a seed names: itself, else the node of smallest qualified name that is the seed or ends in it after a dot or slash."""
    exact = F.col("id") == seed
    named = (F.col("qname") == seed) | F.col("qname").endswith("." + seed) | F.col("qname").endswith("/" + seed)
    rows = nodes.where(exact | named).select(F.when(exact, 0).otherwise(1).alias("p"), "qname", "id")
    return rows.agg(F.min(F.struct("p", "qname", "id")).alias("x")).where("x is not null").select("x.id")


def model(g: Graph, scratch: Scratch) -> DataFrame:
    """(part, id, kind, name, owner): the architecture's packages, symbols and dependencies between them.

    A symbol's owner is a package that contains it directly, nothing deeper.
    """
    symbols = g.nodes.where(F.col("kind").isin("type", "function", "method", "field"))
    own = g.nodes.where("kind = 'package'").select("id")
    direct = g.edges.where("kind = 'contains'").join(own.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("owner"))
    a = g.nodes.where("kind = 'package'").select(F.lit("package").alias("part"), "id", "kind", "name", F.lit("").alias("owner"))
    b = symbols.join(direct, "id", "left").select(F.lit("symbol").alias("part"), "id", "kind", "name", F.coalesce("owner", F.lit("")).alias("owner"))
    inside = g.induced(own.unionByName(symbols.select("id"))).edges.where("kind <> 'contains'").select("src", "dst", "kind").distinct()
    c = inside.select(F.lit("dependency").alias("part"), F.concat_ws("->", "src", "dst").alias("id"), "kind", F.lit("").alias("name"), F.lit("").alias("owner"))
    return a.unionByName(b).unionByName(c)


def stereotypes(g: Graph, contracts: DataFrame) -> DataFrame:
    """The distinct roles of nodes, and ``contract`` where there is one."""
    any_ = contracts.limit(1).select(F.lit("contract").alias("stereotype"))
    return g.nodes.where("role <> ''").select(F.col("role").alias("stereotype")).unionByName(any_).distinct()


def package_projection(g: Graph, scratch: Scratch, module: str, most: tuple[int, int, int] = (30, 40, 40)) -> DataFrame:
    """(id, path, grp, text) of packages: the path below the module, its first segment (two below internal), and exported symbols as text.

    The text holds the first 30 types, 40 functions and 40 methods in the order of names.
    """
    path = F.regexp_replace(F.coalesce(F.nullif(F.col("qname"), F.lit("")), F.col("id")), f"^{module}/?", "")
    part = F.split(path, "/")
    group = F.when(F.element_at(part, 1) == "internal", F.array_join(F.slice(part, 1, 2), "/")).otherwise(F.element_at(part, 1))
    own = g.nodes.where("kind = 'package'").select("id", path.alias("path"), group.alias("grp"))
    held = owners(g, scratch).where("id <> package")
    named = g.nodes.where(F.col("kind").isin("type", "function", "method") & exported(F.col("name"))).select("id", "kind", "name").join(held, "id")
    lists = named.groupBy("package").agg(*(F.slice(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))), 1, n).alias(k) for k, n in zip(("type", "function", "method"), most)))
    text = lists.select(F.col("package").alias("id"), F.array_join(F.concat("type", "function", "method"), " ").alias("text"))
    return own.join(text, "id", "left").select("id", "path", "grp", F.coalesce("text", F.lit("")).alias("text"))


def region_files(g: Graph, region: DataFrame) -> DataFrame:
    """(file, lines): the distinct lines of the region's nodes (column id) by file, sorted."""
    rows = g.nodes.join(region, "id", "left_semi").where("file <> ''")
    return rows.groupBy("file").agg(F.array_sort(F.collect_set("line")).alias("lines"))
