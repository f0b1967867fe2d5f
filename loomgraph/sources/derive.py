"""Graphs derived from the star-schema tables; the SQL of each is in ``loomgraph.plans.oracle_graphs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column))


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (functions) and suppliers (types); group: nation, role: region."""
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select("n_nationkey", F.col("n_name").alias("grp"), F.col("r_name").alias("role"))
    customer = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    a = customer.select(_named("c", "c_custkey").alias("id"), F.lit("function").alias("kind"), F.col("c_name").alias("name"), "grp", "role")
    b = supplier.select(_named("s", "s_suppkey").alias("id"), F.lit("type").alias("kind"), F.col("s_name").alias("name"), "grp", "role")
    return a.unionByName(b)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """A call from customer to supplier for each line, and a return the other way for each returned line: a bag of edges."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    calls = rows.select(_named("c", "o_custkey").alias("src"), _named("s", "l_suppkey").alias("dst"), F.lit("calls").alias("kind"), seq, "year")
    back = rows.where("l_returnflag = 'R'")
    back = back.select(_named("s", "l_suppkey").alias("src"), _named("c", "o_custkey").alias("dst"), F.lit("returns").alias("kind"), seq, "year")
    return Graph(parties(spark, sf_dir), calls.unionByName(back))


def nations(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations by region; one depends on another where it buys more there than the mean pair and one deviation.

    All lines count towards a pair's number; the bound is what makes a dependency of it.
    """
    g = trade(spark, sf_dir)
    side = g.nodes.select("id", "grp")
    pairs = (
        g.edges.where("kind = 'calls'")
        .join(side.select(F.col("id").alias("src"), F.col("grp").alias("a")), "src")
        .join(side.select(F.col("id").alias("dst"), F.col("grp").alias("b")), "dst")
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
    )
    every = Window.partitionBy()  # one row for each pair of nations
    pairs = pairs.withColumn("bound", F.avg("n").over(every) + F.stddev_pop("n").over(every)).where("n > bound")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = place.select(F.col("n_name").alias("id"), F.lit("package").alias("kind"), F.col("n_name").alias("name"), F.col("r_name").alias("grp"), F.col("r_name").alias("role"))
    return Graph(nodes, pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("dependsOn").alias("kind"), rank.cast("long").alias("seq"), "n"))


def containment(spark: SparkSession, sf_dir: str) -> Graph:
    """region contains nation contains customers and suppliers."""
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.lit("package").alias("kind"), F.col("r_name").alias("name"), F.lit("").alias("grp"), F.lit("").alias("role"))
    nation = place.select(_named("n:", "n_name").alias("id"), F.lit("file").alias("kind"), F.col("n_name").alias("name"), F.col("r_name").alias("grp"), F.lit("").alias("role"))
    people = parties(spark, sf_dir)
    up = place.select(F.col("r_name").alias("src"), _named("n:", "n_name").alias("dst"))
    down = people.select(_named("n:", "grp").alias("src"), F.col("id").alias("dst"))
    edges = up.unionByName(down).withColumn("kind", F.lit("contains")).withColumn("seq", F.lit(0).cast("long"))
    return Graph(region.unionByName(nation).unionByName(people), edges)


def cooccurrence(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts of one order: a reference from the smaller to the larger part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = lines.select("l_orderkey", F.col("l_partkey").alias("other"))
    pairs = lines.join(other, "l_orderkey").where("l_partkey < other")
    edges = pairs.select(_named("p", "l_partkey").alias("src"), _named("p", "other").alias("dst"), F.lit("references").alias("kind"), F.col("l_orderkey").alias("seq"))
    part = table(spark, sf_dir, "part")
    nodes = part.select(_named("p", "p_partkey").alias("id"), F.lit("type").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("grp"), F.col("p_type").alias("role"))
    return Graph(nodes, edges, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), _named("p", "l_partkey").alias("id")))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a user: user, src, dst, seq, ts."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst"))
    return events.where("dst is not null").select("user_id", "src", "dst", F.col("event_id").alias("seq"), "ts")


def contracts(spark: SparkSession, sf_dir: str) -> Graph:
    """Interfaces (makers, brands), types (parts) and functions (suppliers): embeds, implements, returns, usesType."""
    part = table(spark, sf_dir, "part")
    brand = part.select("p_brand").distinct()
    maker = brand.select(F.substring("p_brand", 1, 7).alias("m")).distinct()
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    a = maker.select(_named("m:", "m").alias("id"), F.lit("interface").alias("kind"), F.col("m").alias("name"), F.col("m").alias("grp"), F.lit("").alias("role"))
    b = brand.select(_named("b:", "p_brand").alias("id"), F.lit("interface").alias("kind"), F.col("p_brand").alias("name"), F.substring("p_brand", 1, 7).alias("grp"), F.lit("").alias("role"))
    c = part.select(_named("p", "p_partkey").alias("id"), F.lit("type").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("grp"), F.col("p_type").alias("role"))
    s = table(spark, sf_dir, "supplier").select(_named("s", "s_suppkey").alias("id"), F.lit("function").alias("kind"), F.col("s_name").alias("name"), F.lit("").alias("grp"), F.lit("").alias("role"))
    embeds = brand.select(_named("b:", "p_brand").alias("src"), F.concat(F.lit("m:"), F.substring("p_brand", 1, 7)).alias("dst"), F.lit("embeds").alias("kind"))
    implements = part.select(_named("p", "p_partkey").alias("src"), _named("b:", "p_brand").alias("dst"), F.lit("implements").alias("kind"))
    kind = F.when(F.col("l_returnflag") == "R", "returns").otherwise("usesType")
    used = lines.select(_named("s", "l_suppkey").alias("src"), _named("p", "l_partkey").alias("dst"), kind.alias("kind")).distinct()
    edges = embeds.unionByName(implements).unionByName(used).withColumn("seq", F.lit(0).cast("long"))
    return Graph(a.unionByName(b).unionByName(c).unionByName(s), edges)


def services(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions and nations as types, suppliers as methods (even keys) and functions: implements, contains, returns, usesType, calls.

    A nation implements its region and contains its methods; functions return their nation, methods
    use their region, and each supplier calls the next one of its nation.
    """
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    own = table(spark, sf_dir, "supplier").withColumn("next", F.lead("s_suppkey").over(order)).join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    own = own.withColumn("kind", F.when(F.col("s_suppkey") % 2 == 0, "method").otherwise("function"))
    s, n, r = _named("s", "s_suppkey"), _named("n:", "n_name"), _named("r:", "r_name")
    node = lambda df, id_, kind, name, grp: df.select(id_.alias("id"), kind.alias("kind"), F.col(name).alias("name"), grp.alias("grp"), F.lit("").alias("role"))
    region = table(spark, sf_dir, "region")
    nodes = node(region, r, F.lit("type"), "r_name", F.lit("")).unionByName(node(place, n, F.lit("type"), "n_name", F.col("r_name"))).unionByName(node(own, s, F.col("kind"), "s_name", F.col("n_name")))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("seq"))
    methods, functions = own.where("kind = 'method'"), own.where("kind = 'function'")
    edges = edge(place, n, r, "implements").unionByName(edge(methods, n, s, "contains")).unionByName(edge(functions, s, n, "returns"))
    edges = edges.unionByName(edge(methods, s, r, "usesType")).unionByName(edge(own.where("next is not null"), s, _named("s", "next"), "calls"))
    return Graph(nodes, edges)
