"""Statistics, ranking and detectors: medians, modified z-scores, outliers, rankings, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.graph import HIERARCHY_KINDS, Graph
from loomgraph.operators.degrees import bag_degrees, degree


def modified_z(values: DataFrame, column: str = "value") -> DataFrame:
    """``values`` with median, mad and z = 0.6745 (x - median) / MAD; z is null for MAD 0 or fewer than 2 rows.

    Two aggregations to one row each, joined back by broadcast of that row.
    """
    middle = values.agg(F.median(column).alias("median"), F.count(column).alias("_n"))
    spread = values.crossJoin(F.broadcast(middle)).agg(F.median(F.abs(F.col(column) - F.col("median"))).alias("mad"))
    out = values.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(spread))
    z = F.when((F.col("_n") >= 2) & (F.col("mad") > 0), 0.6745 * (F.col(column) - F.col("median")) / F.col("mad"))
    return out.withColumn("z", z).drop("_n")


def god_nodes(g: Graph, sigmas: float = 2.0) -> DataFrame:
    """Nodes whose fan-in or fan-out is above mean + 2 sigma over all nodes; self loops don't count."""
    d = bag_degrees(g, self_loops=False)
    bound = d.agg((F.avg("ca") + sigmas * F.stddev_pop("ca")).alias("in_bound"), (F.avg("ce") + sigmas * F.stddev_pop("ce")).alias("out_bound"))
    return d.crossJoin(F.broadcast(bound)).where("ca > in_bound or ce > out_bound").select("id", F.col("ca").alias("fan_in"), F.col("ce").alias("fan_out"))


def severity(score: Column, *steps: tuple[float, str], otherwise: str = "low") -> Column:
    """The first step (bound, name) that the score reaches."""
    out = F.lit(otherwise)
    for bound, name in reversed(steps):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def rank_anomalies(anomalies: DataFrame) -> DataFrame:
    """(metric, id, score) ranked by score down, then metric and id.

    Ranking is a range-partitioned sort; ``rank`` counts from 1 in that order.
    """
    order = Window.orderBy(F.desc("score"), "metric", "id")
    return anomalies.withColumn("rank", F.row_number().over(order).cast("long"))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows: a heap for each partition, no global sort."""
    return rows.orderBy(*order).limit(n)


def even_chunks(rows: DataFrame, groups: int, order: str = "id") -> DataFrame:
    """Sorted rows dealt evenly; the first groups get the remainder."""
    return rows.withColumn("chunk", F.ntile(groups).over(Window.orderBy(order)).cast("long"))


def budgeted(rows: DataFrame, cost: Column, budget: float, *order: str, cap: int) -> DataFrame:
    """The prefix, in the given order, of at most ``cap`` rows whose running cost stays within ``budget``."""
    w = Window.orderBy(*order)
    out = rows.withColumn("place", F.row_number().over(w).cast("long")).withColumn("spent", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("place") <= cap) & (F.col("spent") <= budget))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """How many groups there are of each size."""
    return rows.groupBy(column).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def orphans(g: Graph) -> DataFrame:
    """Nodes without an edge, by kind: kind, orphans, severity."""
    alone = degree(g).where("degree = 0").join(g.nodes.select("id", "kind"), "id")
    counts = alone.groupBy("kind").agg(F.count("*").alias("orphans"))
    return counts.withColumn("severity", severity(F.col("orphans"), (25, "high"), (10, "medium"), (3, "low"), otherwise="info"))


def canonical_title(title: Column) -> Column:
    """Lower-cased letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def duplicate_titles(rows: DataFrame, title: str, least: int = 2) -> DataFrame:
    """Canonical titles that ``least`` rows or more share: title, n, first_id."""
    keyed = rows.select(F.col("id"), canonical_title(F.col(title)).alias("title")).where("title <> ''")
    found = keyed.groupBy("title").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= least)
    return found.withColumn("severity", severity(F.col("n"), (10, "high"), (5, "medium"), (3, "low"), otherwise="info"))


def structural_parent(g: Graph) -> DataFrame:
    """The smallest hierarchical parent of each node that has one."""
    up = g.edges.where(F.col("kind").isin(*HIERARCHY_KINDS) & (F.col("src") != F.col("dst")))
    return up.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))


def flat_stars(g: Graph, most: int = 12, leaf_share: float = 0.7) -> DataFrame:
    """Hubs with more than ``most`` children of which ``leaf_share`` are leaves, and how to split them."""
    up = g.edges.where(F.col("kind").isin(*HIERARCHY_KINDS) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    parents = up.select(F.col("src").alias("dst"), F.lit(1).alias("_p")).distinct()
    rows = up.join(parents, "dst", "left").groupBy("src").agg(F.count("*").alias("children"), F.sum(F.when(F.col("_p").isNull(), 1).otherwise(0)).alias("leaves"))
    ratio = F.col("leaves") / F.col("children")
    groups = F.ceil(F.col("leaves") / most)
    hubs = rows.where((F.col("children") > most) & (ratio >= leaf_share))
    return hubs.select(
        F.col("src").alias("id"), "children", "leaves", groups.cast("long").alias("groups"), ((F.col("children") - F.col("leaves") + groups) <= most).alias("feasible"), (F.col("children") / most * ratio).alias("score")
    )


def sweep_cut(g: Graph, weights: DataFrame) -> DataFrame:
    """Conductance of every prefix of ``weights`` (id, weight), heaviest first: place, id, cut, volume, conductance.

    An edge changes the cut when its ends enter: +1 at the first, -1 at the second. So the running
    cut and volume are sums over one row for each edge end, whatever the prefix.
    """
    order = Window.orderBy(F.desc("weight"), "id")
    ranked = weights.select("id", F.row_number().over(order).cast("long").alias("place"))
    pairs = g.undirected()
    ends = pairs.join(ranked.select(F.col("id").alias("a"), F.col("place").alias("pa")), "a", "left").join(ranked.select(F.col("id").alias("b"), F.col("place").alias("pb")), "b", "left")
    far = F.lit(2**62)
    ends = ends.select(F.least(F.coalesce("pa", far), F.coalesce("pb", far)).alias("enter"), F.greatest(F.coalesce("pa", far), F.coalesce("pb", far)).alias("leave"))
    delta = ends.select(F.col("enter").alias("place"), F.lit(1).alias("d")).unionByName(ends.select(F.col("leave").alias("place"), F.lit(-1).alias("d"))).groupBy("place").agg(F.sum("d").alias("d"))
    volume = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
    total = volume.agg(F.sum("deg").alias("total"))
    run = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.join(delta, "place", "left").join(volume, "id", "left").select("id", "place", F.sum(F.coalesce("d", F.lit(0))).over(run).alias("cut"), F.sum(F.coalesce("deg", F.lit(0))).over(run).alias("volume"))
    rows = rows.crossJoin(F.broadcast(total))
    room = F.least(F.col("volume"), F.col("total") - F.col("volume"))
    return rows.where(room > 0).select("place", "id", "cut", "volume", (F.col("cut") / room).alias("conductance"))


def parent_mismatch(members: DataFrame) -> DataFrame:
    """Members (id, community, parent) whose parent isn't their community's most common one: community, outliers, size, ratio, severity."""
    from loomgraph.operators.degrees import majority_parent

    best = majority_parent(members).select("community", F.col("parent").alias("usual"), "size")
    rows = members.join(best, "community").where("parent <> usual").groupBy("community", "usual", "size").agg(F.count("*").alias("outliers"))
    ratio = F.col("outliers") / F.col("size")
    return rows.select("community", "usual", "outliers", "size", ratio.alias("ratio"), severity(ratio, (0.5, "high"), (0.25, "medium")).alias("severity"))
