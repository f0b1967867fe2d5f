"""Relational categories: theta, range and as-of joins, grains, pivots, estimates, functions of the user, formats, transactions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators import relational as R
from loomgraph.plans.scratch import Scratch
from loomgraph.registry import query
from loomgraph.sources.derive import table

PRICE_BANDS = [(0.0, 1000.0, "low"), (1000.0, 1500.0, "middle"), (1500.0, 1e6, "high"), (900.0, 1100.0, "around a thousand")]
REGIONS = [f"REGION_{i}" for i in range(5)]


@query(
    "theta_implements",
    """WITH need AS (SELECT DISTINCT p_brand AS iface, p_size % 10 AS method FROM part WHERE p_size <= 10), have AS (SELECT DISTINCT l_suppkey AS type, p_size % 10 AS method FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10)
SELECT iface, 's' || type AS type FROM (SELECT DISTINCT iface FROM need) i, (SELECT DISTINCT type FROM have) t
WHERE NOT EXISTS (SELECT 1 FROM need n WHERE n.iface = i.iface AND NOT EXISTS (SELECT 1 FROM have h WHERE h.type = t.type AND h.method = n.method))""",
)
def _(spark, d):
    part = table(spark, d, "part").where("p_size <= 10").select("p_partkey", "p_brand", (F.col("p_size") % 10).alias("method"))
    have = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return R.implementers(have.select(F.concat(F.lit("s"), "l_suppkey").alias("type"), "method"), part.select(F.col("p_brand").alias("iface"), "method"))


@query(
    "asof_join",
    """SELECT e.event_id, e.user_id, e.ts, b.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON e.user_id = b.user_id AND e.ts >= b.ts""",
)
def _(spark, d):
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("last_purchase"))
    return R.asof(events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "last_purchase").select("event_id", "user_id", "ts", "last_purchase")


@query("range_join", f"SELECT b.name AS band, count(*)::BIGINT AS parts, round(sum(p_retailprice), 2) AS total FROM part JOIN (VALUES {', '.join(str(x) for x in PRICE_BANDS)}) b(low, high, name) ON p_retailprice >= low AND p_retailprice < high GROUP BY 1")
def _(spark, d):
    bands = spark.createDataFrame([(a, min(b, 100_000.0), n) for a, b, n in PRICE_BANDS], "low double, high double, band string")
    return R.in_bands(table(spark, d, "part").select("p_retailprice"), "p_retailprice", bands, 500.0).groupBy("band").agg(F.count("*").alias("parts"), F.round(F.sum("p_retailprice"), 2).alias("total"))


PLACED = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _customers(spark, d):
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))


@query("rollup_grains", f"SELECT r_name, n_name, grouping(r_name, n_name)::BIGINT AS grain, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance {PLACED} GROUP BY ROLLUP (r_name, n_name)")
def _(spark, d):
    return R.grains(_customers(spark, d), ["r_name", "n_name"], F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("cube_grains", f"SELECT r_name, c_mktsegment, grouping(r_name, c_mktsegment)::BIGINT AS grain, count(*)::BIGINT AS customers {PLACED} GROUP BY CUBE (r_name, c_mktsegment)")
def _(spark, d):
    return R.grains(_customers(spark, d), ["r_name", "c_mktsegment"], F.count("*").alias("customers"), cube=True)


@query("grouping_sets", f"SELECT n_name, c_mktsegment, count(*)::BIGINT AS customers {PLACED} GROUP BY GROUPING SETS ((n_name), (c_mktsegment), ())")
def _(spark, d):
    rows = _customers(spark, d)
    return rows.groupingSets([["n_name"], ["c_mktsegment"], []], "n_name", "c_mktsegment").agg(F.count("*").alias("customers"))


@query("pivot_matrix", "SELECT o_orderstatus AS status, count(*) FILTER (year(o_orderdate) = 1995)::BIGINT AS y1995, count(*) FILTER (year(o_orderdate) = 1996)::BIGINT AS y1996, count(*) FILTER (year(o_orderdate) = 1997)::BIGINT AS y1997 FROM orders GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("year"))
    return R.matrix(rows, "status", "year", ["y1995", "y1996", "y1997"], F.count(F.lit(1)))


@query(
    "approximate_counts",
    "SELECT n_name, true AS near_count, true AS near_median FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def _(spark, d):
    """Estimates beside exact values: whether a distinct count is within four of its deviations, and a median between the exact 45th and 55th percentile."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name")
    out = rows.agg(
        F.approx_count_distinct("c_custkey", 0.02).alias("a"), F.countDistinct("c_custkey").alias("e"),
        F.percentile_approx("c_acctbal", 0.5, 1000).alias("m"), F.percentile("c_acctbal", F.array(F.lit(0.45), F.lit(0.55))).alias("p"),
    )
    return out.select("n_name", (F.abs(F.col("a") - F.col("e")) <= 0.08 * F.col("e") + 1).alias("near_count"), F.col("m").between(F.col("p")[0], F.col("p")[1]).alias("near_median"))


@query("sort_aggregate", "SELECT o_custkey AS id, min(o_orderpriority) AS first_priority, max(o_orderpriority) AS last_priority, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def _(spark, d):
    """Minima of text and ordered lists: an aggregation over sorted rows."""
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return rows.agg(F.min("o_orderpriority").alias("first_priority"), F.max("o_orderpriority").alias("last_priority"), listed.alias("orders"))


def _compound(price: pd.Series, discount: pd.Series, tax: pd.Series) -> pd.Series:
    return price * (1 - discount) * (1 + tax)


def _spread(x: pd.Series) -> float:
    return float(x.max() - x.min())


@query("user_functions", "SELECT l_returnflag AS flag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS total, round(max(l_quantity) - min(l_quantity), 4) AS spread FROM lineitem GROUP BY 1")
def _(spark, d):
    """A function of the user on columns and one on groups, in Arrow batches; built-in ones are faster where they exist."""
    rows = table(spark, d, "lineitem")
    compound, spread_of = F.pandas_udf(_compound, "double"), F.pandas_udf(_spread, "double")
    total = rows.select(F.col("l_returnflag").alias("flag"), compound("l_extendedprice", "l_discount", "l_tax").alias("x")).groupBy("flag").agg(F.round(F.sum("x"), 1).alias("total"))
    # a group is bounded by what one task reads: the spread of spreads would not be the spread, so ends are taken first
    ends = rows.select(F.col("l_returnflag").alias("flag"), "l_linenumber", "l_quantity").groupBy("flag", "l_linenumber").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"))
    spread = ends.select("flag", F.explode(F.array("a", "b")).alias("x")).groupBy("flag").agg(F.round(spread_of("x"), 4).alias("spread"))
    return total.join(spread, "flag")


class _Words:
    def eval(self, text: str):
        for i, w in enumerate((text or "").split()):
            yield w, i


@query("table_function", "WITH w AS (SELECT unnest(string_split(p_type, ' ')) AS word, unnest(range(len(string_split(p_type, ' ')))) AS place FROM part) SELECT word, place::INTEGER AS place, count(*)::BIGINT AS n FROM w GROUP BY 1, 2")
def _(spark, d):
    """A table function of the user over the distinct texts of a column."""
    types = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    spark.udtf.register("loom_words", F.udtf(_Words, returnType="word string, place int"))
    types.createOrReplaceTempView("loom_types")
    return spark.sql("SELECT w.word, w.place, sum(t.n) AS n FROM loom_types t, LATERAL loom_words(t.p_type) w GROUP BY w.word, w.place")


@query("file_formats", "SELECT format, count(*)::BIGINT AS n, round(sum(s_acctbal), 2) AS total, min(s_name) AS first_name FROM supplier, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(format) GROUP BY format")
def _(spark, d):
    """A table written and read again in each format, with its schema."""
    rows, scratch = table(spark, d, "supplier"), Scratch(spark)
    out = None
    for name in ("parquet", "orc", "json", "csv"):
        path = scratch.path(name)
        rows.write.format(name).option("header", True).save(path)
        back = spark.read.format(name).schema(rows.schema).option("header", True).load(path)
        back = back.agg(F.lit(name).alias("format"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"), F.min("s_name").alias("first_name"))
        out = back if out is None else out.unionByName(back)
    return out


@query("frames", "SELECT o_orderkey AS id, round(avg(o_totalprice) OVER w, 4) AS trailing, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)::BIGINT AS recent, round(o_totalprice - lag(o_totalprice, 1, 0) OVER w0, 4) AS step FROM orders WINDOW w0 AS (PARTITION BY o_custkey ORDER BY o_orderkey), w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    recent = Window.partitionBy("o_custkey").orderBy(day).rangeBetween(-90, 0)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.round(F.avg("o_totalprice").over(own.rowsBetween(-2, 0)), 4).alias("trailing"), F.count("*").over(recent).alias("recent"),
        F.round(F.col("o_totalprice") - F.lag("o_totalprice", 1, 0.0).over(own), 4).alias("step"),
    )


@query("set_operations", "SELECT 'both' AS side, count(*)::BIGINT AS n FROM (SELECT c_nationkey AS k, c_mktsegment AS s FROM customer INTERSECT SELECT s_nationkey, 'BUILDING' FROM supplier) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("BUILDING").alias("s"))
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(c.intersect(s), "both").unionByName(count(c.select("k").subtract(s.select("k")), "customers only")).unionByName(count(c.select("k").union(s.select("k")).distinct(), "any"))


# --- streams ----------------------------------------------------------------------------------


def _stream(spark, d):
    """The event log as a stream of four files, one a batch."""
    events, folder = table(spark, d, "events"), Scratch(spark).path("source")
    events.repartition(4).write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _replayed(spark, stream, mode: str):
    from loomgraph.streaming.transitions import replay

    scratch = Scratch(spark)
    folder = scratch.path("replayed")
    replay(stream, folder, scratch.path("checkpoint"), mode)
    return spark.read.parquet(folder)


@query("stream_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    """Tumbling windows over the event log read as a stream; complete mode, so no window waits for the watermark."""
    from loomgraph.streaming.transitions import windowed_counts

    out = _replayed(spark, windowed_counts(_stream(spark, d)), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("stream_sliding", "WITH s AS (SELECT time_bucket(INTERVAL '1 hour', ts) - o * INTERVAL '1 hour' AS w, event_type FROM events, (VALUES (0), (1)) v(o)) SELECT w AS window_start, event_type, count(*)::BIGINT AS events FROM s GROUP BY 1, 2")
def _(spark, d):
    """Windows of two hours every hour."""
    from loomgraph.streaming.transitions import windowed_counts

    out = _replayed(spark, windowed_counts(_stream(spark, d), "2 hours", "1 hour"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


@query(
    "stream_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS session_start, count(*)::BIGINT AS events FROM s GROUP BY user_id, n",
)
def _(spark, d):
    from loomgraph.streaming.transitions import sessions

    out = _replayed(spark, sessions(_stream(spark, d), late=None), "complete")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "events")


@query("stream_activation", "SELECT event_type, count(*)::BIGINT AS events, round(sum(value), 4) AS weight FROM events GROUP BY 1")
def _(spark, d):
    from loomgraph.streaming.transitions import running_activation

    return _replayed(spark, running_activation(_stream(spark, d)), "complete").select("event_type", "events", F.round("weight", 4).alias("weight"))


@query("stream_distinct", "SELECT event_type, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1")
def _(spark, d):
    """Repeated (type, user) rows of a stream are dropped in its state."""
    return _replayed(spark, _stream(spark, d).select("event_type", "user_id").dropDuplicates(["event_type", "user_id"]), "append").groupBy("event_type").agg(F.count("*").alias("users"))
