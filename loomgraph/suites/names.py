"""Scalar functions over names, numbers and attributes of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.registry import query
from loomgraph.sources.derive import table

PACKAGE = "'example.com/' || replace(p_type, ' ', '/')"


@query(
    "scalar_names",
    f"""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, {PACKAGE} AS path FROM part)
SELECT id, coalesce(nullif(regexp_replace(brand || ':' || name, '[^A-Za-z0-9\\-_.]', '_', 'g'), ''), 'graph') AS slug,
  coalesce(nullif(regexp_replace(name, '[^A-Za-z0-9\\-_]', '_', 'g'), ''), '_') AS name_slug,
  CASE WHEN len(string_split(path, '/')) <= 2 THEN path ELSE array_to_string(string_split(path, '/')[-2:], '/') END AS short_path,
  path AS package, replace(brand, '#', '') AS symbol, regexp_matches(name, '^[A-Z]') AS exported,
  replace(replace(replace(replace('<' || name || '> & "' || brand || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
  path = 'example.com/x' OR starts_with(path || '.F', 'example.com/' || string_split(path, '/')[2] || '.') AS inside,
  path || ':' || id || ':7:type:' || name || CASE WHEN id % 3 > 0 THEN '#' || (id % 3) ELSE '' END AS node_id, 'pkg:' || path || ':type' AS package_id FROM p""",
)
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.expr(PACKAGE).alias("path"))
    symbol = S.split_identifier(F.concat("path", F.lit("."), F.replace("brand", F.lit("#"), F.lit(""))))
    first = F.split("path", "/")[1]
    qname = F.concat("path", F.lit(".F"))
    inside = S.in_package(F.col("path"), "example.com/x") | qname.startswith(F.concat(F.lit("example.com/"), first, F.lit(".")))
    return p.select(
        "id",
        S.slug(F.concat("brand", F.lit(":"), "name")).alias("slug"),
        S.slugify_name(F.col("name")).alias("name_slug"),
        S.short_import_path(F.col("path"), 2).alias("short_path"),
        symbol["package"].alias("package"),
        symbol["name"].alias("symbol"),
        S.exported(F.col("name")).alias("exported"),
        S.xml_escape(F.concat(F.lit("<"), "name", F.lit('> & "'), "brand", F.lit('"'))).alias("escaped"),
        inside.alias("inside"),
        S.node_id(F.col("path"), F.col("id"), F.lit(7), F.lit("type"), F.col("name"), F.col("id") % 3).alias("node_id"),
        S.package_id(F.col("path"), F.lit("type")).alias("package_id"),
    )


@query(
    "scalar_lists",
    """WITH p AS (SELECT p_partkey AS id, list_filter(list_transform(string_split(replace(p_type, ' ', ' , ') || ', ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM part)
SELECT id, array_to_string(tags, '|') AS tags, CASE WHEN list_contains(tags, 'Brand#11') THEN array_to_string(tags, ',') ELSE array_to_string(list_append(tags, 'Brand#11'), ',') END AS joined,
  array_to_string(list_sort(list_distinct(list_concat(tags, tags))), ',') AS distinct_tags, array_to_string(tags[1:2], ',') AS sampled FROM p""",
)
def _(spark, d):
    text = F.concat(F.replace("p_type", F.lit(" "), F.lit(" , ")), F.lit(", ,"), "p_brand")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.split_list(text).alias("tags"))
    tags = F.col("tags")
    return p.select(
        "id",
        F.array_join(tags, "|").alias("tags"),
        S.join_tags(tags, F.lit("Brand#11")).alias("joined"),
        F.array_join(S.dedup_sorted(F.concat(tags, tags)), ",").alias("distinct_tags"),
        F.array_join(S.sample_ids(tags, 2), ",").alias("sampled"),
    )


@query(
    "scalar_numbers",
    """SELECT o_orderkey AS id, sign(o_totalprice - 150000) * floor(abs(o_totalprice - 150000) * 100 + 0.5) / 100 AS rounded, round(sqrt(o_totalprice), 6) AS root, round((o_custkey * 3.0 + o_orderkey * 15.0) / 1e6, 6) AS cost,
  round(log2(o_totalprice), 6) AS bits, round(sqrt(o_totalprice * o_totalprice + 9), 4) AS hypot, ceil(o_totalprice / 7)::BIGINT AS up FROM orders""",
)
def _(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        S.round_half_away(price - 150000, 2).alias("rounded"),
        F.round(S.newton_sqrt(price), 6).alias("root"),
        F.round(S.token_cost(F.col("o_custkey"), F.col("o_orderkey"), 3.0, 15.0), 6).alias("cost"),
        F.round(F.log2(price), 6).alias("bits"),
        F.round(F.hypot(price, F.lit(3.0)), 4).alias("hypot"),
        F.ceil(price / 7).alias("up"),
    )


@query(
    "scalar_attrs",
    """WITH e AS (SELECT event_id AS id, unnest([json_extract_string(props, '$.' || k) FOR k IN json_keys(props)]) AS v, unnest(json_keys(props)) AS k FROM events),
x AS (SELECT id, k, v FROM e UNION ALL SELECT id, 'flag', CASE WHEN id % 2 = 0 THEN 'true' ELSE 'no' END FROM e UNION ALL SELECT id, 'ratio', (id / 4)::VARCHAR FROM e),
t AS (SELECT k, v, CASE WHEN v IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'float' ELSE 'string' END AS kind FROM x)
SELECT k AS name, kind, count(*)::BIGINT AS n, round(coalesce(sum(CASE WHEN v = 'true' THEN 1 WHEN kind IN ('int', 'float') THEN v::DOUBLE END), 0), 3) AS total FROM t GROUP BY k, kind""",
)
def _(spark, d):
    attrs = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("flag"), F.when(F.col("event_id") % 2 == 0, "true").otherwise("no"), F.lit("ratio"), (F.col("event_id") / 4).cast("string")),
    )
    rows = table(spark, d, "events").select(F.explode(attrs).alias("name", "v"))
    rows = rows.select("name", S.coerced_kind(F.col("v")).alias("kind"), S.coerced_number(F.col("v")).alias("x"))
    return rows.groupBy("name", "kind").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("x"), F.lit(0.0)), 3).alias("total"))


@query(
    "scalar_digests",
    """SELECT s_suppkey AS id, left(sha256(s_name), 16) AS content_hash,
  lower(lpad(printf('%x', (list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(s_name, ''), lambda c: ord(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) // 4294967296)::BIGINT), 8, '0')) AS fnv_high FROM supplier""",
)
def _(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), S.content_hash(F.col("s_name")).alias("content_hash"), F.substring(S.fnv1a(F.col("s_name")), 1, 8).alias("fnv_high"))


@query(
    "json_envelopes",
    """SELECT user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS taken, count(*)::BIGINT AS events, CASE WHEN user_id % 2 = 0 THEN count(*)::BIGINT END AS reread FROM events GROUP BY user_id""",
)
def _(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("events"))
    # documents of version 1 and 2, of which version 1 is read again
    text = F.when(F.col("user_id") % 2 == 0, S.envelope(1, events=F.col("events"))).otherwise(S.envelope(2, events=F.col("events")))
    return rows.select("user_id", S.utc_stamp(F.col("ts")).alias("taken"), "events", S.open_envelope(text, 1, "version int, events long")["events"].alias("reread"))
