"""The derived graphs in DuckDB SQL, as lists of common table expressions."""

PARTIES = """
place AS (SELECT n_nationkey, n_name AS grp, r_name AS role FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT concat('c', c_custkey) AS id, 'function' AS kind, c_name AS name, grp, role FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT concat('s', s_suppkey), 'type', s_name, grp, role FROM supplier JOIN place ON s_nationkey = n_nationkey)"""

TRADE = (
    PARTIES
    + """,
lines AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS seq, l_suppkey, l_returnflag, o_custkey, year(o_orderdate) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (
  SELECT concat('c', o_custkey) AS src, concat('s', l_suppkey) AS dst, 'calls' AS kind, seq, year FROM lines
  UNION ALL SELECT concat('s', l_suppkey), concat('c', o_custkey), 'returns', seq, year FROM lines WHERE l_returnflag = 'R')"""
)


NATIONS = """
np AS (
  SELECT cn.n_name AS a, sn.n_name AS b, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY cn.n_name, sn.n_name),
nb AS (SELECT avg(n) + stddev_pop(n) AS bound FROM np),
edges AS (SELECT a AS src, b AS dst, 'dependsOn' AS kind, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS seq, n FROM np, nb WHERE n > bound),
nodes AS (SELECT n_name AS id, 'package' AS kind, n_name AS name, r_name AS grp, r_name AS role FROM nation JOIN region ON n_regionkey = r_regionkey)"""


CONTAINMENT = """
place AS (SELECT n_nationkey, n_name AS grp, r_name AS role FROM nation JOIN region ON n_regionkey = r_regionkey),
people AS (
  SELECT concat('c', c_custkey) AS id, 'function' AS kind, c_name AS name, grp, role FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT concat('s', s_suppkey), 'type', s_name, grp, role FROM supplier JOIN place ON s_nationkey = n_nationkey),
nodes AS (
  SELECT r_name AS id, 'package' AS kind, r_name AS name, '' AS grp, '' AS role FROM region
  UNION ALL SELECT concat('n:', grp), 'file', grp, role, '' FROM place UNION ALL SELECT * FROM people),
edges AS (
  SELECT role AS src, concat('n:', grp) AS dst, 'contains' AS kind, 0 AS seq FROM place
  UNION ALL SELECT concat('n:', grp), id, 'contains', 0 FROM people)"""


PARTS = """
ol AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
edges AS (
  SELECT concat('p', a.l_partkey) AS src, concat('p', b.l_partkey) AS dst, 'references' AS kind, a.l_orderkey AS seq
  FROM ol a JOIN ol b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
nodes AS (SELECT concat('p', p_partkey) AS id, 'type' AS kind, p_name AS name, p_brand AS grp, p_type AS role FROM part)"""


TRANSITIONS = """
ev AS (SELECT user_id, event_id, ts, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
steps AS (SELECT user_id, src, dst, event_id AS seq, ts FROM ev WHERE dst IS NOT NULL)"""

UNDIRECTED = "und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), both_ways AS (SELECT a AS id, b AS other FROM und UNION ALL SELECT b, a FROM und)"
DIRECTED = "dir AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst)"

CONTRACTS = """
br AS (SELECT DISTINCT p_brand, substr(p_brand, 1, 7) AS m FROM part),
li AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem),
nodes AS (
  SELECT DISTINCT concat('m:', m) AS id, 'interface' AS kind, m AS name, m AS grp, '' AS role FROM br
  UNION ALL SELECT concat('b:', p_brand), 'interface', p_brand, m, '' FROM br
  UNION ALL SELECT concat('p', p_partkey), 'type', p_name, p_brand, p_type FROM part
  UNION ALL SELECT concat('s', s_suppkey), 'function', s_name, '', '' FROM supplier),
edges AS (
  SELECT concat('b:', p_brand) AS src, concat('m:', m) AS dst, 'embeds' AS kind FROM br
  UNION ALL SELECT concat('p', p_partkey), concat('b:', p_brand), 'implements' FROM part
  UNION ALL SELECT DISTINCT concat('s', l_suppkey), concat('p', l_partkey), CASE WHEN l_returnflag = 'R' THEN 'returns' ELSE 'usesType' END FROM li)"""

SERVICES = """
place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
own AS (SELECT concat('s', s_suppkey) AS id, s_name, n_name, r_name, CASE WHEN s_suppkey % 2 = 0 THEN 'method' ELSE 'function' END AS kind, concat('s', lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS next FROM supplier JOIN place ON s_nationkey = n_nationkey),
nodes AS (
  SELECT concat('r:', r_name) AS id, 'type' AS kind, r_name AS name, '' AS grp, '' AS role FROM region
  UNION ALL SELECT concat('n:', n_name), 'type', n_name, r_name, '' FROM place UNION ALL SELECT id, kind, s_name, n_name, '' FROM own),
edges AS (
  SELECT concat('n:', n_name) AS src, concat('r:', r_name) AS dst, 'implements' AS kind FROM place
  UNION ALL SELECT concat('n:', n_name), id, 'contains' FROM own WHERE kind = 'method' UNION ALL SELECT id, concat('n:', n_name), 'returns' FROM own WHERE kind = 'function'
  UNION ALL SELECT id, concat('r:', r_name), 'usesType' FROM own WHERE kind = 'method' UNION ALL SELECT id, next, 'calls' FROM own WHERE next <> 's')"""
