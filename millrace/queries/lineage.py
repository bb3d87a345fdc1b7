"""Graphs built from the key chains of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.queries.base import Registry
from millrace.runtime import load

R = Registry()

CHAIN = """(SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'order' AS relationship FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'home' FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part' FROM nation)"""
NODES = """(SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'Consume' ELSE 'Order' END AS type FROM orders UNION ALL SELECT 'c' || c_custkey, c_mktsegment FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey = 0 THEN 'PutRegion' ELSE 'Region' END FROM region)"""


def _edges(spark, d):
    def part(t, a, x, b, y, rel):
        return load(spark, d, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"), F.lit(rel).alias("relationship"))

    return (
        part("orders", "o", "o_orderkey", "c", "o_custkey", "order").unionByName(part("customer", "c", "c_custkey", "n", "c_nationkey", "home"))
        .unionByName(part("nation", "n", "n_nationkey", "r", "n_regionkey", "part"))
    )


def _nodes(spark, d):
    def part(t, a, x, kind):
        return load(spark, d, t).select(F.concat(F.lit(a), x).alias("id"), kind.alias("type"))

    return (
        part("orders", "o", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "Consume").otherwise("Order"))
        .unionByName(part("customer", "c", "c_custkey", F.col("c_mktsegment"))).unionByName(part("nation", "n", "n_nationkey", F.lit("Nation")))
        .unionByName(part("region", "r", "r_regionkey", F.when(F.col("r_regionkey") == 0, "PutRegion").otherwise("Region")))
    )


@R.add(
    "graph_degrees",
    f"""SELECT id, type, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, coalesce(o, 0) = 0 AND NOT regexp_matches(type, '^(Put|Log|Publish|Send|Notify|PutEmail|PutSlack)') AS dead_end,
    coalesce(i, 0) = 0 AND NOT regexp_matches(type, '^(Get|List|Listen|Consume|Generate|TailFile|HandleHttp)') AS orphan, coalesce(o, 0) = 0 AND coalesce(i, 0) = 0 AS disconnected
    FROM {NODES} LEFT JOIN (SELECT src, count(*) AS o FROM {CHAIN} GROUP BY src) ON id = src LEFT JOIN (SELECT dst, count(*) AS i FROM {CHAIN} GROUP BY dst) ON id = dst""",
)
def graph_degrees(spark, d):
    return G.node_report(_nodes(spark, d), _edges(spark, d))


@R.add(
    "reachability",
    f"""WITH e AS {CHAIN}, s AS (SELECT 'o' || o_orderkey AS start FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'c' || c_custkey FROM customer) SELECT start, start AS node, 0 AS hops FROM s
    UNION ALL SELECT start, dst, 1 FROM s JOIN e ON src = start UNION ALL SELECT start, b.dst, 2 FROM s JOIN e a ON a.src = start JOIN e b ON a.dst = b.src
    UNION ALL SELECT start, c.dst, 3 FROM s JOIN e a ON a.src = start JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src""",
)
def reachability(spark, d):
    """What pending orders and all customers reach: from chosen starts, not all pairs."""
    orders = load(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    customers = load(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return G.reach(_edges(spark, d), orders.unionAll(customers).withColumn("start", F.col("node")))


@R.add(
    "shortest_path",
    """SELECT 'r0' AS node, 0 AS hops UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0
    UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
    UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0""",
)
def shortest_path(spark, d):
    back = _edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.shortest_hops(back, "r0")


# blocks of four customers: even blocks are rings, odd blocks are chains, and every block points to block b // 2
RINGS = """(SELECT c_custkey AS src, CASE WHEN c_custkey % 4 < 3 THEN c_custkey + 1 WHEN (c_custkey // 4) % 2 = 0 THEN c_custkey - 3 END AS dst FROM customer
  UNION ALL SELECT c_custkey, (c_custkey // 8) * 4 FROM customer WHERE c_custkey % 4 = 0 AND c_custkey > 0)"""


def _rings(spark, d):
    c = load(spark, d, "customer").select("c_custkey")
    step = c.selectExpr("c_custkey AS src", "CASE WHEN c_custkey % 4 < 3 THEN c_custkey + 1 WHEN (c_custkey div 4) % 2 = 0 THEN c_custkey - 3 END AS dst")
    up = c.filter("c_custkey % 4 = 0 AND c_custkey > 0").selectExpr("c_custkey AS src", "(c_custkey div 8) * 4 AS dst")
    return step.unionByName(up)


@R.add("cycles", "SELECT c_custkey AS node, (c_custkey // 4) * 4 AS component FROM customer WHERE (c_custkey // 4) % 2 = 0")
def cycles(spark, d):
    return G.cycles(_rings(spark, d))


# all customers as one ring, and the same without its last step
def _ring(spark, d):
    n = load(spark, d, "customer").agg(F.max("c_custkey").alias("n"))
    keys = load(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    return keys.select("src", F.when(F.col("src") == n.scalar(), keys.agg(F.min("src")).scalar()).otherwise(F.col("src") + 1).alias("dst"))


@R.add("cycles_long", "SELECT c_custkey AS node, (SELECT min(c_custkey) FROM customer) AS component FROM customer")
def cycles_long(spark, d):
    return G.cycles(_ring(spark, d))


@R.add("topo_levels_long", "SELECT c_custkey AS id, (c_custkey - (SELECT min(c_custkey) FROM customer))::INT AS level FROM customer")
def topo_levels_long(spark, d):
    ring = _ring(spark, d)
    return G.levels(ring.select(F.col("src").alias("id")), ring.filter("dst > src"))


@R.add(
    "cyclic_reachability",
    f"""WITH RECURSIVE e AS (SELECT src, dst FROM {RINGS} WHERE dst IS NOT NULL), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
    SELECT src, count(*) AS reached FROM r GROUP BY src""",
)
def cyclic_reachability(spark, d):
    return G.closure(_rings(spark, d)).groupBy("src").agg(F.count(F.lit(1)).alias("reached"))


LEVELS = """WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 1 ELSE 0 END AS l FROM customer),
  n AS (SELECT n_nationkey, n_regionkey, coalesce(max(l) + 1, 0) AS l FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY ALL),
  r AS (SELECT r_regionkey, coalesce(max(l) + 1, 0) AS l FROM region LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT 'o' || o_orderkey AS id, 0 AS level, 0 AS priority FROM orders UNION ALL SELECT 'c' || c_custkey, l, 2 FROM c UNION ALL SELECT 'n' || n_nationkey, l, 3 FROM n UNION ALL SELECT 'r' || r_regionkey, l, 4 FROM r"""


@R.add("topo_levels", LEVELS)
def topo_levels(spark, d):
    first = F.substring("id", 1, 1)
    role = F.when(first == "o", "source").when(first == "c", "transform").when(first == "r", "sink").otherwise("other")
    nodes = _nodes(spark, d).withColumn("role", role)
    return G.topological_order(nodes, _edges(spark, d)).select("id", "level", "priority")


@R.add(
    "barrier_propagation",
    """WITH c AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND c_mktsegment <> 'BUILDING')
    SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'c' || c_custkey FROM c UNION ALL SELECT DISTINCT 'n' || c_nationkey FROM c
    UNION ALL SELECT DISTINCT 'r' || n_regionkey FROM c JOIN nation ON c_nationkey = n_nationkey""",
)
def barrier_propagation(spark, d):
    return G.propagate(_nodes(spark, d), _edges(spark, d), F.col("type") == "Consume", F.col("type") == "BUILDING")


@R.add(
    "iterate_until_empty",
    """WITH RECURSIVE s AS (SELECT c_custkey AS id, c_custkey AS v, 0 AS round FROM customer UNION ALL SELECT id, v // 8, round + 1 FROM s WHERE v // 8 > 0) SELECT id, v, round FROM s""",
)
def iterate_until_empty(spark, d):
    start = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("v"))
    return G.iterate(start, lambda df: df.selectExpr("id", "v div 8 AS v").filter("v > 0"))


@R.add(
    "stream_lineage_table",
    f"SELECT src AS step, 'output' AS direction, dst AS other, relationship FROM {CHAIN} UNION SELECT dst, 'input', src, relationship FROM {CHAIN}",
)
def stream_lineage_table(spark, d):
    return G.lineage(_edges(spark, d))
