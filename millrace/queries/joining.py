"""Lookups, keys, ranges and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.hashrand import uniform
from millrace.operators import joins as J
from millrace.operators import sets as S
from millrace.queries.base import Registry
from millrace.runtime import load

R = Registry()


@R.add(
    "lookup_record",
    """SELECT event_id, c_name, CASE WHEN c_custkey IS NULL THEN 'unknown' ELSE c_mktsegment END AS c_mktsegment, c_custkey IS NOT NULL AS matched
    FROM events LEFT JOIN customer ON user_id * 20 = c_custkey""",
)
def lookup_record(spark, d):
    events = load(spark, d, "events").select("event_id", (F.col("user_id") * 20).alias("c_custkey"))
    out = J.lookup(events, load(spark, d, "customer"), ["c_custkey"], ["c_name", "c_mktsegment"], {"c_mktsegment": "unknown"})
    return out.select("event_id", "c_name", "c_mktsegment", "matched")


@R.add(
    "lookup_salted",
    "SELECT l_orderkey, l_linenumber, p_brand, p_partkey IS NOT NULL AS matched FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
)
def lookup_salted(spark, d):
    line = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return J.lookup(line, load(spark, d, "part"), ["p_partkey"], ["p_brand"], salted=True).drop("p_partkey")


U = "(('0x' || substr(md5('7|orders|o_custkey|' || o_orderkey), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


@R.add(
    "fk_assign",
    f"""WITH idx AS (SELECT c_custkey AS fk, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
    d AS (SELECT o_orderkey, floor({U} * (SELECT count(*) FROM customer))::BIGINT AS i FROM orders)
    SELECT o_orderkey, fk FROM d JOIN idx USING (i)""",
)
def fk_assign(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey")
    return J.assign_fk(orders, load(spark, d, "customer"), "c_custkey", "fk", uniform(7, "orders", "o_custkey", F.col("o_orderkey")))


@R.add(
    "fk_orphans",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey + 5 NOT IN (SELECT s_suppkey FROM supplier)",
)
def fk_orphans(spark, d):
    line = load(spark, d, "lineitem").withColumn("fk", F.col("l_suppkey") + 5)
    return J.orphans(line, load(spark, d, "supplier"), "fk", "s_suppkey").select("l_orderkey", "l_linenumber")


@R.add(
    "fk_orphan_ratio",
    """SELECT count(*) AS children, count(*) FILTER (s_suppkey IS NULL) AS orphans, round(count(*) FILTER (s_suppkey IS NULL) / count(*)::DOUBLE, 6) AS orphan_ratio
    FROM lineitem LEFT JOIN supplier ON l_suppkey + 5 = s_suppkey""",
)
def fk_orphan_ratio(spark, d):
    line = load(spark, d, "lineitem").withColumn("fk", F.col("l_suppkey") + 5)
    return J.orphan_ratio(line, load(spark, d, "supplier"), "fk", "s_suppkey")


@R.add("fk_semi_filter", "SELECT event_id FROM events WHERE user_id * 20 IN (SELECT c_custkey FROM customer)")
def fk_semi_filter(spark, d):
    events = load(spark, d, "events").withColumn("fk", F.col("user_id") * 20)
    return J.valid_children(events, load(spark, d, "customer"), "fk", "c_custkey").select("event_id")


# metadata rows derived from the given tables: one constraint per nation, half of them foreign keys
@R.add(
    "fk_discovery",
    """SELECT 'fk_' || n_name AS constraint_name, n_name AS "table", 'c' || n_regionkey AS "column", r_name AS references_table, 'id' AS references_column
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0""",
)
def fk_discovery(spark, d):
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    kind = F.when(F.col("n_nationkey") % 2 == 0, F.lit("fk_")).otherwise(F.lit("pk_"))
    name = F.concat(kind, F.col("n_name")).alias("constraint_name")
    usage = nation.select(name, F.col("n_name").alias("table_name"), F.concat(F.lit("c"), "n_regionkey").alias("column_name"))
    target = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        name, F.col("r_name").alias("table_name"), F.lit("id").alias("column_name")
    )
    return J.discover_fks(usage, target)


IP = "(((event_id * 7919) % 250) * 16777216 + ((event_id * 104729) % 65536) * 256 + event_id % 256)"


@R.add(
    "ip_range_enrich",
    f"""WITH r AS (SELECT n_nationkey::BIGINT * 167772160 AS lo, n_nationkey::BIGINT * 167772160 + 150000000 AS hi, n_name AS country, n_regionkey AS area FROM nation),
    e AS (SELECT event_id, {IP} AS addr FROM events)
    SELECT event_id, addr, country, area FROM e LEFT JOIN r ON addr BETWEEN lo AND hi""",
)
def ip_range_enrich(spark, d):
    nation = load(spark, d, "nation")
    lo = F.col("n_nationkey").cast("bigint") * 167772160
    ranges = nation.select(lo.alias("lo"), (lo + 150000000).alias("hi"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("area"))
    i = F.col("event_id")
    octets = [(i * 7919) % 250, F.floor(((i * 104729) % 65536) / 256), (i * 104729) % 256, i % 256]
    events = load(spark, d, "events").select("event_id", F.concat_ws(".", *octets).alias("ip"))
    events = events.withColumn("addr", J.ipv4_to_long(F.col("ip"))).drop("ip")
    return J.range_enrich(events, ranges, "addr", "lo", "hi", ["country", "area"])


@R.add(
    "merge_records",
    """SELECT s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer""",
)
def merge_records(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = load(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    return S.union_all(a, b)


@R.add(
    "unmatched_except",
    "SELECT user_id, event_type FROM events EXCEPT ALL SELECT user_id, event_type FROM events WHERE value > 10 AND event_type <> 'click'",
)
def unmatched_except(spark, d):
    df = load(spark, d, "events")
    cols = ["user_id", "event_type"]
    return S.unmatched_except(df.select(cols), df.filter("value > 10 and event_type <> 'click'").select(cols))


@R.add("duplicate_rows", "SELECT event_id, copy::INT AS copy FROM events, range(1, 4) t(copy)")
def duplicate_rows(spark, d):
    return S.replicate(load(spark, d, "events").select("event_id"), 3)


@R.add("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem")
def distinct_rows(spark, d):
    return S.distinct_rows(load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"))


@R.add(
    "name_set_diff",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' ELSE 'removed' END AS change
    FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < DATE '1996-01-01') a
    FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= DATE '1996-01-01') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""",
)
def name_set_diff(spark, d):
    orders = load(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    old = orders.filter("o_orderdate < date '1996-01-01'")
    return S.name_diff(old, orders.filter("o_orderdate >= date '1996-01-01'"), ["k"])


@R.add(
    "table_intersect",
    "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'",
)
def table_intersect(spark, d):
    line = load(spark, d, "lineitem")
    return S.name_intersect(line.filter("l_returnflag = 'A'"), line.filter("l_returnflag = 'N'"), ["l_partkey", "l_suppkey"])
