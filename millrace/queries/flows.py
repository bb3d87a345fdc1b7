"""Whole flows, written as plain composition of operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import aggregate as A
from millrace.operators import joins as J
from millrace.operators import project as P
from millrace.operators import route as RT
from millrace.operators import sets as U
from millrace.operators import text as X
from millrace.queries.base import Registry
from millrace.runtime import load, scratch_path
from millrace.sources import files
from millrace.streaming import streams as S

R = Registry()


@R.add(
    "flow_sales",
    """WITH sales AS (SELECT regexp_replace(r_name, '[^A-Z]+', '_', 'g') AS region, p_brand AS product, l_extendedprice AS amount, l_shipdate AS sold FROM lineitem
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 1)
    SELECT CASE region WHEN 'ASIA' THEN 'asia' WHEN 'EUROPE' THEN 'europe' WHEN 'AMERICA' THEN 'america' ELSE 'unmatched' END AS route, region, product, round(sum(amount), 2) AS total,
    count(*) AS n, 'sales' AS _source FROM sales WHERE sold >= (SELECT max(l_shipdate) - INTERVAL 7 DAY FROM lineitem) GROUP BY ALL""",
)
def flow_sales(spark, d):
    """CSV in, validated, routed by region, cleaned, summed over the last seven days, stamped, one folder per route."""
    line = load(spark, d, "lineitem")
    raw = (
        line.join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("r_name").alias("region"), F.col("p_brand").alias("product"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").cast("date").alias("sold"))
    )
    landed, out = scratch_path(spark, "sales") + ".csv", scratch_path(spark, "sales-out")
    files.convert(raw, landed, "csv", "gzip")
    sales = files.read_any(spark, landed, raw.schema)
    valid, _ = RT.split_valid(sales, {"amount": "amount IS NOT NULL", "quantity": "quantity > 1"})
    cleaned = X.replace_text(valid, "region", "[^A-Z]+", "_")
    recent = cleaned.filter(F.col("sold") >= F.date_sub(sales.agg(F.max("sold").alias("m")).scalar(), 7))
    summed = A.group_sum_count(recent, ["region", "product"], "amount")
    routed = RT.route(summed, {"asia": "region = 'ASIA'", "europe": "region = 'EUROPE'", "america": "region = 'AMERICA'"}, mode="first")
    files.write_by(P.stamp(routed, "sales"), out, ["route"])
    return spark.read.parquet(out).select("route", "region", "product", F.round("total", 2).alias("total"), "n", "_source")


@R.add(
    "flow_sensor_stream",
    """SELECT event_id, 'alert' AS route, 'user ' || user_id || ' in ' || coalesce(c_mktsegment, 'nowhere') || ' reads ' || (json_extract_string(props, '$.k')) AS message
    FROM events LEFT JOIN customer ON user_id = c_custkey WHERE json_extract_string(props, '$.k')::INT > 90 OR value > 95
    UNION ALL SELECT event_id, 'normal', NULL FROM events WHERE NOT (json_extract_string(props, '$.k')::INT > 90 OR value > 95)""",
)
def flow_sensor_stream(spark, d):
    """A stream of JSON readings: fields, threshold route, lookup and text for alerts, one sink per route."""
    customers = load(spark, d, "customer")
    feed = S.stream_table(spark, d, "events").select("event_id", "user_id", "value", "props")
    read = P.update_columns(X.json_paths(feed, "props", {"k": "$.k"}), {"k": "cast(k AS int)", "c_custkey": "user_id"}).drop("props")
    sink, checkpoint = scratch_path(spark, "sensors"), scratch_path(spark, "sensors-checkpoint")

    def run(batch, batch_id: int) -> None:
        routed = RT.route(batch, {"alert": "k > 90 OR value > 95", "normal": "true"}, mode="first")
        routed = routed.withColumn("c_custkey", F.when(F.col("route") == "alert", F.col("c_custkey")))
        seen = J.lookup(routed, customers, ["c_custkey"], ["c_mktsegment"], {"c_mktsegment": "nowhere"})
        text = F.when(F.col("route") == "alert", F.format_string("user %d in %s reads %d", "user_id", "c_mktsegment", "k"))
        out = seen.select("event_id", "route", text.alias("message"), F.lit(batch_id).alias("batch_id"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route", "batch_id").parquet(sink)

    S.for_each_batch(read, run, checkpoint)
    return spark.read.parquet(sink).select("event_id", "route", "message")


@R.add(
    "flow_stage_and_release",
    """SELECT o_orderkey, o_orderpriority, 'plant' AS _source FROM orders JOIN (SELECT user_id FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) >= 3) ON o_custkey = user_id
    WHERE o_orderdate >= TIMESTAMP '1996-01-01'""",
)
def flow_stage_and_release(spark, d):
    """Files of three formats merged, limited to recent rows by SQL, staged, and released by users with three signals."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    root = scratch_path(spark, "plant")
    kinds = (("O", "json"), ("F", "orc"), ("P", "parquet"))
    for status, fmt in kinds:
        files.convert(orders.filter(F.col("o_orderstatus") == status), f"{root}/{status}.{fmt}", fmt)
    landed = U.union_all(*[files.read_any(spark, f"{root}/{s}.{f}", orders.schema) for s, f in kinds])
    recent = spark.sql("SELECT * FROM {rows} WHERE o_orderdate >= :since", args={"since": datetime(1996, 1, 1)}, rows=landed)
    P.stamp(recent, "plant").write.parquet(f"{root}/stage")
    S.notify(load(spark, d, "events").filter("event_type = 'signup'").select("user_id"), f"{root}/signals")
    open_rows = S.gate(spark.read.parquet(f"{root}/stage"), spark.read.parquet(f"{root}/signals"), "o_custkey", "user_id", 3)
    return open_rows.select("o_orderkey", "o_orderpriority", "_source")
