"""Sources and sinks. What is written goes to the shared folder of ``spark.checkpoint.dir`` and is read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from millrace.operators.aggregate import string_agg
from millrace.queries.base import Registry
from millrace.runtime import load, scratch_path
from millrace.sources import changes, files, jdbc, kafka
from millrace.sources.sql import run_sql, table_stats
from millrace.plans.generate import gen_rows

R = Registry()

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@R.add(
    "read_any_format",
    "\nUNION ALL\n".join(f"SELECT '{f}' AS fmt, * FROM customer" for f in ("csv", "tsv", "json", "parquet", "orc", "plain")),
)
def read_any_format(spark, d):
    df = load(spark, d, "customer")
    out = None
    for fmt in ("csv", "tsv", "json", "parquet", "orc", "plain"):
        # "plain" has no extension in its folder name: found by the names and bytes of its files
        path = scratch_path(spark, "any") + ("" if fmt == "plain" else f".{fmt}")
        files.convert(df, path, {"tsv": "csv", "plain": "json"}.get(fmt, fmt), **({"sep": "\t"} if fmt == "tsv" else {}))
        back = files.read_any(spark, path, None if fmt in ("parquet", "orc") else CUSTOMER).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@R.add(
    "read_corrupt_split",
    """SELECT 'good' AS part, count(*) AS n, sum(event_id)::BIGINT AS ids, 0::BIGINT AS text_length FROM events WHERE event_id % 5 <> 0
    UNION ALL SELECT 'bad', count(*), NULL, sum(length('x' || event_id || ',oops,' || event_type))::BIGINT FROM events WHERE event_id % 5 = 0""",
)
def read_corrupt_split(spark, d):
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "event_id", F.lit(",oops,"), "event_type")).otherwise(F.concat_ws(",", "event_id", "user_id", "event_type"))
    path = scratch_path(spark, "corrupt")
    load(spark, d, "events").select(line.alias("value")).write.text(path)
    good, bad = files.read_permissive(spark, path, "event_id bigint, user_id bigint, event_type string", header="false")
    a = good.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.lit(0).cast("bigint").alias("text_length")).withColumn("part", F.lit("good"))
    b = bad.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("ids"), F.sum(F.length("_corrupt_record")).alias("text_length")).withColumn("part", F.lit("bad"))
    return a.unionByName(b)


@R.add("xml_row_scan", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def xml_row_scan(spark, d):
    path = scratch_path(spark, "xml")
    df = load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    df.write.format("xml").option("rowTag", "customer").option("rootTag", "customers").save(path)
    return files.read_xml(spark, path, "customer", "c_custkey bigint, c_name string, c_mktsegment string")


@R.add("incremental_scan", "SELECT o_orderkey, o_orderdate, (SELECT max(o_orderdate) FROM orders) AS new_max FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def incremental_scan(spark, d):
    from datetime import datetime

    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate")
    delta, new_max = jdbc.read_incremental(orders, "o_orderdate", datetime(1998, 1, 1))
    return delta.withColumn("new_max", new_max.select("new_max").scalar())


@R.add("file_listing", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS name, true AS has_bytes")
def file_listing(spark, d):
    return files.list_files(spark, d, "*.parquet").select("name", (F.col("length") > 0).alias("has_bytes"))


@R.add("range_source", "SELECT id, true AS timed FROM range((SELECT count(*) FROM orders)) AS r(id)")
def range_source(spark, d):
    return gen_rows(spark, load(spark, d, "orders").count()).select("id", F.col("generated_at").isNotNull().alias("timed"))


@R.add("sequence_scan", "SELECT c_custkey::VARCHAR AS key, c_name AS value FROM customer")
def sequence_scan(spark, d):
    path = scratch_path(spark, "sequence")
    # Spark writes sequence files from pair RDDs only
    pairs = load(spark, d, "customer").select(F.col("c_custkey").cast("string"), "c_name").rdd.map(tuple)
    pairs.saveAsSequenceFile(path)
    return files.read_sequence(spark, path)


@R.add("kafka_scan", "SELECT event_id::VARCHAR AS key, event_id, user_id, event_type, value FROM events")
def kafka_scan(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return kafka.decode_records(kafka.encode_records(events, "event_id"), "event_id bigint, user_id bigint, event_type string, value double")


@R.add("kafka_sink", """SELECT event_id::VARCHAR AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def kafka_sink(spark, d):
    return kafka.decode_records(kafka.encode_records(load(spark, d, "events").select("event_id", "event_type"), "event_id"))


SEQ = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
CDC_SQL = """WITH last AS (SELECT l_orderkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_returnflag DESC) = 1)
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN l_quantity END AS quantity, CASE WHEN l_orderkey IS NOT NULL THEN l_extendedprice ELSE o_totalprice END AS price
FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o FULL JOIN last ON o_orderkey = l_orderkey WHERE l_returnflag IS NULL OR l_returnflag <> 'R'"""


def _cdc(spark, d):
    target = load(spark, d, "orders").filter("o_orderkey % 2 = 0").selectExpr("o_orderkey", "cast(null as double) AS quantity", "o_totalprice AS price")
    feed = load(spark, d, "lineitem").selectExpr(
        "l_orderkey AS o_orderkey", "l_quantity AS quantity", "l_extendedprice AS price", "CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'insert' ELSE 'update' END AS op",
        "l_returnflag AS flag", *SEQ,
    )
    return target, feed


@R.add("cdc_apply", CDC_SQL)
def cdc_apply(spark, d):
    target, feed = _cdc(spark, d)
    return changes.apply_changes(target, feed, ["o_orderkey"], [*SEQ, "flag"], "op")


@R.add("table_write", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def table_write(spark, d):
    path, name = scratch_path(spark, "table"), f"millrace_{uuid4().hex}"
    df = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    files.write_table(df, name, "overwrite", ["o_orderstatus"], path=path)
    files.write_table(df.filter("o_orderstatus = 'P'"), name, "append", ["o_orderstatus"])
    return spark.table(name)


@R.add(
    "format_convert_write",
    "\nUNION ALL\n".join(f"SELECT '{f}' AS fmt, o_orderkey, o_orderstatus, o_totalprice FROM orders" for f in ("parquet-zstd", "parquet-lz4", "orc-snappy", "json-gzip", "csv-bzip2", "csv-deflate")),
)
def format_convert_write(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = None
    for kind in ("parquet-zstd", "parquet-lz4", "orc-snappy", "json-gzip", "csv-bzip2", "csv-deflate"):
        fmt, codec = kind.split("-")
        path = scratch_path(spark, kind)
        files.convert(df, path, fmt, codec)
        back = files.read_any(spark, path, df.schema, fmt).withColumn("fmt", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


@R.add(
    "upsert_merge",
    """SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
    UNION ALL SELECT c_custkey + 10000000, 'new', c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0""",
)
def upsert_merge(spark, d):
    target = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    hit = target.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    new = hit.selectExpr("c_custkey + 10000000 AS c_custkey", "'new' AS c_name", "c_acctbal")
    return changes.upsert(target, hit.unionByName(new), ["c_custkey"])


@R.add("compact_small_files", "SELECT count(*) AS rows, sum(o_orderkey)::BIGINT AS keys, true AS fewer_files FROM orders")
def compact_small_files(spark, d):
    small, big = scratch_path(spark, "small"), scratch_path(spark, "big")
    load(spark, d, "orders").repartition(24).write.parquet(small)
    files.compact(spark, small, big)
    before = files.list_files(spark, small, "*.parquet").agg(F.count(F.lit(1)).alias("n")).scalar()
    after = files.list_files(spark, big, "*.parquet").agg(F.count(F.lit(1)).alias("n")).scalar()
    return spark.read.parquet(big).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")).withColumn("fewer_files", after < before)


@R.add("adhoc_sql", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY c_mktsegment")
def adhoc_sql(spark, d):
    views = {"c": load(spark, d, "customer"), "o": load(spark, d, "orders")}
    sql = "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {c} JOIN {o} ON c_custkey = o_custkey WHERE o_totalprice > :floor GROUP BY c_mktsegment"
    return run_sql(spark, sql, views, {"floor": 100000.0})


@R.add("impala_sql_compat", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS joined, (SELECT count(*) FROM orders)::VARCHAR AS analyzed_rows FROM nation GROUP BY n_regionkey")
def impala_sql_compat(spark, d):
    name = f"millrace_{uuid4().hex}"
    files.write_table(load(spark, d, "orders").select("o_orderkey", "o_custkey"), name, "overwrite", path=scratch_path(spark, "stats"))
    described = table_stats(spark, name).filter("col_name = 'Statistics'")
    rows = described.select(F.regexp_extract("data_type", r"(\d+) rows", 1).alias("n")).scalar()
    return string_agg(load(spark, d, "nation"), ["n_regionkey"], "n_name", "; ", order="n_nationkey").withColumn("analyzed_rows", rows)
