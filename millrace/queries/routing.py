"""Projections, routing and validation of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import project as P
from millrace.operators import route as RT
from millrace.operators import text as X
from millrace.operators.joins import lookup
from millrace.queries.base import Registry
from millrace.runtime import load
from millrace.spec import ColumnSpec

R = Registry()


@R.add(
    "update_columns",
    "SELECT o_orderkey, o_custkey, upper(o_orderstatus) AS o_orderstatus, o_totalprice * 2 AS gross_total, 'web' AS source_system FROM orders",
)
def update_columns(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changes = {"o_orderstatus": F.upper("o_orderstatus"), "Gross Total": F.col("o_totalprice") * 2, "source.system": F.lit("web")}
    return P.update_columns(df, changes).drop("o_totalprice")


@R.add(
    "update_record",
    "SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 100::DOUBLE AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side FROM customer",
)
def update_record(spark, d):
    df = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return P.update_columns(df, {"c_name": "upper(c_name)", "c_acctbal": "c_acctbal + 100D", "side": "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END"})


ROUTES = {"big": "value > 50", "sale": "event_type = 'purchase'", "everything": "true", "nothing": "false"}


@R.add(
    "route_on_attribute",
    """SELECT event_id, 'big' AS route FROM events WHERE value > 50 UNION ALL SELECT event_id, 'sale' FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT event_id, 'unmatched' FROM events WHERE NOT (value > 50) AND event_type <> 'purchase'""",
)
def route_on_attribute(spark, d):
    df = load(spark, d, "events")
    return RT.route(df, {k: ROUTES[k] for k in ("big", "sale")}).select("event_id", "route")


@R.add(
    "route_first_match",
    "SELECT event_id, CASE WHEN value > 50 THEN 'big' WHEN event_type = 'purchase' THEN 'sale' ELSE 'everything' END AS route FROM events",
)
def route_first_match(spark, d):
    return RT.route(load(spark, d, "events"), ROUTES, mode="first").select("event_id", "route")


@R.add(
    "route_on_content",
    """SELECT doc_id, 'mail' AS route FROM documents WHERE regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') UNION ALL
    SELECT doc_id, 'number' FROM documents WHERE regexp_matches(text, '[0-9]{3,}') UNION ALL
    SELECT doc_id, 'unmatched' FROM documents WHERE NOT regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') AND NOT regexp_matches(text, '[0-9]{3,}')""",
)
def route_on_content(spark, d):
    df = load(spark, d, "documents").select("doc_id", "text")
    return RT.route_regex(df, "text", {"mail": "[a-z0-9.]+@[a-z0-9.]+", "number": "[0-9]{3,}"}).select("doc_id", "route")


@R.add(
    "route_by_mime",
    """WITH t AS (SELECT event_id AS id, props AS body FROM events UNION ALL SELECT page_id, html FROM pages
      UNION ALL SELECT c_custkey, c_custkey || ',' || c_name FROM customer UNION ALL SELECT p_partkey, p_name FROM part)
    SELECT route, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(body, '^\\s*[{\\[]') THEN 'json' WHEN regexp_matches(body, '^\\s*<') THEN 'xml'
      WHEN contains(body, ',') THEN 'csv' ELSE 'unmatched' END AS route FROM t) GROUP BY route""".replace("\\\\", "\\"),
)
def route_by_mime(spark, d):
    body = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("body"))
    body = body.unionAll(load(spark, d, "pages").select("page_id", "html"))
    body = body.unionAll(load(spark, d, "customer").select("c_custkey", F.concat_ws(",", "c_custkey", "c_name")))
    body = body.unionAll(load(spark, d, "part").select("p_partkey", "p_name"))
    return RT.route_mime(body, "body").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "route_text",
    r"""SELECT doc_id, CASE WHEN regexp_matches(line, '[0-9]') THEN 'digits' ELSE 'unmatched' END AS route, count(*) AS lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY ALL""",
)
def route_text(spark, d):
    lines = X.split_rows(load(spark, d, "documents").select("doc_id", "text"), "text", name="line")
    return RT.route_regex(lines, "line", {"digits": "[0-9]"}).groupBy("doc_id", "route").agg(F.count(F.lit(1)).alias("lines"))


@R.add("scan_content", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')")
def scan_content(spark, d):
    return RT.scan(load(spark, d, "documents"), "text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+").select("doc_id", "lang")


VALID = {"has_price": "o_totalprice > 1000", "known_status": "o_orderstatus IN ('O', 'F')", "recent": "o_orderdate >= DATE '1995-01-01'"}


@R.add(
    "validate_record_split",
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT (o_totalprice > 1000) THEN 'has_price' END,
    CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'known_status' END, CASE WHEN o_orderdate < DATE '1995-01-01' THEN 'recent' END], lambda x: x IS NOT NULL), ',') AS failed FROM orders""",
)
def validate_record_split(spark, d):
    good, bad = RT.split_valid(load(spark, d, "orders"), VALID)
    good = good.select("o_orderkey", F.lit("").alias("failed"))
    return good.unionByName(bad.select("o_orderkey", F.array_join("_failed_rules", ",").alias("failed")))


@R.add(
    "relationship_routing",
    """SELECT 'big' AS target, count(*) AS n, max(event_id) AS last_id FROM events WHERE value > 50
    UNION ALL SELECT 'small', count(*), max(event_id) FROM events WHERE value <= 10
    UNION ALL SELECT 'unmatched', count(*), max(event_id) FROM events WHERE value > 10 AND value <= 50""",
)
def relationship_routing(spark, d):
    routed = RT.route(load(spark, d, "events"), {"big": "value > 50", "small": "value <= 10"})
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")).withColumn("target", F.lit(name))
        for name, df in RT.branch(routed, ["big", "small"]).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add("distribute_load", "SELECT (o_orderkey % 7)::INT AS bucket, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1")
def distribute_load(spark, d):
    return RT.distribute(load(spark, d, "orders"), 7, "o_orderkey").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


@R.add("partition_records", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def partition_records(spark, d):
    spread = RT.partition_by(load(spark, d, "events").select("event_id", "event_type"), "event_type", salts=16)
    parts = spread.groupBy("event_type", F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"))


@R.add(
    "threshold_alerts",
    """SELECT event_id, k, CASE WHEN k > 90 OR value > 95 THEN 'alert' ELSE 'normal' END AS route,
    CASE WHEN k > 90 OR value > 95 THEN c_mktsegment END AS segment
    FROM (SELECT event_id, user_id, value, json_extract_string(props, '$.k')::INT AS k FROM events) LEFT JOIN customer ON user_id = c_custkey""",
)
def threshold_alerts(spark, d):
    events = X.json_paths(load(spark, d, "events"), "props", {"k": "$.k"}).withColumn("k", F.col("k").cast("int"))
    routed = RT.route(events, {"alert": "k > 90 OR value > 95", "normal": "true"}, mode="first")
    # one pass: only alerts carry a lookup key
    keyed = routed.withColumn("c_custkey", F.when(F.col("route") == "alert", F.col("user_id")))
    out = lookup(keyed, load(spark, d, "customer"), ["c_custkey"], ["c_mktsegment"])
    return out.select("event_id", "k", "route", F.col("c_mktsegment").alias("segment"))


SPEC = [
    ColumnSpec("c_custkey", "bigint", nullable=False),
    ColumnSpec("c_acctbal", "decimal(12,2)"),
    ColumnSpec("c_nationkey", "string"),
    ColumnSpec("c_phone", "varchar(20)"),
    ColumnSpec("c_since", "date", nullable=False),
    ColumnSpec("c_mktsegment", "int"),
]


@R.add(
    "schema_enforce",
    """SELECT c_custkey, c_acctbal::DECIMAL(12,2) AS c_acctbal, c_nationkey::VARCHAR AS c_nationkey, NULL::VARCHAR AS c_phone,
    DATE '1970-01-01' AS c_since, TRY_CAST(c_mktsegment AS INT) AS c_mktsegment, c_name FROM customer""",
)
def schema_enforce(spark, d):
    return P.enforce(load(spark, d, "customer"), SPEC)


@R.add(
    "not_null_defaults",
    """SELECT event_id, coalesce(CASE WHEN value > 50 THEN value END, 0.0) AS value, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, '') AS event_type,
    coalesce(CASE WHEN event_id % 3 <> 0 THEN ts END, TIMESTAMP '1970-01-01') AS ts, false AS flag, 0 AS extra FROM events""",
)
def not_null_defaults(spark, d):
    holes = load(spark, d, "events").select(
        "event_id", F.expr("CASE WHEN value > 50 THEN value END AS value"), F.expr("CASE WHEN event_type <> 'view' THEN event_type END AS event_type"),
        F.expr("CASE WHEN event_id % 3 <> 0 THEN ts END AS ts"),
    )
    kinds = {"event_id": "bigint", "value": "double", "event_type": "string", "ts": "timestamp_ntz", "flag": "boolean", "extra": "int"}
    return P.enforce(holes, [ColumnSpec(n, t, nullable=False) for n, t in kinds.items()])


@R.add(
    "record_restructure",
    """SELECT c_custkey AS id, upper(c_name) AS full_name, 'none' AS phone, c_nationkey AS nation, c_mktsegment AS segment FROM customer""",
)
def record_restructure(spark, d):
    out = P.restructure(
        load(spark, d, "customer"), shift={"c_custkey": "id", "c_name": "full_name", "c_nationkey": "place.nation", "c_mktsegment": "place.segment"},
        default={"phone": "none"}, remove=["c_acctbal"], modify={"c_name": "upper(c_name)"},
    )
    return out.select("id", "full_name", "phone", "place.nation", "place.segment")


@R.add(
    "attributes_to_json",
    """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS _json FROM nation
    UNION ALL SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' FROM orders""",
)
def attributes_to_json(spark, d):
    nation = P.to_json_column(load(spark, d, "nation")).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "_json")
    return nation.unionAll(P.to_json_column(load(spark, d, "orders"), ["o_orderkey", "o_orderpriority"]).select("o_orderkey", "_json"))


@R.add(
    "attributes_to_csv",
    "SELECT o_orderkey, o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',' || o_orderpriority AS _csv FROM orders",
)
def attributes_to_csv(spark, d):
    out = P.to_csv_column(load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return out.select("o_orderkey", "_csv")


@R.add("processed_stamp", "SELECT event_id, 'sensor' AS _source, true AS stamped FROM events")
def processed_stamp(spark, d):
    out = P.stamp(load(spark, d, "events"), "sensor")
    return out.select("event_id", "_source", F.col("_processed_at").isNotNull().alias("stamped"))


@R.add(
    "dead_letter_sink",
    """SELECT 'orders' AS _source, 'no price' AS _error, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS _record
    FROM orders WHERE o_orderstatus = 'P'""",
)
def dead_letter_sink(spark, d):
    from millrace.runtime import scratch_path

    bad = load(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")
    path = scratch_path(spark, "dead-letter")
    RT.to_dead_letter(bad, "no price", "orders").write.mode("append").parquet(path)
    return spark.read.parquet(path).drop("_rejected_at")
