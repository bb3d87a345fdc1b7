"""Profiles and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregate as A
from millrace.plans import profile as P
from millrace.queries.base import Registry
from millrace.runtime import load, scratch_path

R = Registry()

LINE_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_NUMBERS = LINE_COLS[:8]


def union_sql(template: str, names: list[str]) -> str:
    return "\nUNION ALL\n".join(template.replace("{c}", n) for n in names)


@R.add(
    "profile_basic",
    union_sql(
        """SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
        (count(*) - count({c})) / count(*)::DOUBLE AS null_ratio, count(DISTINCT {c}) AS distinct_count FROM lineitem""",
        LINE_COLS,
    ),
)
def profile_basic(spark, d):
    out = P.exact_statistics(load(spark, d, "lineitem"))
    return out.select("column_name", "row_count", "non_null_count", "null_count", "null_ratio", "distinct_count")


@R.add(
    "profile_numeric",
    union_sql(
        """SELECT '{c}' AS column_name, min({c})::DOUBLE AS min_number, max({c})::DOUBLE AS max_number, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS stddev FROM lineitem""",
        LINE_NUMBERS,
    ),
)
def profile_numeric(spark, d):
    out = P.statistics(load(spark, d, "lineitem"), LINE_NUMBERS, accuracy=0, distinct=False)
    return out.select("column_name", "min_number", "max_number", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))


@R.add(
    "profile_percentiles",
    union_sql(
        """SELECT '{c}' AS column_name, p::DOUBLE AS probability, max(v) FILTER (r = ceil(p * n)) AS value
        FROM (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM lineitem),
        (VALUES (0.25), (0.5), (0.75), (0.95), (0.99)) AS q(p) GROUP BY p""",
        LINE_NUMBERS,
    ),
)
def profile_percentiles(spark, d):
    return P.exact_percentiles(load(spark, d, "lineitem"), LINE_NUMBERS)


@R.add(
    "profile_string",
    union_sql("SELECT '{c}' AS column_name, min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length FROM documents", ["text", "lang", "source"]),
)
def profile_string(spark, d):
    out = P.statistics(load(spark, d, "documents"), ["text", "lang", "source"], accuracy=0, distinct=False)
    return out.select("column_name", "min_length", "max_length")


@R.add(
    "profile_date",
    """SELECT 'o_orderdate' AS column_name, min(o_orderdate) AS min_time, max(o_orderdate) AS max_time FROM orders
    UNION ALL SELECT 'l_shipdate', min(l_shipdate), max(l_shipdate) FROM lineitem
    UNION ALL SELECT 'ts', min(ts), max(ts) FROM events""",
)
def profile_date(spark, d):
    parts = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]
    out = None
    for t, c in parts:
        one = P.statistics(load(spark, d, t), [c], accuracy=0, distinct=False)
        out = one if out is None else out.unionByName(one)
    return out.select("column_name", F.to_timestamp_ntz("min_value").alias("min_time"), F.to_timestamp_ntz("max_value").alias("max_time"))


TOP_COLS = ["l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@R.add(
    "top_values",
    "SELECT column_name, rank::INT AS rank, value, n, round(n / (SELECT count(*) FROM lineitem)::DOUBLE, 8) AS frequency FROM ("
    + union_sql(
        "SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS rank FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}",
        TOP_COLS,
    )
    + ") WHERE rank <= 20",
)
def top_values(spark, d):
    return P.top_values(load(spark, d, "lineitem"), 20, TOP_COLS).withColumn("frequency", F.round("frequency", 8))


@R.add(
    "top_long_values",
    """SELECT rank::INT AS rank, n, copies_of, is_text FROM (SELECT row_number() OVER (ORDER BY n DESC, v) AS rank, n, md5(t) AS copies_of, length(t) > 256 AS is_text
    FROM (SELECT CASE WHEN length(text) > 256 THEN sha256(text) ELSE text END AS v, any_value(text) AS t, count(*) AS n FROM documents GROUP BY 1)) WHERE rank <= 20""",
)
def top_long_values(spark, d):
    out = P.top_values(load(spark, d, "documents"), 20, ["text"])
    return out.select("rank", "n", F.md5("value").alias("copies_of"), (F.length("value") > 256).alias("is_text"))


@R.add(
    "pattern_detect",
    r"""WITH t AS (SELECT lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_nationkey)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS tax_no,
      lpad(c_custkey::VARCHAR, 5, '0') AS zip, 'NA' || c_nationkey AS area, c_name, lower(replace(c_name, '#', '.')) || '@example.com' AS mail FROM customer),
    c AS (SELECT 'tax_no' AS column_name, tax_no AS v FROM t UNION ALL SELECT 'zip', zip FROM t UNION ALL SELECT 'area', area FROM t
      UNION ALL SELECT 'c_name', c_name FROM t UNION ALL SELECT 'mail', mail FROM t)
    SELECT column_name, CASE WHEN bool_and(regexp_matches(v, '^\d{3}-\d{2}-\d{4}$')) THEN '\d{3}-\d{2}-\d{4}'
      WHEN bool_and(regexp_matches(v, '^\d{5}(-\d{4})?$')) THEN '\d{5}(-\d{4})?'
      WHEN bool_and(regexp_matches(v, '^[A-Z]{2}\d+$')) THEN '[A-Z]{2}\d+'
      WHEN bool_and(regexp_matches(v, '^\d{4}-\d{2}-\d{2}$')) THEN '\d{4}-\d{2}-\d{2}'
      WHEN bool_and(regexp_matches(v, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+$')) THEN '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+' END AS pattern
    FROM c GROUP BY column_name""",
)
def pattern_detect(spark, d):
    c = load(spark, d, "customer")
    key, text = F.col("c_custkey"), lambda x, n: F.lpad(x.cast("string"), n, "0")
    derived = c.select(
        F.concat_ws("-", text(key % 1000, 3), text(F.col("c_nationkey"), 2), text(key % 10000, 4)).alias("tax_no"),
        text(key, 5).alias("zip"), F.concat(F.lit("NA"), F.col("c_nationkey")).alias("area"), "c_name",
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("mail"),
    )
    return P.detect_patterns(derived, derived.columns)


ORDER_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_TEXT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]
SUMMARY_SQL = (
    union_sql(
        """SELECT '{c}' AS column_name, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, round(min({c})::DOUBLE, 4) AS min,
        round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev,
        NULL::BIGINT AS distinct_values, NULL::VARCHAR AS top_values FROM orders""",
        ORDER_NUM,
    )
    + "\nUNION ALL\n"
    + union_sql(
        """SELECT '{c}', count({c}), count(*) - count({c}), NULL, NULL, NULL, NULL, count(DISTINCT {c}),
        (SELECT string_agg(v || '(' || n || ')', ', ' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 5))
        FROM orders""",
        ORDER_TEXT,
    )
)


@R.add("gold_column_summary", SUMMARY_SQL)
def gold_column_summary(spark, d):
    return P.column_summary(load(spark, d, "orders"))


@R.add(
    "group_sum_count",
    """SELECT r_name, p_brand, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1998-01-01' GROUP BY r_name, p_brand""",
)
def group_sum_count(spark, d):
    line = load(spark, d, "lineitem").filter("l_shipdate >= date '1998-01-01'")
    joined = (
        line.join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    out = A.group_sum_count(joined, ["r_name", "p_brand"], "l_extendedprice")
    return out.withColumn("total", F.round("total", 2))


@R.add(
    "row_count_column",
    "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS row_count FROM orders",
)
def row_count_column(spark, d):
    return A.with_row_count(load(spark, d, "orders").select("o_orderkey", "o_custkey"))


@R.add("observed_counter", "SELECT count(*) AS rows, sum(l_linenumber)::BIGINT AS lines FROM lineitem")
def observed_counter(spark, d):
    df, seen = A.counted(load(spark, d, "lineitem"), "lines_seen", lines=F.sum("l_linenumber"))
    df.select("l_orderkey", "l_linenumber").write.parquet(scratch_path(spark, "observed"))
    return spark.createDataFrame([(seen.get["rows"], seen.get["lines"])], "rows bigint, lines bigint")


LOG_SQL = """(SELECT split_part(o_orderpriority, '-', 2) AS role, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' ELSE 'RECOVERED' END AS status,
 o_custkey AS rows_processed FROM orders)"""
REPORT_COLS = """count(*) AS steps, count(*) FILTER (status = 'SUCCESS') AS successes, count(*) FILTER (status = 'FAILED') AS failures,
 count(*) FILTER (status IN ('RECOVERED', 'PASSTHROUGH', 'DLQ')) AS recovered, sum(rows_processed)::BIGINT AS rows_processed,
 round(count(*) FILTER (status = 'SUCCESS') * 100.0::DOUBLE / count(*), 1) AS success_rate"""


@R.add("execution_report", f"SELECT role, {REPORT_COLS} FROM {LOG_SQL} GROUP BY role UNION ALL SELECT 'all', {REPORT_COLS} FROM {LOG_SQL}")
def execution_report(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RECOVERED")
    log = load(spark, d, "orders").select(
        F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("role"), status.alias("status"), F.col("o_custkey").alias("rows_processed")
    )
    return A.execution_report(log, ["role"]).unionByName(A.execution_report(log).withColumn("role", F.lit("all")))


@R.add(
    "data_retention",
    """SELECT s AS source_rows, k AS sink_rows, round(k * 100.0::DOUBLE / s, 1) AS data_retention_pct FROM
    (SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS s, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS k)""",
)
def data_retention(spark, d):
    orders = load(spark, d, "orders")
    return A.retention([orders, load(spark, d, "customer")], [orders.filter("o_orderstatus <> 'P'")])


@R.add(
    "concat_agg",
    "SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS joined FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id",
)
def concat_agg(spark, d):
    return A.string_agg(load(spark, d, "events"), ["user_id"], "event_type", ",", distinct=True)


@R.add(
    "distinct_agg",
    "SELECT l_suppkey, count(DISTINCT l_partkey) AS distinct_count FROM lineitem GROUP BY l_suppkey",
)
def distinct_agg(spark, d):
    return A.distinct_per_group(load(spark, d, "lineitem"), ["l_suppkey"], "l_partkey")


@R.add(
    "crawl_totals",
    """SELECT 'warehouse' AS source, 4::BIGINT AS total_tables, (6 + 11 + 5 + 4)::BIGINT AS total_columns,
    (SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)) AS total_rows""",
)
def crawl_totals(spark, d):
    from millrace.plans.blueprint import crawl_tables

    tables = {t: load(spark, d, t) for t in ("orders", "lineitem", "customer", "supplier")}
    return A.crawl_totals(crawl_tables(tables, "warehouse"))
