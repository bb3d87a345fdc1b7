"""Quality rules and layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans import layers as L
from millrace.plans import quality as Q
from millrace.queries.base import Registry
from millrace.runtime import load, scratch_path
from millrace.spec import Blueprint, ColumnSpec, TableSpec

R = Registry()


def _ratio(bad: str, table: str) -> str:
    return f"SELECT count(*) FILTER (NOT coalesce({bad}, false)) AS v, count(*) AS n FROM {table}"


def violations_sql(table: str, rules: list[tuple[str, str, str]], layer: str = "silver") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS rule, '{table}' AS table_name, '{layer}' AS layer, '{a}' AS action, v AS violating_rows, n AS total_rows, round(v / n::DOUBLE, 4) AS violation_ratio FROM ({_ratio(p, table)})"
        for n, a, p in rules
    )


PREDICATES = [
    ("price", "drop", "o_totalprice >= 5000"),
    ("status", "warn", "o_orderstatus IN ('O', 'F')"),
    ("early", "drop", "CASE WHEN o_custkey % 10 <> 0 THEN o_orderdate < TIMESTAMP '1999-01-01' END"),
]


def _rules():
    return [Q.Rule(n, p.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), a) for n, a, p in PREDICATES]


@R.add("expectations", violations_sql("orders", PREDICATES))
def expectations(spark, d):
    return Q.apply_rules(load(spark, d, "orders"), _rules(), "orders")[1]


@R.add("expectations_kept", "SELECT o_orderkey FROM orders WHERE coalesce(o_totalprice >= 5000, false) AND coalesce(CASE WHEN o_custkey % 10 <> 0 THEN o_orderdate < TIMESTAMP '1999-01-01' END, false)")
def expectations_kept(spark, d):
    return Q.apply_rules(load(spark, d, "orders"), _rules(), "orders")[0].select("o_orderkey")


def _events_holes(spark, d):
    return load(spark, d, "events").selectExpr("event_id", "user_id", "CASE WHEN event_id % 7 <> 0 THEN value END AS value", "event_type")


HOLES = "(SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, event_type FROM events) AS holes"


def _holes_sql(rule: str, predicate: str) -> str:
    return f"SELECT '{rule}' AS rule, v AS violating_rows, n AS total_rows FROM (SELECT count(*) FILTER (NOT coalesce({predicate}, false)) AS v, count(*) AS n FROM {HOLES})"


@R.add("expect_not_null", _holes_sql("value_not_null", "value IS NOT NULL"))
def expect_not_null(spark, d):
    return Q.violations(_events_holes(spark, d), [Q.not_null("value")]).select("rule", "violating_rows", "total_rows")


@R.add("expect_range", _holes_sql("value_range", "value >= 5 AND value <= 80"))
def expect_range(spark, d):
    return Q.violations(_events_holes(spark, d), [Q.in_range("value", 5, 80)]).select("rule", "violating_rows", "total_rows")


@R.add("expect_in_set", _holes_sql("event_type_accepted", "event_type IN ('click', 'view', 'purchase')"))
def expect_in_set(spark, d):
    return Q.violations(_events_holes(spark, d), [Q.in_set("event_type", ["click", "view", "purchase"])]).select("rule", "violating_rows", "total_rows")


@R.add(
    "expect_unique",
    "SELECT 'l_orderkey_l_linenumber_unique' AS rule, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS violating_rows, count(*) AS total_rows FROM lineitem",
)
def expect_unique(spark, d):
    return Q.violations(load(spark, d, "lineitem"), [Q.unique(["l_orderkey", "l_linenumber"])]).select("rule", "violating_rows", "total_rows")


@R.add("expect_unique_kept", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber")
def expect_unique_kept(spark, d):
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return Q.keep(df, [Q.unique(["l_orderkey", "l_linenumber"], "drop")], ["l_partkey"])


@R.add("expect_not_all_null", "SELECT value, kind FROM (SELECT CASE WHEN event_id % 4 > 0 THEN value END AS value, CASE WHEN event_id % 2 > 0 THEN event_type END AS kind FROM events) WHERE NOT (value IS NULL AND kind IS NULL)")
def expect_not_all_null(spark, d):
    df = load(spark, d, "events").selectExpr("CASE WHEN event_id % 4 > 0 THEN value END AS value", "CASE WHEN event_id % 2 > 0 THEN event_type END AS kind")
    return Q.keep(df, [Q.not_all_null(df)])


@R.add(
    "expect_relationship",
    "SELECT 'fk_relationship' AS rule, count(*) FILTER (fk IS NOT NULL AND fk NOT IN (SELECT s_suppkey FROM supplier)) AS violating_rows, count(*) AS total_rows FROM (SELECT CASE WHEN l_linenumber > 1 THEN l_suppkey + 5 END AS fk FROM lineitem)",
)
def expect_relationship(spark, d):
    df = load(spark, d, "lineitem").selectExpr("CASE WHEN l_linenumber > 1 THEN l_suppkey + 5 END AS fk")
    return Q.violations(df, [Q.has_parent("fk", load(spark, d, "supplier"), "s_suppkey")]).select("rule", "violating_rows", "total_rows")


@R.add(
    "rules_from_blueprint",
    """SELECT * FROM (SELECT 'customer_c_custkey_not_null' AS rule, count(*) FILTER (c_custkey IS NULL) AS violating_rows, count(*) AS total_rows FROM customer
    UNION ALL SELECT 'customer_c_custkey_unique', count(*) - count(DISTINCT c_custkey), count(*) FROM customer
    UNION ALL SELECT 'customer_c_custkey_range', count(*) FILTER (c_custkey > 1000), count(*) FROM customer
    UNION ALL SELECT 'customer_c_acctbal_range', count(*) FILTER (c_acctbal < 0.5 OR c_acctbal > 5000.25), count(*) FROM customer)""",
)
def rules_from_blueprint(spark, d):
    spec = TableSpec("customer", [ColumnSpec("c_custkey", "bigint", False, True, {"min": 0, "max": 1000}), ColumnSpec("c_acctbal", "double", stats={"min": 0.5, "max": 5000.25}), ColumnSpec("c_name")])
    return Q.violations(load(spark, d, "customer"), Q.rules_for(spec), "customer").select("rule", "violating_rows", "total_rows")


@R.add(
    "quarantine",
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT coalesce(o_totalprice >= 5000, false) THEN 'price' END, CASE WHEN NOT coalesce(o_orderstatus IN ('O', 'F'), false) THEN 'status' END,
    CASE WHEN NOT coalesce(CASE WHEN o_custkey % 10 <> 0 THEN o_orderdate < TIMESTAMP '1999-01-01' END, false) THEN 'early' END], lambda x: x IS NOT NULL), ',') AS failed
    FROM orders WHERE failed <> ''""",
)
def quarantine(spark, d):
    return Q.quarantine(load(spark, d, "orders"), _rules()).select("o_orderkey", F.array_join("_failed_rules", ",").alias("failed"))


@R.add(
    "row_error_capture",
    """SELECT event_id, TRY_CAST(raw AS INT) AS amount, CASE WHEN TRY_CAST(raw AS INT) IS NULL AND raw IS NOT NULL THEN 'amount' ELSE '' END AS errors
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN NULL ELSE user_id::VARCHAR END AS raw FROM events)""",
)
def row_error_capture(spark, d):
    df = load(spark, d, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN NULL ELSE cast(user_id AS string) END AS raw")
    out = Q.try_transform(df, {"amount": ("try_cast(raw AS int)", "raw")})
    return out.select("event_id", "amount", F.array_join("_errors", ",").alias("errors"))


@R.add("violation_summary", f"SELECT table_name, sum(violating_rows)::BIGINT AS violating_rows, count(*) AS rules, round(max(violation_ratio), 4) AS worst FROM ({violations_sql('orders', PREDICATES)}) GROUP BY table_name")
def violation_summary(spark, d):
    found = Q.violations(load(spark, d, "orders"), _rules(), "orders")
    return found.groupBy("table_name").agg(
        F.sum("violating_rows").alias("violating_rows"), F.count(F.lit(1)).alias("rules"), F.round(F.max("violation_ratio"), 4).alias("worst")
    )


@R.add(
    "rules_as_sql",
    """SELECT 'CONSTRAINT price EXPECT (o_totalprice >= 5000) ON VIOLATION DROP ROW' AS clause, count(*) FILTER (o_totalprice < 5000) AS broken FROM orders
    UNION ALL SELECT 'CONSTRAINT status EXPECT (o_orderstatus IN (''O'', ''F''))', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders""",
)
def rules_as_sql(spark, d):
    rules = _rules()[:2]
    clauses = dict(zip([r.name for r in rules], Q.rules_sql(rules)))
    found = Q.violations(load(spark, d, "orders"), rules)
    clause = F.element_at(F.create_map(*[F.lit(x) for kv in clauses.items() for x in kv]), F.col("rule"))
    return found.select(clause.alias("clause"), F.col("violating_rows").alias("broken"))


# --- layers ---
SPEC = TableSpec(
    "orders",
    [
        ColumnSpec("o_orderkey", "bigint", False, True), ColumnSpec("o_custkey", "bigint", False), ColumnSpec("o_orderstatus", "string"),
        ColumnSpec("o_totalprice", "decimal(12,2)", False), ColumnSpec("o_orderdate", "date"), ColumnSpec("o_clerk", "varchar(15)", False),
    ],
)
SILVER_RULES = [Q.Rule("price", "o_totalprice >= 5000", "drop"), Q.Rule("status", "o_orderstatus IN ('O', 'F')", "warn")]


def _bronze(spark, d):
    """Orders with holes: every 50th row is all NULL, every 6th has no price."""
    rows = load(spark, d, "orders").selectExpr(
        *[f"CASE WHEN o_orderkey % 50 <> 0 THEN {c} END AS {c}" for c in ("o_orderkey", "o_custkey", "o_orderstatus")],
        "CASE WHEN o_orderkey % 50 <> 0 AND o_orderkey % 6 <> 0 THEN o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS o_orderdate",
    )
    return L.to_bronze(rows, "shop", "b7")


@R.add(
    "bronze_land",
    """SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 50 <> 0 AND o_orderkey % 6 <> 0 THEN o_totalprice END AS o_totalprice, 'shop' AS _source, 'b7' AS _batch_id, true AS timed FROM orders""",
)
def bronze_land(spark, d):
    return _bronze(spark, d).select("o_orderkey", "o_totalprice", "_source", "_batch_id", F.col("_ingested_at").isNotNull().alias("timed"))


SILVER_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(12,2) AS o_totalprice, o_orderdate::DATE AS o_orderdate, '' AS o_clerk FROM orders
  WHERE o_orderkey % 50 <> 0 AND o_orderkey % 6 <> 0 AND o_totalprice::DECIMAL(12,2) >= 5000"""


@R.add("silver_conform", SILVER_SQL)
def silver_conform(spark, d):
    return L.to_silver(_bronze(spark, d), SPEC, SILVER_RULES)[0].drop("_processed_at")


@R.add(
    "gold_publish",
    f"SELECT o_orderstatus, count(*) AS n, sum(o_totalprice)::DECIMAL(22,2) AS total, true AS published FROM ({SILVER_SQL}) GROUP BY o_orderstatus",
)
def gold_publish(spark, d):
    silver = L.to_silver(_bronze(spark, d), SPEC, SILVER_RULES)[0]
    gold = L.to_gold(silver, ["o_orderstatus"], {"n": F.count(F.lit(1)), "total": F.sum("o_totalprice")})
    return gold.withColumn("published", F.col("_published_at").isNotNull()).drop("_published_at")


@R.add("gold_copy", SILVER_SQL)
def gold_copy(spark, d):
    return L.to_gold(L.to_silver(_bronze(spark, d), SPEC, SILVER_RULES)[0]).drop("_published_at")


@R.add(
    "gold_summary",
    f"""WITH s AS ({SILVER_SQL}) SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS non_null_count, count(*) - count(o_totalprice) AS null_count, round(min(o_totalprice)::DOUBLE, 4) AS min,
    round(max(o_totalprice)::DOUBLE, 4) AS max, round(avg(o_totalprice::DOUBLE), 4) AS mean, NULL::BIGINT AS distinct_values, NULL::VARCHAR AS top_values FROM s
    UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(*) - count(o_orderstatus), NULL, NULL, NULL, count(DISTINCT o_orderstatus),
    (SELECT string_agg(v || '(' || n || ')', ', ' ORDER BY n DESC, v) FROM (SELECT o_orderstatus AS v, count(*) AS n FROM s GROUP BY 1)) FROM s""",
)
def gold_summary(spark, d):
    from millrace.plans.profile import column_summary

    silver = L.to_silver(_bronze(spark, d), SPEC, SILVER_RULES)[0]
    return column_summary(silver.select("o_totalprice", "o_orderstatus")).drop("stddev")


@R.add(
    "silver_clean_stats",
    """SELECT count(*) + count(*) FILTER (o_orderkey % 10 = 3) AS rows_in, count(*) FILTER (o_orderkey % 50 = 0) + count(*) FILTER (o_orderkey % 10 = 3) AS rows_dropped,
    (count(*) FILTER (o_orderkey % 50 <> 0) + count(*) FILTER (o_orderkey % 50 <> 0 AND o_orderkey % 6 = 0))::BIGINT AS nulls_filled FROM orders""",
)
def silver_clean_stats(spark, d):
    bronze = _bronze(spark, d)
    return L.clean_stats(bronze.unionByName(bronze.filter("o_orderkey % 10 = 3")), SPEC.columns)


@R.add(
    "medallion_run",
    f"""SELECT 'bronze' AS layer, 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'silver', 'orders', count(*) FROM ({SILVER_SQL})
    UNION ALL SELECT 'gold', 'orders', count(*) FROM ({SILVER_SQL}) UNION ALL SELECT 'bronze', 'unknown', count(*) FROM nation UNION ALL SELECT 'failed', 'unknown', 1""",
)
def medallion_run(spark, d):
    tables = {"orders": _bronze(spark, d).drop(*L.BRONZE_META), "unknown": load(spark, d, "nation")}
    run = L.run_layers(spark, tables, Blueprint("bp", [SPEC], "shop"), scratch_path(spark, "layers"), SILVER_RULES)
    rows = [(layer, t, n) for layer, counts in run.rows.items() for t, n in counts.items()]
    return spark.createDataFrame(rows + [("failed", t, 1) for t in run.failed], "layer string, table_name string, rows bigint")
