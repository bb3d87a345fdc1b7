"""Comparison with specifications, distances and confidence scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans import blueprint as B
from millrace.plans import profile as P
from millrace.plans import validate as V
from millrace.queries.base import Registry
from millrace.queries.profiling import _column_list
from millrace.queries.synthesis import _order_spec
from millrace.runtime import load, scratch_path
from millrace.spec import Blueprint

R = Registry()

COMPARE = """WITH l AS (SELECT 't' || o_custkey AS t, 'c' || (o_orderkey % 5) AS c, o_orderdate < TIMESTAMP '1996-01-01' AS old, CASE WHEN o_totalprice > 250000 THEN 'double' ELSE 'decimal' END AS k FROM orders),
  j AS (SELECT coalesce(a.t, b.t) AS table_name, coalesce(a.c, b.c) AS column_name, a.k AS expected_type, b.k AS actual_type,
    CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.k <> b.k THEN 'type_mismatch' ELSE 'match' END AS status
    FROM (SELECT t, c, max(k) AS k FROM l WHERE old GROUP BY t, c) a FULL JOIN (SELECT t, c, max(k) AS k FROM l WHERE NOT old GROUP BY t, c) b ON a.t = b.t AND a.c = b.c)"""


def _comparison(spark, d):
    orders = load(spark, d, "orders")
    old = _column_list(orders, "o_orderdate < timestamp_ntz '1996-01-01'")
    return V.compare_columns(old, _column_list(orders, "o_orderdate >= timestamp_ntz '1996-01-01'"), ("table_name", "column_name"))


@R.add("schema_compare", f"{COMPARE} SELECT * FROM j")
def schema_compare(spark, d):
    return _comparison(spark, d)


@R.add(
    "schema_score",
    f"""{COMPARE}, n AS (SELECT table_name, count(*) FILTER (status = 'match') AS matched, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra,
      count(*) FILTER (status = 'type_mismatch') AS type_mismatches FROM j GROUP BY table_name)
    SELECT *, CASE WHEN matched + missing + type_mismatches = 0 THEN 1.0::DOUBLE ELSE matched / (matched + missing + type_mismatches)::DOUBLE END AS score FROM n""",
)
def schema_score(spark, d):
    return V.schema_score(_comparison(spark, d), ("table_name",))


CHECKED = {"o_orderkey": True, "o_custkey": True, "o_totalprice": True, "o_orderstatus": False, "o_orderpriority": False}


def _number(c: str, number: bool, expr: str) -> str:
    return expr.replace("{c}", c) if number else "NULL"


FIDELITY = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, abs(an - en) <= 0.01 AS null_ratio_ok, least(ad, g) / greatest(ad, g, 1) >= 0.5 AS cardinality_ok,
    {'alo >= elo AND ahi <= ehi' if num else 'NULL::BOOLEAN'} AS range_ok, {'abs(am - em) / greatest(abs(em), 1) <= 0.2' if num else 'NULL::BOOLEAN'} AS mean_ok
    FROM (SELECT (count(*) - count({c})) / count(*)::DOUBLE AS en, CASE WHEN count(DISTINCT {c}) >= count(*) * 0.99 THEN count(DISTINCT {c}) * 0.5::DOUBLE ELSE count(DISTINCT {c})::DOUBLE END AS g,
      {f'min({c}) AS elo, max({c}) AS ehi, avg({c}) AS em' if num else '0 AS elo'} FROM orders),
    (SELECT (count(*) - count({c})) / count(*)::DOUBLE AS an, count(DISTINCT {c})::DOUBLE AS ad, {f'min({c}) AS alo, max({c}) AS ahi, avg({c}) AS am' if num else '0 AS alo'}
      FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END AS o_custkey, o_totalprice * 1.5 AS o_totalprice, o_orderstatus, 'x' AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0))"""
    for c, num in CHECKED.items()
)
FIDELITY_SCORED = f"""SELECT *, (coalesce(null_ratio_ok, false)::INT + coalesce(cardinality_ok, false)::INT + coalesce(range_ok, false)::INT + coalesce(mean_ok, false)::INT)
  / ((null_ratio_ok IS NOT NULL)::INT + (cardinality_ok IS NOT NULL)::INT + (range_ok IS NOT NULL)::INT + (mean_ok IS NOT NULL)::INT)::DOUBLE AS score FROM ({FIDELITY})"""


def _fidelity(spark, d):
    orders = load(spark, d, "orders")
    actual = orders.filter("o_orderkey % 2 = 0").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END AS o_custkey", "o_totalprice * 1.5D AS o_totalprice", "o_orderstatus", "'x' AS o_orderpriority"
    )
    cols = list(CHECKED)
    return V.fidelity_columns(P.exact_statistics(orders, cols), P.exact_statistics(actual, cols), 0.5), orders, actual


@R.add("fidelity_columns", FIDELITY_SCORED)
def fidelity_columns(spark, d):
    return _fidelity(spark, d)[0].drop("actual_rows")


@R.add(
    "fidelity_table",
    f"""SELECT e AS expected_rows, a AS actual_rows, abs(a - e) / e::DOUBLE <= 0.05 AS row_count_match, round(s, 6) AS column_score,
    round(CASE WHEN abs(a - e) / e::DOUBLE <= 0.05 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END + s * 0.8, 6) AS overall_score
    FROM (SELECT avg(score) AS s, (SELECT count(*) // 2 FROM orders) AS e, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS a FROM ({FIDELITY_SCORED}))""",
)
def fidelity_table(spark, d):
    columns, orders, _ = _fidelity(spark, d)
    want = F.floor(orders.agg(F.count(F.lit(1)).alias("n")).scalar() / 2)
    out = V.fidelity_table(columns, want)
    return out.withColumns({"column_score": F.round("column_score", 6), "overall_score": F.round("overall_score", 6)})


@R.add(
    "ks_distance",
    """WITH c AS (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'N') AS nb FROM lineitem GROUP BY 1),
    r AS (SELECT sum(na) OVER (ORDER BY v) AS ca, sum(nb) OVER (ORDER BY v) AS cb, sum(na) OVER () AS ta, sum(nb) OVER () AS tb FROM c)
    SELECT round(max(abs(ca / ta::DOUBLE - cb / tb::DOUBLE)), 10) AS ks, max(ca)::BIGINT AS n_a, max(cb)::BIGINT AS n_b FROM r""",
)
def ks_distance(spark, d):
    line = load(spark, d, "lineitem")
    out = V.ks_distance(line.filter("l_returnflag = 'A'"), line.filter("l_returnflag = 'N'"), "l_extendedprice")
    return out.withColumn("ks", F.round("ks", 10))


@R.add(
    "category_distance",
    """SELECT round(sum(abs(coalesce(a, 0) - coalesce(b, 0))) / 2, 10) AS total_variation FROM
    (SELECT event_type, count(*) FILTER (event_id % 3 = 0) / (SELECT count(*) FROM events WHERE event_id % 3 = 0)::DOUBLE AS a,
      count(*) FILTER (value > 20) / (SELECT count(*) FROM events WHERE value > 20)::DOUBLE AS b FROM events GROUP BY event_type)""",
)
def category_distance(spark, d):
    events = load(spark, d, "events")
    out = V.category_distance(events.filter("event_id % 3 = 0"), events.filter("value > 20"), "event_type")
    return out.withColumn("total_variation", F.round("total_variation", 10))


DIMS = """(SELECT c_mktsegment || '-' || c_nationkey AS table_name, CASE WHEN c_nationkey % 4 > 0 THEN round(avg((c_acctbal > 0)::INT), 6) END AS schema_score,
  round(avg((c_custkey % 3 <> 0)::INT), 6) AS fidelity_score, CASE WHEN c_nationkey <> 7 THEN count(*) FILTER (c_acctbal < 500) END AS violations, c_nationkey % 5 > 0 AS layers_ok
  FROM customer GROUP BY c_mktsegment, c_nationkey)"""
SCORES = f"""SELECT table_name, coalesce(schema_score, 1) * 0.25 + coalesce(fidelity_score, 1) * 0.35 + CASE WHEN violations IS NULL THEN 1 WHEN violations >= 10 THEN 0 ELSE 1 - violations * 0.1::DOUBLE END * 0.2
  + CASE WHEN layers_ok THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS s, schema_score, fidelity_score, violations, layers_ok FROM {DIMS}"""
LEVEL = "CASE WHEN {s} >= 0.9 THEN 'green' WHEN {s} >= 0.7 THEN 'amber' ELSE 'red' END"


def _dims(spark, d):
    groups = load(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.round(F.avg((F.col("c_acctbal") > 0).cast("int")), 6).alias("schema_score"), F.round(F.avg((F.col("c_custkey") % 3 != 0).cast("int")), 6).alias("fidelity_score"),
        F.count_if(F.col("c_acctbal") < 500).alias("violations"),
    )
    nation = F.col("c_nationkey")
    return groups.select(
        F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("table_name"), F.when(nation % 4 > 0, F.col("schema_score")).alias("schema_score"), "fidelity_score",
        F.when(nation != 7, F.col("violations")).alias("violations"), (nation % 5 > 0).alias("layers_ok"),
    )


@R.add(
    "confidence_table",
    f"""SELECT table_name, round(s, 4) AS overall_score, {LEVEL.format(s='s')} AS level, (coalesce(schema_score < 1, false)::INT + (fidelity_score < 1)::INT
    + coalesce(violations > 0, false)::INT + (NOT layers_ok)::INT) AS advice FROM ({SCORES})""",
)
def confidence_table(spark, d):
    return V.score_tables(_dims(spark, d)).withColumn("advice", F.size("recommendations")).drop("recommendations")


@R.add(
    "confidence_workspace",
    f"""SELECT round(m, 4) AS overall_score, {LEVEL.format(s='m')} AS level, n AS tables, g AS green, a AS amber, r AS red,
    n || ' tables validated: ' || g || ' green, ' || a || ' amber, ' || r || ' red. Overall confidence: ' || printf('%.1f', m * 100) || '% (' || {LEVEL.format(s='m')} || ')' AS summary
    FROM (SELECT avg(round(s, 4)) AS m, count(*) AS n, count(*) FILTER (s >= 0.9) AS g, count(*) FILTER (s >= 0.7 AND s < 0.9) AS a, count(*) FILTER (s < 0.7) AS r FROM ({SCORES}))""",
)
def confidence_workspace(spark, d):
    return V.score_workspace(V.score_tables(_dims(spark, d)))


@R.add(
    "validation_report",
    "SELECT 'ws-1' AS workspace_id, 1.0::DOUBLE AS overall_score, 'green' AS level, '2 tables validated: 2 green, 0 amber, 0 red. Overall confidence: 100.0% (green)' AS summary, 2 AS tables, count(*) AS customers FROM customer",
)
def validation_report(spark, d):
    tables = {t: load(spark, d, t) for t in ("customer", "supplier")}
    specs = [B.to_table_spec(t, P.profile(df, k=1)) for t, df in tables.items()]
    scores, workspace = V.validate(spark, Blueprint("bp", specs), tables)
    path = scratch_path(spark, "reports")
    V.save_report(scores, workspace, path, "ws-1")
    n = tables["customer"].agg(F.count(F.lit(1)).alias("n")).scalar()
    listed = F.size(F.from_json("tables_json", "array<struct<table_name string>>"))
    return spark.read.parquet(path).select("workspace_id", "overall_score", "level", "summary", listed.alias("tables"), n.alias("customers"))


@R.add(
    "parallel_workstreams",
    """SELECT 'fast' AS workstream, 'customer' AS table_name, count(*) // 10 AS gold_rows FROM customer UNION ALL SELECT 'full', 'customer', count(*) // 2 FROM customer
    UNION ALL SELECT 'full', 'orders', count(*) // 2 FROM orders""",
)
def parallel_workstreams(spark, d):
    _, bp = _order_spec(spark, d)
    streams = [{"name": "full", "scale": 0.5, "priority": 1}, {"name": "fast", "tables": ["customer"], "scale": 0.1, "priority": 0}]
    done = V.run_workstreams(spark, bp, streams, scratch_path(spark, "workstreams"))
    rows = [(name, t, n) for name, r in done.items() for t, n in r["run"].rows["gold"].items()]
    return spark.createDataFrame(rows, "workstream string, table_name string, gold_rows bigint")
