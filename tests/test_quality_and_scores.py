"""Rules, layers, validation and scores."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import route as RT
from millrace.plans import blueprint as B
from millrace.plans import layers as L
from millrace.plans import profile as P
from millrace.plans import quality as Q
from millrace.plans import validate as V
from millrace.spec import Blueprint, ColumnSpec, TableSpec, base_type, spark_type


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a", 10.0), (2, None, 20.0), (2, "c", None), (None, None, None), (4, "d", -5.0)]
    return spark.createDataFrame(rows, "id int, name string, amount double")


def test_rules_see_the_same_input(people):
    rules = [Q.Rule("positive", "amount > 0", "drop"), Q.not_null("name", "drop"), Q.unique(["id"])]
    found = {r["rule"]: (r["violating_rows"], r["total_rows"]) for r in Q.violations(people, rules).collect()}
    assert found == {"positive": (3, 5), "name_not_null": (2, 5), "id_unique": (1, 5)}


def test_null_predicate_is_a_violation_and_drop_keeps_the_rest(people):
    kept, found = Q.apply_rules(people, [Q.Rule("positive", "amount > 0", "drop")])
    assert [r["id"] for r in kept.orderBy("id").collect()] == [1, 2]
    assert found.first()["violation_ratio"] == 0.6


def test_warn_keeps_rows_and_fail_raises(people):
    kept, _ = Q.apply_rules(people, [Q.not_null("name")])
    assert kept.count() == 5
    with pytest.raises(Q.RuleViolation):
        Q.apply_rules(people, [Q.not_null("name", "fail")])


def test_rules_of_other_tables_and_layers_do_not_apply(people):
    rules = [Q.not_null("name", "drop", table="other"), Q.Rule("x", "false", "drop", layer="gold")]
    kept, found = Q.apply_rules(people, rules, "people")
    assert kept.count() == 5 and found.isEmpty()


def test_unique_keeps_the_first(people):
    kept = Q.keep(people, [Q.unique(["id"], "drop")], ["amount"])
    assert kept.filter("id = 2").count() == 1 and kept.count() == 4


def test_rules_sql():
    rules = [Q.not_null("a"), Q.in_range("b", 1, None, "drop"), Q.in_set("c", ["x'y"], "fail")]
    assert Q.rules_sql(rules) == [
        "CONSTRAINT a_not_null EXPECT (`a` IS NOT NULL)",
        "CONSTRAINT b_range EXPECT (`b` >= 1) ON VIOLATION DROP ROW",
        "CONSTRAINT c_accepted EXPECT (`c` IN ('x\\'y')) ON VIOLATION FAIL UPDATE",
    ]


def test_declared_layers_name_the_constraints():
    text = L.declared_layers("orders", [Q.not_null("id", "drop")])
    assert "CONSTRAINT id_not_null EXPECT (`id` IS NOT NULL) ON VIOLATION DROP ROW" in text and text.count("CREATE OR REFRESH") == 3


def test_null_route_is_unmatched(people):
    out = RT.route(people, {"pos": "amount > 0", "named": "name is not null"})
    got = sorted((r["id"] or 0, r["route"]) for r in out.collect())
    assert got == [(0, "unmatched"), (1, "named"), (1, "pos"), (2, "named"), (2, "pos"), (4, "named")]


def test_layers_report_failures(spark, people, tmp_path):
    spec = TableSpec("people", [ColumnSpec("id", "int", False), ColumnSpec("amount", "decimal(8,2)")])
    run = L.run_layers(spark, {"people": people, "ghost": people}, Blueprint("b", [spec]), str(tmp_path))
    assert run.rows["bronze"] == {"people": 5, "ghost": 5} and run.rows["gold"] == {"people": 4}
    assert list(run.failed) == ["ghost"] and not run.success


SCHEMA = "table_name string, schema_score double, fidelity_score double, violations bigint, layers_ok boolean"


def scores(spark, *rows):
    return {r["table_name"]: r for r in V.score_tables(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_confidence(spark):
    out = scores(spark, ("good", 1.0, 1.0, 0, True), ("cols", 0.5, 1.0, 0, True), ("failed", 1.0, 1.0, 0, False), ("many", 1.0, 1.0, 30, True), ("unknown", None, None, None, None))
    assert (out["good"]["overall_score"], out["good"]["level"]) == (1.0, "green")
    assert out["cols"]["overall_score"] == 0.875 and out["cols"]["level"] == "amber"
    assert out["failed"]["overall_score"] == 0.8 and "Layer run failed for this table" in out["failed"]["recommendations"]
    assert out["many"]["overall_score"] == 0.8 and out["unknown"]["overall_score"] == 1.0


def test_workspace(spark):
    tables = spark.createDataFrame([("a", 0.95, "green"), ("b", 0.85, "amber"), ("c", 0.60, "red")], "table_name string, overall_score double, level string")
    row = V.score_workspace(tables).first()
    assert (row["overall_score"], row["level"], row["green"], row["amber"], row["red"]) == (0.8, "amber", 1, 1, 1)
    empty = V.score_workspace(tables.limit(0)).first()
    assert (empty["overall_score"], empty["level"], empty["summary"]) == (0.0, "red", "No tables validated")


def test_schema_score(spark, people):
    same = [ColumnSpec("id", "integer"), ColumnSpec("name", "varchar(20)"), ColumnSpec("amount", "double")]
    assert V.schema_score(V.compare_schema(people, same)).first()["score"] == 1.0
    half = [ColumnSpec("id", "bigint"), ColumnSpec("name"), ColumnSpec("gone"), ColumnSpec("amount", "double")]
    row = V.schema_score(V.compare_schema(people.withColumn("_meta", F.lit(1)), half)).first()
    assert (row["matched"], row["missing"], row["extra"], row["type_mismatches"], row["score"]) == (2, 1, 0, 1, 0.5)


def test_fidelity_of_a_table_with_itself_is_one(spark, people):
    p = P.profile(people, exact=True)
    assert all(r["score"] == 1.0 for r in V.fidelity_columns(p, p).collect())
    missing = V.fidelity_columns(p, p.filter("column_name <> 'name'")).filter("column_name = 'name'").first()
    assert missing["score"] == 0.0


def test_ks(spark):
    a, b = spark.range(1000).select(F.col("id").cast("double").alias("x")), spark.range(500, 1500).select(F.col("id").cast("double").alias("x"))
    assert V.ks_distance(a, a, "x").first()["ks"] == 0.0
    assert abs(V.ks_distance(a, b, "x").first()["ks"] - 0.5) < 1e-12


def test_types():
    assert spark_type("NUMBER(10,2)") == "decimal(10,2)" and spark_type("DECIMAL(8.2)") == "decimal(8,2)" and spark_type("numeric") == "decimal(18,4)"
    assert spark_type("VARCHAR2(50)") == "string" and spark_type("bigserial") == "bigint" and spark_type("geometry") == "string"
    assert base_type("double precision") == "double"


DDL = """
-- four dialects
CREATE TABLE hr.employees (
  emp_id NUMBER(10) PRIMARY KEY, first_name VARCHAR2(50) NOT NULL, salary NUMBER(10,2) DEFAULT 0,
  dept_id NUMBER(10) REFERENCES hr.departments(dept_id), status VARCHAR2(10) CHECK (status IN ('ACTIVE','LEFT','LEAVE'))
);
CREATE TABLE [Products] ([ProductID] INT IDENTITY(1,1) PRIMARY KEY, [Price] MONEY, [IsActive] BIT);
CREATE TABLE IF NOT EXISTS orders (id BIGSERIAL, meta JSONB, customer_id INT, CONSTRAINT pk PRIMARY KEY (id), CONSTRAINT fk FOREIGN KEY (customer_id) REFERENCES customers(id));
CREATE TABLE `users` (`id` BIGINT AUTO_INCREMENT, role ENUM('a','b'), created_at DATETIME, PRIMARY KEY (`id`));
"""


def test_ddl_inventory(spark):
    out = B.ddl_inventory(spark.createDataFrame([("f.sql", DDL)], "file string, value string"))
    got = {(r["table_name"], r["column_name"]): r for r in out.collect()}
    assert {t for t, _ in got} == {"hr.employees", "Products", "orders", "users"} and len(got) == 14
    emp = got["hr.employees", "emp_id"]
    assert emp["is_primary_key"] and not emp["nullable"] and emp["data_type"] == "decimal"
    assert (got["hr.employees", "dept_id"]["fk_table"], got["hr.employees", "dept_id"]["fk_column"]) == ("hr.departments", "dept_id")
    assert got["hr.employees", "status"]["check_values"] == ["ACTIVE", "LEFT", "LEAVE"] and got["hr.employees", "first_name"]["max_len"] == 50
    assert got["Products", "Price"]["data_type"] == "decimal" and got["Products", "IsActive"]["data_type"] == "boolean"
    assert got["orders", "id"]["is_primary_key"] and got["orders", "customer_id"]["fk_table"] == "customers" and got["orders", "meta"]["data_type"] == "text"
    assert got["users", "id"]["is_primary_key"] and got["users", "role"]["data_type"] == "varchar"


def test_default_stats_by_type(spark):
    rows = [("id", "int", False, True, None, None), ("flag", "boolean", True, False, "true", None), ("kind", "varchar(9)", True, False, None, ["a", "b"]), ("amt", "decimal(5,2)", True, False, None, None)]
    cols = spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean, is_primary_key boolean, default_value string, check_values array<string>")
    out = {r["column_name"]: r for r in B.default_stats(cols.withColumns({"num_precision": F.lit(5), "num_scale": F.lit(2)}), 400).collect()}
    assert (out["id"]["min_number"], out["id"]["max_number"], out["id"]["mean"], out["id"]["distinct_count"], out["id"]["null_ratio"]) == (1, 400, 200, 400, 0.0)
    assert out["flag"]["true_ratio"] == 0.7 and out["flag"]["null_ratio"] == 0.05
    assert out["kind"]["distinct_count"] == 2 and out["kind"]["max_length"] is None
    assert (out["amt"]["max_number"], out["amt"]["mean"], out["amt"]["stddev"]) == (999.0, 99.9, 49.95)


def test_key_inference(spark):
    parent = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id int, label string")
    child = spark.createDataFrame([(i, i % 3) for i in range(20)], "cid int, pid int")
    rows = {tuple(r) for r in B.infer_keys({"parent": parent, "child": child}).collect()}
    assert ("primary_key", "parent", "id", None, None) in rows and ("primary_key", "child", "cid", None, None) in rows
    assert ("foreign_key", "child", "pid", "parent", "id") in rows


def test_typed_and_composite_keys(spark, monkeypatch):
    monkeypatch.setattr(B, "LOOK", 50)
    day = "date_add(date'2024-01-01', cast(%s as int))"
    prices = spark.range(300).selectExpr("cast(id / 4 as decimal(20,2)) AS price", f"{day % 'id'} AS day", "timestamp_micros(id * 7) AS at", "cast(id as double) AS f", "if(id = 9, null, id) AS holes")
    shelf = spark.range(600).selectExpr("cast(id div 30 as int) AS house", "cast(id % 30 as smallint) AS slot", "id % 7 AS kind", "cast((id % 100) / 4 as decimal(9,3)) AS price", f"{day % 'id % 200'} AS day")
    moves = spark.range(900).selectExpr("cast(id % 20 as bigint) AS from_house", "cast((id * 7) % 30 as int) AS from_slot", "if(id % 5 = 0, null, timestamp_ntz'1970-01-01 00:00:00.000007') AS at", "'x' AS c")
    found = {tuple(r) for r in B.infer_keys({"prices": prices, "shelf": shelf, "moves": moves}, composite=2).collect()}
    keys = {(t, c) for k, t, c, _, _ in found if k == "primary_key"}
    seen = shelf.collect()
    pairs = [(a, b) for k, a in enumerate(shelf.columns) for b in shelf.columns[k + 1 :]]
    plain = {("shelf", f"{a},{b}") for a, b in pairs if len({(r[a], r[b]) for r in seen}) == len(seen)}
    assert ("shelf", "house,slot") in plain and keys == {("prices", "price"), ("prices", "day"), ("prices", "at")} | plain
    links = {x[1:] for x in found if x[0] == "foreign_key"}
    assert ("shelf", "price", "prices", "price") in links and ("shelf", "day", "prices", "day") in links and ("moves", "at", "prices", "at") in links
    assert ("moves", "from_house,from_slot", "shelf", "house,slot") in links and ("moves", "from_slot,from_house", "shelf", "house,slot") not in links
    assert all("holes" not in c and c != "f" for _, c in keys)
    more = moves.unionByName(moves.limit(1).selectExpr("19L AS from_house", "30 AS from_slot", "at", "c"))
    again = {tuple(r)[1:] for r in B.infer_keys({"shelf": shelf, "moves": more}, composite=2).collect()}
    assert ("moves", "from_house,from_slot", "shelf", "house,slot") not in again and ("shelf", "house,slot", None, None) in again


def test_profile_does_not_scan_per_column(spark, people):
    plan = P.statistics(people)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_drift(spark):
    a = spark.createDataFrame([("t", "x", "int"), ("t", "y", "int"), ("old", "z", "int")], "table_name string, column_name string, data_type string")
    b = spark.createDataFrame([("t", "x", "bigint"), ("t", "w", "int"), ("new", "z", "int")], "table_name string, column_name string, data_type string")
    got = {(r["table_name"], r["column_name"], r["change"]) for r in B.drift(a, b).collect()}
    assert got == {("old", None, "table_removed"), ("new", None, "table_added"), ("t", "x", "type_changed"), ("t", "y", "column_removed"), ("t", "w", "column_added")}
    assert B.has_drift(B.drift(a, b)).first()["has_drift"] and not B.has_drift(B.drift(a, a)).first()["has_drift"]


def test_crawl_skips_broken_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS crawl_db")
    spark.range(3).write.mode("overwrite").saveAsTable("crawl_db.good")
    found, failed = B.crawl(spark, ["crawl_db", "sys"])
    assert [(r["table_name"], r["row_count"]) for r in found.collect()] == [("crawl_db.good", 3)] and failed == []


def test_empty_tables(spark, people):
    none = people.limit(0)
    stats = {r["column_name"]: r for r in P.profile(none, exact=True).collect()}
    assert stats["amount"]["row_count"] == 0 and stats["amount"]["null_ratio"] == 0.0 and stats["amount"]["mean"] is None
    found = Q.violations(none, [Q.not_null("name"), Q.unique(["id"])]).collect()
    assert [(r["violating_rows"], r["total_rows"], r["violation_ratio"]) for r in found] == [(0, 0, 0.0)] * 2
    assert P.exact_percentiles(none, ["amount"]).isEmpty()
    assert L.clean_stats(none, [ColumnSpec("id", "int", False, True)]).first()["rows_dropped"] == 0
    assert V.ks_distance(none, none, "amount").first()["ks"] is None


def test_all_null_column(spark):
    df = spark.range(10).select("id", F.lit(None).cast("double").alias("x"), F.lit(None).cast("string").alias("s"))
    rows = {r["column_name"]: r for r in P.profile(df, exact=True).collect()}
    assert rows["x"]["null_ratio"] == 1.0 and rows["x"]["distinct_count"] == 0 and rows["s"]["pattern"] is None and rows["s"]["top_values"] is None


def test_long_texts_come_back_whole(spark):
    df = spark.range(6).select(F.when(F.col("id") < 4, F.repeat(F.lit("ab"), 400)).otherwise(F.lit("short")).alias("t"))
    top = P.top_values(df, 2).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in top] == [("ab" * 400, 4), ("short", 2)]
