"""Generators: counts, types, NULL shares, keys, repeatability."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import hashrand as H
from millrace.plans import generate as G
from millrace.plans import profile as P
from millrace.plans.blueprint import to_table_spec
from millrace.spec import Blueprint, ColumnSpec, ForeignKey, TableSpec


def column(spark, spec, n):
    return spark.range(n).select(G.column_value(spec, "t", F.col("id"), n, 42))


def test_integers(spark):
    spec = ColumnSpec("x", "int", stats={"min": 1, "max": 1000, "mean": 500, "stddev": 100, "null_ratio": 0.0})
    out = column(spark, spec, 100)
    assert isinstance(out.schema["x"].dataType, T.IntegerType)
    row = out.agg(F.count("x"), F.min("x"), F.max("x"), F.avg("x")).first()
    assert row[0] == 100 and row[1] >= 1 and row[2] <= 1000 and 400 < row[3] < 600


def test_null_share_and_categories(spark):
    tops = [{"value": "A", "frequency": 0.35}, {"value": "B", "frequency": 0.35}]
    spec = ColumnSpec("x", "string", stats={"null_ratio": 0.3, "top_values": tops, "distinct_count": 2})
    out = column(spark, spec, 1000)
    assert out.filter("x is null").count() == G.null_count(1000, 0.3)
    assert {r["x"] for r in out.distinct().collect()} == {"A", "B", None}


def test_boolean_date_and_decimal(spark):
    flag = ColumnSpec("x", "boolean", stats={"top_values": [{"value": True, "frequency": 0.7}, {"value": False, "frequency": 0.3}]})
    share = column(spark, flag, 1000).agg(F.avg(F.col("x").cast("int"))).first()[0]
    assert 0.65 < share < 0.75
    day = column(spark, ColumnSpec("x", "date", stats={"min": "2020-01-01", "max": "2025-12-31"}), 50)
    assert isinstance(day.schema["x"].dataType, T.DateType)
    assert day.filter("x < date '2020-01-01' or x > date '2025-12-31'").isEmpty()
    money = column(spark, ColumnSpec("x", "decimal(10,2)", stats={"min": 0.0, "max": 99.0}), 50)
    assert money.schema["x"].dataType == T.DecimalType(10, 2)


def test_pattern_has_digits(spark):
    out = column(spark, ColumnSpec("x", "string", stats={"pattern": r"\d{3}-\d{2}-\d{4}"}), 200)
    assert out.filter(~F.col("x").rlike(r"^\d{3}-\d{2}-\d{4}$")).isEmpty()


def test_string_lengths(spark):
    out = column(spark, ColumnSpec("x", "varchar(20)", stats={"min_length": 3, "max_length": 20}), 500)
    row = out.agg(F.min(F.length("x")), F.max(F.length("x")), F.count_distinct("x")).first()
    assert row[0] == 3 and row[1] == 20 and row[2] > 480


def test_high_cardinality_text_is_not_resampled(spark):
    """Top values that cover few rows are not treated as the whole domain."""
    stats = {"top_values": [{"value": "a", "frequency": 0.01}], "distinct_count": 5000, "min_length": 6, "max_length": 9}
    assert column(spark, ColumnSpec("x", "string", stats=stats), 300).distinct().count() > 290


def shop():
    customers = TableSpec("customers", [ColumnSpec("id", "int", False, True, {"min": 1})], 200)
    orders = TableSpec(
        "orders", [ColumnSpec("id", "int", False, True, {"min": 1}), ColumnSpec("customer_id", "int")], 3000,
        [ForeignKey("customer_id", "customers", "id", 0.1)],
    )
    return Blueprint("bp", [orders, customers])


def test_order_and_foreign_keys(spark):
    bp = shop()
    assert G.generation_order(bp) == ["customers", "orders"]
    made = G.generate_all(spark, bp)
    assert made["customers"].distinct().count() == 200
    keys = made["customers"].select(F.col("id").alias("customer_id"))
    lost = made["orders"].join(keys, "customer_id", "left_anti").count() / 3000
    assert 0.07 < lost < 0.13
    assert made["orders"].schema["customer_id"].dataType == T.IntegerType()


def test_text_foreign_keys(spark):
    parent = TableSpec("p", [ColumnSpec("code", "varchar(9)", False, True)], 50)
    child = TableSpec("c", [ColumnSpec("code", "varchar(9)")], 500, [ForeignKey("code", "p", "code")])
    made = G.generate_all(spark, Blueprint("b", [child, parent]))
    assert made["c"].join(made["p"], "code", "left_anti").isEmpty()


def test_cycle_does_not_hang():
    a = TableSpec("a", [ColumnSpec("id")], 1, [ForeignKey("id", "b", "id")])
    b = TableSpec("b", [ColumnSpec("id")], 1, [ForeignKey("id", "a", "id")])
    assert sorted(G.generation_order(Blueprint("x", [a, b]))) == ["a", "b"]


def test_same_rows_on_any_partitioning(spark):
    bp = shop()
    made = G.generate(spark, bp.table("orders"), 1.0, 7, bp)
    one = spark.range(0, 3000, 1, 1).select("id")
    again = one.select(*[G.column_value(bp.table("orders").columns[0], "orders", F.col("id"), 3000, 7)])
    assert made.select("id").exceptAll(again).isEmpty()
    sums = {made.repartition(n).agg(F.sum(F.xxhash64("id", "customer_id") % 1000)).first()[0] for n in (1, 3)}
    assert len(sums) == 1


def test_rows_scale_and_cap():
    spec = TableSpec("t", [], 1000)
    assert G.rows_of(spec, 0.5) == 500 and G.rows_of(spec, 0.0001) == 1
    assert G.rows_of(spec, 1e6) == 10**9 and G.rows_of(spec, 0.5, 500) == 500
    with pytest.raises(G.TooManyRows):
        G.rows_of(spec, 1.0, 999)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**15))
def test_stride_is_a_bijection(n):
    a = H.stride(n)
    assert math.gcd(a, n) == 1 and (n <= 2 or a * (n - 1) < 2**63)


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**12))
def test_permutation_is_complete(n, shift):
    a = H.stride(n)
    assert sorted((a * i + shift) % n for i in range(n)) == list(range(n))


def test_normal_ppf(spark):
    pd = pytest.importorskip("statistics")
    us = [0.0005, 0.01, 0.0243, 0.3, 0.5, 0.77, 0.98, 0.9999]
    df = spark.createDataFrame([(u,) for u in us], "u double").select("u", H.normal_ppf(F.col("u")).alias("z"))
    for r in df.collect():
        assert abs(r["z"] - pd.NormalDist().inv_cdf(r["u"])) < 1e-8


def test_profile_then_generate_keeps_quartiles(spark):
    src = spark.range(5000).select((F.col("id") * F.col("id") / 1000.0).alias("x"))
    spec = to_table_spec("t", P.profile(src))
    made = G.generate(spark, spec, 1.0, 3, quantiles=True)
    a = P.exact_percentiles(src, ["x"]).orderBy("probability").collect()
    b = P.exact_percentiles(made, ["x"]).orderBy("probability").collect()
    for x, y in zip(a, b):
        assert abs(x["value"] - y["value"]) < 25000 * 0.03
