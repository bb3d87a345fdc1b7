"""Chunked order operators against plain windows, with a hot key and NULL keys."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import ordered as O
from millrace.operators import windows as W


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, some rows without key."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 17))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37 % 100_000)
    return spark.range(6000).select("id", key.alias("k"), at.alias("ts"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(cols) == sorted(b.columns)
    left, right = a.select(cols), b.select(cols)
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_previous_equals_lag(skewed, share):
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = skewed.withColumn("before", F.lag("id").over(w))
    got = O.with_previous(skewed, ["k"], ["ts", "id"], F.date_trunc("hour", "ts"), {"before": "id"}, share=share)
    same(got, want)


def test_running_sum_equals_window(skewed):
    counts = skewed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    points = O.cut_points(skewed, "v", 16)
    got = O.with_running_sum(counts, ["k"], "v", O.chunk_of(F.col("v"), points), {"c": "n"})
    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    same(got, counts.withColumn("c", F.sum("n").over(w)))


def test_rolling_equals_range_window(skewed):
    got = W.rolling(skewed, ["k"], "ts", 1800, {"s": F.sum("v"), "n": F.count(F.lit(1))}, chunk_seconds=2000)
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-1_800_000_000, 0)
    same(got, skewed.withColumns({"s": F.sum("v").over(w), "n": F.count(F.lit(1)).over(w)}))


def test_rolling_by_merged_parts_equals_range_window(skewed, capsys):
    # times on both edges of a window, many rows of one time, values and keys that are NULL, rows without a time
    rows = skewed.withColumns({"ts": F.when(F.col("id") % 40 > 0, F.date_trunc("minute", "ts")), "v": F.when(F.col("id") % 3 > 0, F.col("v"))})
    aggs = {"s": F.sum("v"), "n": F.count(F.lit(1)), "low": F.min("v")}
    got = W.rolling(rows, ["k"], "ts", 1800, aggs, merge={"s": lambda a, b: a + b, "n": lambda a, b: a + b, "low": F.least})
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-1_800_000_000, 0)
    same(got, rows.withColumns({n: c.over(w) for n, c in aggs.items()}))
    got.explain()
    assert "-1800000000" not in capsys.readouterr().out  # no frame that Spark goes over anew for each row


def test_skew_join_equals_join(skewed, spark):
    dim = skewed.filter("k is not null").groupBy("k").agg(F.max("v").alias("top"))
    same(O.skew_join(skewed, dim, ["k"], share=0.1), skewed.join(dim, "k", "left").select(*skewed.columns, "top"))


def test_hot_keys_are_few(skewed):
    assert [r["k"] for r in O.hot_keys(skewed, ["k"], 0.2).collect()] == ["hot"]


def test_dense_index_is_dense(spark):
    df = spark.range(0, 5000, 7).select(F.col("id").alias("key"))
    idx = O.dense_index(df, "key")
    row = idx.agg(F.min("idx"), F.max("idx"), F.count_distinct("idx")).first()
    assert tuple(row) == (0, df.count() - 1, df.count())


def test_gaps_and_order(spark):
    rows = [("a", 1, 1), ("a", 2, 5), ("a", 5, 6), ("b", 7, 1)]
    df = spark.createDataFrame(rows, "k string, seq long, x int")
    out = {(r["k"], r["seq"]): (r["previous"], r["missing"]) for r in W.enforce_order(df, ["k"], "seq", chunk_size=2).collect()}
    assert out == {("a", 1): (None, 0), ("a", 2): (1, 0), ("a", 5): (2, 2), ("b", 7): (None, 0)}


def test_top_k_limits_before_the_shuffle(skewed):
    plan = W.top_k(skewed, ["k"], ["ts"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_duplicates_mark_counts_hot_group(skewed):
    marked = W.duplicates(skewed.select("id", "k"), ["k"], "mark")
    counts = {r["k"]: r["copies"] for r in marked.select("k", "copies").distinct().collect()}
    assert counts["hot"] == 2000 and marked.count() == 6000


def test_fine_chunks_increase_with_the_value(spark):
    df = spark.range(3000).select((F.col("id") * F.col("id") % 977 / 3.0).alias("v"))
    points = O.cut_points(df, "v", 8)
    lo, hi = df.agg(F.min("v"), F.max("v")).first()
    out = O.with_fine_chunk(df, "v", "c", points, lo, hi, 16).distinct().orderBy("v").collect()
    chunks = [r["c"] for r in out]
    assert chunks == sorted(chunks) and len(set(chunks)) > 50


def test_copies_of_one_row_spread_over_salts(spark):
    """A third of the rows may be the same row: its copies must not share one salt."""
    copies = spark.range(0, 8000, 1, 8).select(F.lit("same").alias("k"))
    assert copies.select(O.row_salt(copies, 8).alias("s")).distinct().count() == 8


def test_salted_lookup_equals_lookup(skewed, spark):
    from millrace.operators import joins as J

    dim = spark.createDataFrame([("hot", 1), ("k3", 2), (None, 9)], "k string, w int")
    same(J.lookup(skewed, dim, ["k"], ["w"], {"w": -1}, salted=True), J.lookup(skewed, dim, ["k"], ["w"], {"w": -1}))
    assert J.lookup(skewed, dim, ["k"], ["w"], salted=True).filter("k is null and matched").isEmpty()


def test_a_frequent_key_is_cut_by_its_own_rows(spark):
    """A third of all rows in one key: within one minute, and with sparse sequence values."""
    rows = spark.range(6000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN -1 ELSE id % 500 END AS k", "CASE WHEN id % 3 = 0 THEN timestamp_micros(id * 1000) ELSE timestamp_seconds(id * 60) END AS ts",
        "CASE WHEN id < 3000 THEN id ELSE id * 1000000 END AS seq",
    )
    for order in (["ts", "id"], ["seq"]):
        got = O.with_previous(rows, ["k"], order, None, {"before": "id"})
        want = rows.withColumn("before", F.lag("id").over(Window.partitionBy("k").orderBy(*order)))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile_approx" in plan
