"""Windows over time, deduplication, order, limits and samples."""

from __future__ import annotations

from operator import add

from pyspark.sql import functions as F

from millrace.operators import windows as W
from millrace.queries.base import Registry
from millrace.runtime import load

R = Registry()


@R.add(
    "tumbling_window_avg",
    """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
    round(avg(value), 6) AS rolling_avg, count(*) AS n FROM events GROUP BY ALL""",
)
def tumbling_window_avg(spark, d):
    aggs = {"rolling_avg": F.round(F.avg("value"), 6), "n": F.count(F.lit(1))}
    return W.tumbling(load(spark, d, "events"), "ts", "5 minutes", aggs)


@R.add(
    "rolling_window_avg",
    """SELECT event_id, round(sum(value) OVER w, 2) / count(*) OVER w AS rolling_avg, count(*) OVER w AS n FROM (SELECT * REPLACE (CASE WHEN event_id % 10 > 0 THEN ts END AS ts) FROM events)
    WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""",
)
def rolling_window_avg(spark, d):
    # values have two decimals: the rounded sum is exact, and its quotient does not depend on how an engine rounds halves
    events = load(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 10 > 0, F.col("ts")))  # some without a time
    out = W.rolling(events, ["event_type"], "ts", 3600, {"total": F.sum("value"), "n": F.count(F.lit(1))}, merge={"total": add, "n": add})
    return out.select("event_id", (F.round("total", 2) / F.col("n")).alias("rolling_avg"), "n")


@R.add(
    "dedup_keep_first",
    "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
)
def dedup_keep_first(spark, d):
    df = load(spark, d, "orders")
    return W.dedup(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@R.add("detect_duplicates", "SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) AS copies, count(*) OVER (PARTITION BY sha256(text)) > 1 AS is_duplicate FROM documents")
def detect_duplicates(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return W.duplicates(docs, ["digest"], "mark").drop("digest")


@R.add("drop_duplicates", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def drop_duplicates(spark, d):
    df = load(spark, d, "events").select("user_id", "event_type", "event_id")
    return W.duplicates(df, ["user_id", "event_type"], "drop", ["event_id"])


@R.add(
    "latest_version",
    "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def latest_version(spark, d):
    df = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return W.latest(df, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@R.add(
    "enforce_order",
    """SELECT event_type, event_id, lag(event_id) OVER w AS previous, coalesce(event_id - lag(event_id) OVER w - 1, 0) AS missing FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""",
)
def enforce_order(spark, d):
    return W.enforce_order(load(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id")


@R.add(
    "inactivity_gaps",
    """SELECT event_id, user_id, previous_ts, (epoch_us(ts) - epoch_us(previous_ts)) / 1000000.0::DOUBLE AS idle_seconds
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_ts FROM events)
    WHERE epoch_us(ts) - epoch_us(previous_ts) > 6 * 3600 * 1000000::BIGINT""",
)
def inactivity_gaps(spark, d):
    out = W.gaps(load(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 6 * 3600, "event_id")
    return out.drop("ts")


@R.add(
    "rate_limit",
    """SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) <= 2""",
)
def rate_limit(spark, d):
    return W.rate_limit(load(spark, d, "events"), ["event_type"], "ts", "1 hour", 2, ["ts", "event_id"]).select("event_id", "event_type")


@R.add("sort_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_rows(spark, d):
    return W.sort_rows(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])


@R.add(
    "top_k_per_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 3",
)
def top_k_per_group(spark, d):
    df = load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return W.top_k(df, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 3).drop("l_partkey")


UNIT = "(('0x' || substr(md5('42|' || {k}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


@R.add("sample_fraction", f"SELECT o_orderkey, o_custkey FROM orders WHERE {UNIT.format(k='o_orderkey')} < 0.1")
def sample_fraction(spark, d):
    return W.sample_fraction(load(spark, d, "orders").select("o_orderkey", "o_custkey"), 0.1, "o_orderkey")


@R.add("limited_sample_scan", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {UNIT.format(k='o_orderkey')}, o_orderkey LIMIT 500")
def limited_sample_scan(spark, d):
    return W.sample_rows(load(spark, d, "orders").select("o_orderkey", "o_custkey"), 500, "o_orderkey")
