"""Streams over the files of the given tables, run until the input is used up; the check query is the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import windows as W
from millrace.plans.quality import Rule
from millrace.queries.base import Registry
from millrace.queries.scans import CDC_SQL, SEQ
from millrace.runtime import load, scratch_path
from millrace.spec import ColumnSpec, TableSpec
from millrace.streaming import streams as S

R = Registry()


def _events(spark, d) -> DataFrame:
    """The event stream with a time column that can carry a watermark."""
    return S.stream_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def _paths(spark, label: str) -> tuple[str, str]:
    return scratch_path(spark, label), scratch_path(spark, label + "-checkpoint")


@R.add("stream_file_source", "SELECT event_id, user_id, event_type, value FROM events")
def stream_file_source(spark, d):
    return S.collect_stream(S.stream_table(spark, d, "events", max_files=1).select("event_id", "user_id", "event_type", "value"), "file-source")


@R.add("stream_available_now", "SELECT event_id, value * 2 AS doubled FROM events WHERE event_type <> 'view'")
def stream_available_now(spark, d):
    sink, checkpoint = _paths(spark, "available")
    df = S.stream_table(spark, d, "events").filter("event_type <> 'view'").select("event_id", (F.col("value") * 2).alias("doubled"))
    S.run_available_now(df, sink, checkpoint)
    S.run_available_now(df, sink, checkpoint)  # nothing new: the second run adds nothing
    return spark.read.parquet(sink)


@R.add("stream_foreach_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_foreach_batch(spark, d):
    sink, checkpoint = _paths(spark, "foreach")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(S.batch_folder(sink, batch_id))

    S.for_each_batch(S.stream_table(spark, d, "events"), run, checkpoint)
    return spark.read.parquet(sink).groupBy("event_type").agg(F.sum("n").alias("n"))


CLOSED = "WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@R.add(
    "stream_tumbling",
    f"""SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type,
    count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL) {CLOSED}""",
)
def stream_tumbling(spark, d):
    aggs = {"n": F.count(F.lit(1)), "mean": F.round(F.avg("value"), 6)}
    out = W.tumbling(_events(spark, d), "ts", "1 hour", aggs, ["event_type"], watermark="10 minutes")
    return _ntz(S.collect_stream(out, "tumbling"), "window_start", "window_end")


@R.add(
    "stream_sliding",
    f"""SELECT * FROM (SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM
    (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL) {CLOSED}""",
)
def stream_sliding(spark, d):
    out = W.tumbling(_events(spark, d), "ts", "2 hours", {"n": F.count(F.lit(1))}, slide="1 hour", watermark="10 minutes")
    return _ntz(S.collect_stream(out, "sliding"), "window_start", "window_end")


SESSIONS = """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS events FROM
 (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
   (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""


@R.add("stream_session", f"SELECT * FROM ({SESSIONS}) WHERE session_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_session(spark, d):
    out = S.sessions(_events(spark, d), "user_id", "ts", "12 hours", "10 minutes")
    return _ntz(S.collect_stream(out, "session"), "session_start", "session_end")


@R.add("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    # a watermark of 100 days covers the whole stream
    twice = _events(spark, d).select("user_id", "event_type", "ts")
    return S.collect_stream(S.dedup_stream(twice, ["user_id", "event_type"], "ts", "100 days"), "dedup").select("user_id", "event_type")


@R.add(
    "stream_late_data",
    """SELECT 'late' AS part, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE ts < TIMESTAMP '2024-01-10' AND event_id % 100 = 0
    UNION ALL SELECT 'on_time', count(*), sum(event_id)::BIGINT FROM events WHERE NOT (ts < TIMESTAMP '2024-01-10' AND event_id % 100 = 0)""",
)
def stream_late_data(spark, d):
    """Every hundredth early event arrives after all others, in a second file."""
    feed = scratch_path(spark, "late-feed")
    events = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    held = (F.col("ts") < "2024-01-10") & (F.col("event_id") % 100 == 0)
    on_time, late, checkpoint = scratch_path(spark, "on-time"), scratch_path(spark, "late"), scratch_path(spark, "late-checkpoint")
    for part in (events.filter(~held), events.filter(held)):
        part.write.mode("append").parquet(feed)
        S.split_late(S.stream_files(spark, feed, events.schema), "ts", "10 MINUTES", on_time, late, checkpoint)
    parts = [
        spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).withColumn("part", F.lit(n)) for n, p in (("on_time", on_time), ("late", late))
    ]
    return parts[0].unionByName(parts[1])


@R.add(
    "stream_activity_monitor",
    f"SELECT user_id, session_end - INTERVAL 12 HOUR AS silent_since, session_end AS alert_at FROM ({SESSIONS}) WHERE session_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
)
def stream_activity_monitor(spark, d):
    out = S.monitor(_events(spark, d), "user_id", "ts", 12 * 3600, "10 minutes")
    return _ntz(S.collect_stream(out, "monitor"), "silent_since", "alert_at")


EVENT_SPEC = TableSpec("events", [ColumnSpec("event_id", "bigint", False, True), ColumnSpec("value", "decimal(10,2)"), ColumnSpec("event_type", "varchar(10)", False)])
EVENT_RULES = [Rule("positive", "value > 5", "drop"), Rule("known", "event_type <> 'error'", "drop")]
STREAM_SILVER = "SELECT event_id, value::DECIMAL(10,2) AS value, event_type, user_id FROM events WHERE value::DECIMAL(10,2) > 5 AND event_type <> 'error'"


@R.add(
    "stream_medallion",
    f"""SELECT 'gold' AS layer, event_id, value, event_type, '' AS failed FROM ({STREAM_SILVER}) UNION ALL SELECT 'quarantine', event_id, value::DECIMAL(10,2), event_type,
    CASE WHEN NOT (value::DECIMAL(10,2) > 5) AND event_type = 'error' THEN 'positive,known' WHEN event_type = 'error' THEN 'known' ELSE 'positive' END
    FROM events WHERE NOT (value::DECIMAL(10,2) > 5 AND event_type <> 'error')""",
)
def stream_medallion(spark, d):
    root, checkpoint = _paths(spark, "stream-layers")
    S.stream_layers(S.stream_table(spark, d, "events"), EVENT_SPEC, EVENT_RULES, root, "files", checkpoint)
    gold = spark.read.parquet(f"{root}/gold").select(F.lit("gold").alias("layer"), "event_id", "value", "event_type", F.lit("").alias("failed"))
    held = spark.read.parquet(f"{root}/quarantine")
    return gold.unionByName(held.select(F.lit("quarantine").alias("layer"), "event_id", "value", "event_type", F.array_join("_failed_rules", ",").alias("failed")))


@R.add(
    "stream_unique_rules",
    """WITH t AS (SELECT event_id, user_id, event_type, ts < TIMESTAMP '2024-01-11' AS early, ts >= TIMESTAMP '2024-01-21' AS late, event_type <> 'error' AS ok FROM events),
    r AS (SELECT *, ok AND row_number() OVER (PARTITION BY user_id, event_type, ok ORDER BY CASE WHEN early THEN 0 WHEN late THEN 2 ELSE 1 END, event_id) > 1 AS again FROM t)
    SELECT event_id, CASE WHEN NOT ok THEN 'known' WHEN again THEN 'once' ELSE '' END AS failed FROM r""",
)
def stream_unique_rules(spark, d):
    """Events in three batches by time; one row of a user and type is kept, the first one to come."""
    root, checkpoint = _paths(spark, "stream-unique")
    landed, events = scratch_path(spark, "unique-events"), load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    early, late = F.expr("ts < TIMESTAMP_NTZ '2024-01-11 00:00:00'"), F.expr("ts >= TIMESTAMP_NTZ '2024-01-21 00:00:00'")
    rules = [Rule("once", action="drop", keys=("user_id", "event_type")), Rule("known", "event_type <> 'error'", "drop")]
    for part in (early, ~early & ~late, late):
        events.filter(part).write.mode("append").parquet(landed)
        S.stream_layers(S.stream_files(spark, landed, events.schema), TableSpec("events", []), rules, root, "files", checkpoint, ["event_id"])
    gold = spark.read.parquet(f"{root}/gold").select("event_id", F.lit("").alias("failed"))
    return gold.unionByName(spark.read.parquet(f"{root}/quarantine").select("event_id", F.array_join("_failed_rules", ",").alias("failed")))


GATE_SQL = "SELECT o_orderkey FROM orders JOIN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) >= 12) ON o_custkey = user_id"


@R.add("signal_gate", GATE_SQL)
def signal_gate(spark, d):
    signals = load(spark, d, "events").filter("event_type = 'purchase'")
    return S.gate(load(spark, d, "orders"), signals, "o_custkey", "user_id", 12).select("o_orderkey")


@R.add("stream_signal_gate", GATE_SQL)
def stream_signal_gate(spark, d):
    """Orders in three batches; half of the signals come when all orders are waiting or gone."""
    signals, sink, landed, checkpoint = (scratch_path(spark, n) for n in ("signals", "gate", "gate-orders", "gate-checkpoint"))
    given = load(spark, d, "events").filter("event_type = 'purchase'")
    S.notify(given.filter("event_id % 2 = 0"), signals)
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    for k in range(3):
        orders.filter(F.col("o_orderkey") % 3 == k).coalesce(1).write.mode("append").parquet(landed)
    for late in (False, True):
        if late:
            S.notify(given.filter("event_id % 2 = 1"), signals)
        S.gate_stream(S.stream_files(spark, landed, orders.schema, max_files=1), signals, "o_custkey", "user_id", 12, sink, checkpoint)
    return spark.read.parquet(sink).select("o_orderkey")


@R.add("stream_rate_control", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) <= 2")
def stream_rate_control(spark, d):
    """Events in three batches that cut through days: the limit of a day holds over all of them."""
    sink, checkpoint = _paths(spark, "throttled")
    landed, events = scratch_path(spark, "throttled-events"), load(spark, d, "events")
    part = F.expr("CASE WHEN ts < TIMESTAMP_NTZ '2024-01-10 12:00:00' THEN 0 WHEN ts < TIMESTAMP_NTZ '2024-01-20 12:00:00' THEN 1 ELSE 2 END")
    for k in range(3):
        events.filter(part == k).coalesce(1).write.mode("append").parquet(landed)
    S.throttled(S.stream_files(spark, landed, events.schema, max_files=1), ["user_id"], "ts", "1 day", 2, ["ts", "event_id"], sink, checkpoint, "1 day")
    return spark.read.parquet(sink).select("event_id")


@R.add("stream_static_join", "SELECT event_id, c_mktsegment, c_custkey IS NOT NULL AS matched FROM events LEFT JOIN customer ON user_id * 20 = c_custkey")
def stream_static_join(spark, d):
    events = S.stream_table(spark, d, "events").select("event_id", (F.col("user_id") * 20).alias("c_custkey"))
    out = S.lookup_stream(events, load(spark, d, "customer"), ["c_custkey"], ["c_mktsegment"])
    return S.collect_stream(out.select("event_id", "c_mktsegment", "matched"), "static-join")


R.queries["stream_static_lookup"] = stream_static_join
R.sql["stream_static_lookup"] = R.sql["stream_static_join"]


@R.add("stream_cdc_apply", CDC_SQL)
def stream_cdc_apply(spark, d):
    target = load(spark, d, "orders").filter("o_orderkey % 2 = 0").selectExpr("o_orderkey", "cast(null as double) AS quantity", "o_totalprice AS price")
    feed = S.stream_table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS o_orderkey", "l_quantity AS quantity", "l_extendedprice AS price", "CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'insert' ELSE 'update' END AS op",
        "l_returnflag AS flag", *SEQ,
    )
    sink, checkpoint = _paths(spark, "cdc")
    S.apply_changes_stream(feed, ["o_orderkey"], [*SEQ, "flag"], sink, checkpoint)
    S.fold_changes(spark, sink, ["o_orderkey"], [*SEQ, "flag"])
    return S.current_table(target, sink, ["o_orderkey"], [*SEQ, "flag"], "op")


@R.add("stream_route_sinks", "SELECT event_id, 'big' AS route FROM events WHERE value > 50 UNION ALL SELECT event_id, 'sale' FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'unmatched' FROM events WHERE NOT value > 50 AND event_type <> 'purchase'")
def stream_route_sinks(spark, d):
    sink, checkpoint = _paths(spark, "routes")
    S.route_sinks(S.stream_table(spark, d, "events").select("event_id", "value", "event_type"), {"big": "value > 50", "sale": "event_type = 'purchase'"}, sink, checkpoint)
    return spark.read.parquet(sink).select("event_id", "route")


@R.add(
    "stream_dead_letter",
    """SELECT 'events' AS _source, CASE WHEN value <= 5 AND event_type = 'error' THEN 'positive,known' WHEN value <= 5 THEN 'positive' ELSE 'known' END AS _error,
    '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS _record, (SELECT count(*) FROM events WHERE value > 5 AND event_type <> 'error') AS good
    FROM events WHERE NOT (value > 5 AND event_type <> 'error')""",
)
def stream_dead_letter(spark, d):
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    rules = [Rule("positive", "_value > 5"), Rule("known", "event_type <> 'error'")]
    df = S.stream_table(spark, d, "events").select("event_id", "event_type", F.col("value").alias("_value"))
    S.dead_letter_stream(df, rules, "events", good, bad, scratch_path(spark, "dead-checkpoint"))
    n = spark.read.parquet(good).agg(F.count(F.lit(1)).alias("n")).scalar()
    return spark.read.parquet(bad).select("_source", "_error", "_record", n.alias("good"))
