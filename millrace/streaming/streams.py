"""Structured Streaming: file streams, windows, sessions, deduplication, monitors, gates and sinks.

Every query has a checkpoint, and batch functions write idempotently by batch id, so a restarted batch replaces its
own output.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.joins import lookup
from millrace.operators.ordered import join_on, skew_join
from millrace.operators.route import failed_rules, route, to_dead_letter
from millrace.operators.windows import dedup, rate_limit
from millrace.plans.layers import silver_rows, to_bronze
from millrace.plans.quality import Rule, keep, quarantine
from millrace.runtime import scratch_path, stored
from millrace.sources.changes import apply_changes, latest_changes
from millrace.spec import TableSpec

TRIGGER = "10 seconds"


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 1000, glob: str | None = None) -> DataFrame:
    """Continuous ingestion of new files of a folder; a schema is required."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def stream_table(spark: SparkSession, folder: str, name: str, max_files: int = 1000) -> DataFrame:
    """One of the given Parquet tables as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return stream_files(spark, f"{folder}/{name}.parquet*", schema, max_files=max_files)


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", partition_by: list[str] | None = None) -> StreamingQuery:
    """Process what is there since the last checkpoint, append it to Parquet, stop."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def for_each_batch(
    df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = True,
    interval: str = TRIGGER,
) -> StreamingQuery:
    """Batch logic per micro-batch; ``once`` runs until the input is used up, else every ``interval``."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(fn)
    if not once:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batch_folder(sink: str, batch_id: int) -> str:
    return f"{sink}/batch_id={batch_id}"


def write_batches(sink: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each batch to a folder of its own and replaces it on a retry."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(sink, batch_id))

    return write


def collect_stream(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over the available input and return what it wrote. In complete mode that is the last result table."""
    spark = df.sparkSession
    sink, checkpoint = scratch_path(spark, label), scratch_path(spark, label + "-checkpoint")
    if mode == "append":
        run_available_now(df, sink, checkpoint)
        return spark.read.schema(df.schema).parquet(sink)
    for_each_batch(df, write_batches(sink), checkpoint, mode)
    out = spark.read.parquet(sink)
    last = out.agg(F.max("batch_id").alias("b")).scalar()
    return out.filter(F.col("batch_id") == last).drop("batch_id")


def sessions(df: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Activity sessions per key: start, end (last event plus gap), events.

    Sessions are merged inside each task before they are shuffled, so a hot key ships its sessions, not its events.
    """
    df.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    if watermark:
        df = df.withWatermark(ts, watermark)
    out = df.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def dedup_stream(df: DataFrame, keys: list[str], ts: str, watermark: str) -> DataFrame:
    """First record of each key; state is kept only for the watermark delay."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def split_late(df: DataFrame, ts: str, delay: str, on_time: str, late: str, checkpoint: str) -> StreamingQuery:
    """Write records older than the greatest time of earlier batches minus ``delay`` to ``late``, the others to
    ``on_time``. The greatest time of each batch is stored with it, so a retried batch decides the same."""
    spark = df.sparkSession
    maxima = f"{checkpoint}-maxima"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark_ = batch.sparkSession
        bound = None
        if batch_id > 0:
            earlier = spark_.read.schema("batch_id bigint, ts timestamp").parquet(maxima).filter(F.col("batch_id") < batch_id)
            bound = earlier.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("b")).first()["b"]
        is_late = F.lit(False) if bound is None else F.col(ts) < F.lit(bound)
        batch.persist()
        batch.filter(~is_late).write.mode("overwrite").parquet(batch_folder(on_time, batch_id))
        batch.filter(is_late).write.mode("overwrite").parquet(batch_folder(late, batch_id))
        batch.agg(F.max(ts).alias("ts")).select(F.lit(batch_id).cast("bigint").alias("batch_id"), F.col("ts").cast("timestamp")).write.mode("overwrite").parquet(f"{maxima}/part={batch_id}")
        batch.unpersist()

    return for_each_batch(df, run, checkpoint)


def monitor(df: DataFrame, key: str, ts: str, seconds: int, watermark: str) -> DataFrame:
    """Alert (key, silent_since, alert_at) when a key has had no record for ``seconds`` of event time.

    A session with that gap closes exactly when the silence has lasted long enough, so the alert is a closed session.
    """
    closed = sessions(df, key, ts, f"{seconds} seconds", watermark)
    since = F.col("session_end") - F.expr(f"INTERVAL {seconds} SECONDS")
    return closed.select(key, since.alias("silent_since"), F.col("session_end").alias("alert_at"))


def gate(df: DataFrame, signals: DataFrame, key: str, signal: str, target: int) -> DataFrame:
    """Rows whose ``key`` names a signal that was given at least ``target`` times (batch, or inside a batch function)."""
    ready = signals.groupBy(F.col(signal).alias("__s")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= target)
    return df.join(ready, F.col(key) == F.col("__s"), "left_semi")


def notify(signals: DataFrame, path: str) -> None:
    """Give signals: append rows to the signal table a gate reads."""
    signals.write.mode("append").parquet(path)


def gate_stream(
    df: DataFrame, signals: str, key: str, signal: str, target: int, sink: str, checkpoint: str, consume: bool = False,
    ts: str | None = None, wait: str | None = None,
) -> StreamingQuery:
    """Release and hold: a row goes to ``sink`` once its key has been signalled ``target`` times; till then it waits. The signal
    table is a stream too: new signals make a batch of their own, also without new rows.

    Without ``consume`` an open gate stays open. With it, every ``target`` signals open the gate for the rows that came up to that
    batch and are used up; later rows need new ones. With ``wait`` a row whose time ``ts`` lies that long before the greatest time
    of earlier batches has expired: it goes to ``sink``-expired and no signal releases it. Rows without a time do not
    expire; rows without a key, and signals without one, meet nothing.

    Nothing that waits is written again: rows are appended to ``sink``-waiting with the number of openings before them, totals
    of the batch's keys to ``sink``-given. What waits is read when a gate opens, by key, and when rows fall due, by time.
    Every 50 batches both logs are folded. A retried batch reads what it read before.
    """
    waiting, totals, seen, expired = (f"{sink}-{n}" for n in ("waiting", "given", "seen", "expired"))
    cols = df.columns
    kind = df.schema[key].dataType
    given = stream_files(df.sparkSession, signals, df.sparkSession.read.parquet(signals).schema)
    named = given.select(F.col(signal).cast(kind).alias("__signal"), F.lit(True).alias("__given"))
    both = df.withColumns({"__signal": F.lit(None).cast(kind), "__given": F.lit(False)}).unionByName(named, allowMissingColumns=True)
    total_schema = T.StructType([T.StructField(key, kind), T.StructField("__total", T.LongType())])
    held_schema = T.StructType([*df.schema, T.StructField("__base", T.LongType()), T.StructField("__due", T.TimestampType())])

    def openings(total: str) -> Column:
        n = F.coalesce(F.col(total), F.lit(0).cast("bigint"))
        return F.floor(n / target) if consume else (n >= target).cast("bigint")

    def of_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
        return log.join(keys.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max("__total").alias("__total"))

    def still(held: DataFrame, log: DataFrame) -> DataFrame:
        return held.join(of_keys(log, held), key, "left").filter(F.col("__base") == openings("__total")).drop("__total")

    def greatest(spark: SparkSession, batch_id: int):
        if wait is None or batch_id < 0:
            return None
        return spark.read.schema("ts timestamp").parquet(batch_folder(seen, batch_id)).first()["ts"]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bound, former = greatest(spark, batch_id - 1), greatest(spark, batch_id - 2)
        before = _log_before(spark, totals, total_schema, batch_id)
        # what was still to come for the fold's last batch is what is due now
        alive = F.lit(True) if former is None else F.col("__due").isNull() | (F.col("__due") > F.lit(former))
        _fold_log(spark, waiting, held_schema, batch_id, lambda held: still(held.filter(alive), before))
        _fold_log(spark, totals, total_schema, batch_id, lambda log: log.filter("__total > 0").groupBy(key).agg(F.max("__total").alias("__total")))
        before, held = _log_before(spark, totals, total_schema, batch_id), _log_before(spark, waiting, held_schema, batch_id)

        batch.persist()
        rows = batch.filter("NOT __given").select(*cols)
        now = batch.groupBy(F.when(F.col("__given"), F.col("__signal")).otherwise(F.col(key)).alias(key)).agg(F.count_if("__given").alias("__new"))
        now = now.filter(F.col(key).isNotNull())
        old = of_keys(before, now).withColumnRenamed("__total", "__old")
        now = now.join(old, key, "left").withColumn("__old", F.coalesce("__old", F.lit(0).cast("bigint")))
        now = now.select(key, (F.col("__old") + F.col("__new")).alias("__total"), "__old")
        now.write.mode("overwrite").parquet(batch_folder(totals, batch_id))
        now = spark.read.schema(now.schema).parquet(batch_folder(totals, batch_id))

        due = F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {wait}") if wait else F.lit(None).cast("timestamp")
        late = F.coalesce(F.col("__due") <= F.lit(bound), F.lit(False)) if bound is not None else F.lit(False)
        base = openings("__old") if consume else F.lit(0).cast("bigint")
        placed = skew_join(rows, now, [key]).withColumns({"__base": base, "__due": due})
        goes = ~late & (openings("__total") > F.col("__base"))
        opened = now.filter(openings("__total") > openings("__old")).select(key, openings("__old").alias("__base"))
        released = held.filter(~late).join(opened, [key, "__base"], "left_semi").select(*cols)
        placed.filter(goes).select(*cols).unionByName(released).write.mode("overwrite").parquet(batch_folder(sink, batch_id))
        if wait:
            fallen = still(held.filter(late & alive), before).select(*cols) if bound is not None else held.select(*cols).limit(0)
            placed.filter(late).select(*cols).unionByName(fallen).write.mode("overwrite").parquet(batch_folder(expired, batch_id))
            latest = F.greatest(F.max(F.col(ts).cast("timestamp")), F.lit(bound).cast("timestamp"))
            rows.agg(latest.alias("ts")).write.mode("overwrite").parquet(batch_folder(seen, batch_id))
        placed.filter(~late & ~goes).select(*held_schema.names).write.mode("overwrite").parquet(batch_folder(waiting, batch_id))
        batch.unpersist()

    return for_each_batch(both, run, checkpoint)


def lookup_stream(df: DataFrame, dim: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Stream-static left join; the static side is read anew in each batch."""
    return lookup(df, dim, keys, cols)


def apply_changes_stream(df: DataFrame, keys: list[str], seq: list[str], sink: str, checkpoint: str) -> StreamingQuery:
    """Store the last change per key of each batch under ``sink``. The work of a batch depends on the batch only; the
    table is merged when it is read, see :func:`current_table`."""

    def run(batch: DataFrame, batch_id: int) -> None:
        latest_changes(batch, keys, seq).write.mode("overwrite").parquet(batch_folder(sink, batch_id))

    return for_each_batch(df, run, checkpoint)


def _folded(spark: SparkSession, sink: str) -> tuple[int, str | None, int]:
    """(version, folder, last batch) of the newest fold of a change log; version 0 holds nothing."""
    versions = f"{sink}-folds"
    path = spark._jvm.org.apache.hadoop.fs.Path(versions)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return 0, None, -1
    last = spark.read.schema("version bigint, folder string, upto bigint").parquet(versions).orderBy(F.desc("version")).first()
    return (last["version"], last["folder"], last["upto"]) if last else (0, None, -1)


def _switch(spark: SparkSession, sink: str, version: int, folder: str, upto: int) -> None:
    """Make a fold the one that counts: one row in one file, visible when it is complete."""
    row = spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(folder).alias("folder"), F.lit(upto).cast("bigint").alias("upto"))
    row.coalesce(1).write.mode("append").parquet(f"{sink}-folds")


def stored_changes(spark: SparkSession, sink: str) -> DataFrame:
    """The newest fold and the batches after it."""
    _, folder, upto = _folded(spark, sink)
    later = spark.read.parquet(sink).filter(F.col("batch_id") > upto).drop("batch_id")
    return later if folder is None else spark.read.schema(later.schema).parquet(folder).unionByName(later)


def fold_changes(spark: SparkSession, sink: str, keys: list[str], seq: list[str]) -> None:
    """Bring all batches but the last one, which may still be retried, into one table with the last change of each key.

    Deletions and the order columns stay in it, so a change that comes later but is older still loses. A reader sees the former
    fold until the new one is written and switched to; a fold that fails before that is written again by the next one. Folders
    of folded batches and of former folds are not read any more and may be removed once no reader is at work. The stream may run.
    """
    version, folder, upto = _folded(spark, sink)
    log = spark.read.parquet(sink)
    last = log.agg(F.max("batch_id").cast("bigint").alias("b")).first()["b"]
    if last is None or last - 1 <= upto:
        return
    changes = log.filter((F.col("batch_id") > upto) & (F.col("batch_id") < last)).drop("batch_id")
    if folder is not None:
        changes = spark.read.schema(changes.schema).parquet(folder).unionByName(changes)
    target = f"{sink}-fold/version={version + 1}"
    latest_changes(changes, keys, seq).write.mode("overwrite").parquet(target)
    _switch(spark, sink, version + 1, target, last - 1)


def current_table(target: DataFrame, sink: str, keys: list[str], seq: list[str], op: str) -> DataFrame:
    """The base table with all stored changes applied. What is read is bounded by the keys and the batches since the last
    :func:`fold_changes`."""
    return apply_changes(target, stored_changes(target.sparkSession, sink), keys, seq, op)


def route_sinks(df: DataFrame, routes: dict[str, Column | str], sink: str, checkpoint: str) -> StreamingQuery:
    """One folder per route from one pass over each batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        routed = route(batch, routes)
        routed.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route", "batch_id").parquet(sink)

    return for_each_batch(df, run, checkpoint)


def dead_letter_stream(df: DataFrame, rules: list[Rule], source: str, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Valid rows to ``good``, the others with their failed rules to the dead-letter folder ``bad``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        drop = [Rule(r.name, r.expression, "drop") for r in rules]
        keep(batch, drop).write.mode("overwrite").parquet(batch_folder(good, batch_id))
        broken = quarantine(batch, rules)
        to_dead_letter(broken, F.array_join("_failed_rules", ","), source).write.mode("overwrite").parquet(batch_folder(bad, batch_id))
        batch.unpersist()

    return for_each_batch(df, run, checkpoint)


def throttled(df: DataFrame, keys: list[str], ts: str, interval: str, n: int, order: list, sink: str, checkpoint: str, delay: str | None = None) -> StreamingQuery:
    """At most ``n`` records per key and interval over the whole stream, the first ones as they come.

    Each batch leaves a state for the next one: how many records of a key and interval went through, and the greatest time seen.
    A batch reads its own rows and the state of the batch before it, nothing older, and a retried batch reads the same state.
    With ``delay`` an interval that ended that long before the greatest time of the earlier batches leaves the state; records that
    still come for it are not throttled but written to ``sink``-late. Without ``delay`` every interval is kept. Records without a
    time have no interval and do not go through. A task passes on ``n`` records of a key and interval, so a hot key is no large group.
    """
    used, seen, late = f"{sink}-used", f"{sink}-seen", f"{sink}-late"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        slot = [*keys, "__w"]
        schema = T.StructType([*(batch.schema[k] for k in keys), T.StructField("__w", T.TimestampType()), T.StructField("__n", T.LongType())])
        before = spark.createDataFrame([], schema) if batch_id == 0 else spark.read.schema(schema).parquet(batch_folder(used, batch_id - 1))
        ends = lambda start: start.cast("timestamp") + F.expr(f"INTERVAL {interval}")
        batch.persist()
        bound = None
        if batch_id > 0:
            bound = spark.read.schema("ts timestamp").parquet(batch_folder(seen, batch_id - 1)).agg(F.max("ts").alias("m")).first()["m"]
        rows = batch
        if delay:
            limit = F.lit(bound).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            gone = F.coalesce(ends(F.window(ts, interval)["start"]) <= limit, F.lit(False)) if bound else F.lit(False)
            before = before.filter(ends(F.col("__w")) > limit) if bound else before
            marked = batch.withColumn("__gone", gone)
            marked.filter("__gone").drop("__gone").write.mode("overwrite").parquet(batch_folder(late, batch_id))
            rows = marked.filter("NOT __gone").drop("__gone")
        first = rate_limit(rows, keys, ts, interval, n, order).withColumn("__w", F.window(ts, interval)["start"].cast("timestamp"))
        rank = F.row_number().over(Window.partitionBy(*slot).orderBy(*order))  # n rows of a slot at most
        first = join_on(first.withColumn("__rn", rank), before.withColumnRenamed("__n", "__used"), slot)
        first = first.filter(F.col("__rn") + F.coalesce("__used", F.lit(0)) <= n).drop("__rn", "__used")
        first.persist()
        first.drop("__w").write.mode("overwrite").parquet(batch_folder(sink, batch_id))
        now = first.groupBy(*slot).agg(F.count(F.lit(1)).alias("__n"))
        now.unionByName(before).groupBy(*slot).agg(F.sum("__n").alias("__n")).write.mode("overwrite").parquet(batch_folder(used, batch_id))
        greatest = F.greatest(F.max(F.col(ts).cast("timestamp")), F.lit(bound).cast("timestamp"))
        batch.agg(greatest.alias("ts")).write.mode("overwrite").parquet(batch_folder(seen, batch_id))
        first.unpersist()
        batch.unpersist()

    return for_each_batch(df, run, checkpoint)


ROW_ID = ["__file", "__row"]
FOLD_EVERY = 50


def _log_before(spark: SparkSession, index: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """What batches before ``batch_id`` brought: the newest fold and the batches after it."""
    _, folder, upto = _folded(spark, index)
    paths = ([folder] if folder else []) + [batch_folder(index, b) for b in range(upto + 1, batch_id)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _fold_log(spark: SparkSession, log: str, schema: T.StructType, batch_id: int, shrink: Callable[[DataFrame], DataFrame]) -> None:
    """Bring all batches before ``batch_id`` into one table, every 50 batches. They are complete, so a retry changes nothing."""
    version, _, upto = _folded(spark, log)
    if batch_id - 1 - upto < FOLD_EVERY:
        return
    target = f"{log}-fold/version={version + 1}"
    shrink(_log_before(spark, log, schema, batch_id)).write.mode("overwrite").parquet(target)
    _switch(spark, log, version + 1, target, batch_id - 1)


def first_of_stream(rows: DataFrame, keys: list[str], index: str, batch_id: int, order: list | None = None) -> DataFrame:
    """Identities (``ROW_ID``) of the rows whose key came first: first in this batch, by ``order`` and then by place in the file,
    and in none of the earlier batches. NULL is a key like others.

    ``index`` holds every key once, in a folder per batch; each batch overwrites its own and reads those before it, so a retry
    decides the same. A batch reads key columns only, and of a first key that is a whole number or a text only the range of
    the batch: folds are sorted, so rising keys meet few row groups. Every 50 batches they are folded into one table. A task
    passes on one row of a key, so a hot key is no large group; what is joined is the batch's distinct keys.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys])
    _fold_log(spark, index, schema, batch_id, lambda seen: seen.sort(*keys))
    first = dedup(rows, keys, [*(order or []), *ROW_ID]).select(*keys, *ROW_ID)
    if batch_id > 0:
        first = stored(first, "batch-keys")
        before = _log_before(spark, index, schema, batch_id)
        if isinstance(schema[0].dataType, (T.IntegralType, T.StringType)):
            lo, hi = first.agg(F.min(keys[0]), F.max(keys[0])).first()
            before = before.filter(F.col(keys[0]).isNull() if lo is None else F.col(keys[0]).isNull() | F.col(keys[0]).between(lo, hi))
        first = join_on(first, join_on(before, first.select(*keys), keys, "left_semi"), keys, "left_anti")
    first.write.mode("overwrite").parquet(batch_folder(index, batch_id))
    return spark.read.schema(first.schema).parquet(batch_folder(index, batch_id)).select(*ROW_ID)


def _layer_rows(rows: DataFrame, rules: list[Rule], index: str, batch_id: int, order: list | None) -> tuple[DataFrame, DataFrame]:
    """(silver rows, quarantined rows with ``_failed_rules``) of a batch, unique rules over the whole stream."""
    simple = [r for r in rules if r.expression]
    kept, failed = keep(rows, simple), []
    for i, r in enumerate(rules):
        if not r.expression and r.parent is None:
            first = first_of_stream(kept, list(r.keys), f"{index}/{r.name}", batch_id, order)
            failed.append(kept.join(first, ROW_ID, "left_anti").select(*ROW_ID, F.struct(F.lit(i).alias("i"), F.lit(r.name).alias("name")).alias("__rule")))
            kept = kept.join(first, ROW_ID, "left_semi") if r.action == "drop" else kept
        elif not r.expression:
            kept = keep(kept, [r])
    repeated = reduce(DataFrame.unionByName, failed).groupBy(*ROW_ID).agg(F.array_sort(F.collect_list("__rule"))["name"].alias("__repeats"))
    broken = rows.withColumn("_failed_rules", failed_rules({r.name: r.expression for r in simple})).join(repeated, ROW_ID, "left")
    broken = broken.withColumn("_failed_rules", F.concat("_failed_rules", F.coalesce("__repeats", F.array().cast("array<string>"))))
    return kept.drop(*ROW_ID), broken.filter(F.size("_failed_rules") > 0).drop("__repeats", *ROW_ID)


def stream_layers(
    df: DataFrame, spec: TableSpec, rules: list[Rule], root: str, source: str, checkpoint: str, order: list | None = None
) -> StreamingQuery:
    """Bronze, silver, quarantine and gold folders from one stream. Unique rules hold over the whole stream: of the rows that
    satisfy the predicates, those that repeat a key of an earlier batch, or of an earlier row of the batch in ``order``, are
    quarantined, and with the action ``drop`` kept out of silver; see :func:`first_of_stream`."""
    over_stream = any(not r.expression and r.parent is None for r in rules)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bronze = to_bronze(batch, source, str(batch_id))
        bronze.write.mode("overwrite").parquet(batch_folder(f"{root}/bronze", batch_id))
        landed = spark.read.parquet(batch_folder(f"{root}/bronze", batch_id))
        if over_stream:
            landed = landed.withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
            kept, broken = _layer_rows(silver_rows(landed, spec.columns), rules, f"{root}/keys", batch_id, order)
        else:
            rows = silver_rows(landed, spec.columns)
            kept, broken = keep(rows, rules), quarantine(rows, rules)
        kept.withColumn("_processed_at", F.current_timestamp()).write.mode("overwrite").parquet(batch_folder(f"{root}/silver", batch_id))
        broken.write.mode("overwrite").parquet(batch_folder(f"{root}/quarantine", batch_id))
        silver = spark.read.parquet(batch_folder(f"{root}/silver", batch_id))
        gold = silver.drop("_processed_at").withColumn("_published_at", F.current_timestamp())
        gold.write.mode("overwrite").parquet(batch_folder(f"{root}/gold", batch_id))

    return for_each_batch(df, run, checkpoint)
