"""Time windows, deduplication, ordering, limits and samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import micros, skew_join, with_previous

MICROS = 1_000_000


def tumbling(
    df: DataFrame, ts: str, width: str, aggs: dict[str, Column], keys: list[str] | None = None,
    slide: str | None = None, watermark: str | None = None,
) -> DataFrame:
    """Aggregates per time window; with ``slide`` a sliding window, with ``watermark`` for streams."""
    if watermark:
        df = df.withWatermark(ts, watermark)
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = df.groupBy(span, *(keys or [])).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(keys or []), *aggs
    )


def rolling(
    df: DataFrame, keys: list[str], ts: str, seconds: int, aggs: dict[str, Column], chunk_seconds: int = 3600,
    merge: dict[str, Callable[[Column, Column], Column]] | None = None,
) -> DataFrame:
    """For each row, aggregates over the rows of its key in the last ``seconds`` (both ends included). Rows without a time are
    each other's peers, as in a RANGE frame: they get the aggregates over all such rows of their key.

    A key is cut into time chunks, and rows that reach into the next chunk are copied there for looking back only, so
    a window partition is one (key, chunk) and not the whole key.

    ``merge`` tells for each aggregate how its values over two parts of a window make the value over both: their sum for a sum or
    a count, the smaller one for a minimum. With it the work grows with the rows; without it with the rows times the rows of a window,
    since Spark goes over each window anew. A value that is NULL over one part (a sum without values) is left to the other.
    """
    timeless = df.filter(F.col(ts).isNull())
    peers = skew_join(timeless, timeless.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)
    t = df.withColumn("__t", micros(F.col(ts))).filter("__t is not null")
    if merge and seconds > 0:
        return _merged(t, keys, seconds * MICROS, aggs, merge).select(*df.columns, *aggs).unionByName(peers)
    size = max(chunk_seconds, seconds) * MICROS
    own = F.floor(F.col("__t") / F.lit(size))
    reach = F.floor((F.col("__t") + F.lit(seconds * MICROS)) / F.lit(size))
    spread = t.withColumn("__own", own).withColumn("__chunk", F.explode(F.sequence(own, reach)))
    w = Window.partitionBy(*keys, "__chunk").orderBy("__t").rangeBetween(-seconds * MICROS, 0)
    out = spread.withColumns({n: c.over(w) for n, c in aggs.items()})
    return out.filter(F.col("__own") == F.col("__chunk")).drop("__t", "__own", "__chunk").unionByName(peers)


def _merged(t: DataFrame, keys: list[str], size: int, aggs: dict[str, Column], merge: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Chunks as long as a window: a window is the first rows of its chunk and the last rows of the chunk before. The aggregates
    over all first rows and over all last rows grow row by row, and each row meets the two that are its own."""
    chunk = F.col("__t") - F.pmod("__t", F.lit(size))
    # copy 1 of a row stands in the next chunk, at the time when it leaves the window
    rows = t.withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"__chunk": chunk + F.col("__copy") * size, "__at": F.col("__t") + F.col("__copy") * size})
    rows = rows.repartition(*keys, "__chunk")
    side = Window.partitionBy(*keys, "__chunk", "__copy")
    first = side.orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    last = side.orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__first_{n}": c.over(first) for n, c in aggs.items()}).withColumns({f"__last_{n}": c.over(last) for n, c in aggs.items()})
    # the copy that leaves next
    left = F.when(F.col("__copy") == 1, F.struct(*[F.col(f"__last_{n}").alias(n) for n in aggs]))
    back = Window.partitionBy(*keys, "__chunk").orderBy(F.desc("__at"), F.desc("__copy")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__past", F.last(left, ignorenulls=True).over(back)).filter("__copy = 0")
    own, past = {n: F.col(f"__first_{n}") for n in aggs}, {n: F.col("__past").getField(n) for n in aggs}
    return rows.withColumns({n: F.when(past[n].isNull(), own[n]).when(own[n].isNull(), past[n]).otherwise(merge[n](past[n], own[n])) for n in aggs})


def dedup(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. Spark keeps one row per key and task before it shuffles (WindowGroupLimit)."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def duplicates(df: DataFrame, keys: list[str], action: str = "drop", order: list | None = None) -> DataFrame:
    """``drop`` keeps one row per key; ``mark`` adds the number of rows with the same key and a flag."""
    if action == "drop":
        return dedup(df, keys, order) if order else df.dropDuplicates(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return skew_join(df, counts, keys).withColumn("is_duplicate", F.col("copies") > 1)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key, as one aggregate with a partial step before the shuffle."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return picked.select("__r.*")


def enforce_order(
    df: DataFrame, keys: list[str], seq: str, chunk_size: int | None = None, order: list[str] | None = None
) -> DataFrame:
    """Per key, the preceding sequence value and the number of missing values before the row. A frequent key is cut at
    quantiles of its rows, or, with ``chunk_size``, at multiples of it."""
    chunk = F.floor(F.col(seq) / F.lit(chunk_size)) if chunk_size else None
    out = with_previous(df, keys, order or [seq], chunk, {"previous": seq})
    return out.withColumn("missing", F.coalesce(F.col(seq) - F.col("previous") - 1, F.lit(0)))


def gaps(df: DataFrame, keys: list[str], ts: str, seconds: int, tie: str, chunk: str | None = None) -> DataFrame:
    """Rows that follow a silence of their key longer than ``seconds``. A frequent key is cut at quantiles of its rows, or,
    with ``chunk``, by that unit of time."""
    cut = F.date_trunc(chunk, F.col(ts).cast("timestamp")) if chunk else None
    out = with_previous(df, keys, [ts, tie], cut, {"previous_ts": ts})
    idle = (micros(F.col(ts)) - micros(F.col("previous_ts"))) / F.lit(float(MICROS))
    return out.withColumn("idle_seconds", idle).filter(F.col("idle_seconds") > seconds)


def rate_limit(df: DataFrame, keys: list[str], ts: str, interval: str, n: int, order: list) -> DataFrame:
    """At most ``n`` records of a key per interval, the first ones in ``order``."""
    cut = df.withColumn("__w", F.window(ts, interval)["start"])
    return top_k(cut, [*keys, "__w"], order, n).drop("__w")


def sort_rows(df: DataFrame, order: list, within_partitions: bool = False) -> DataFrame:
    return df.sortWithinPartitions(*order) if within_partitions else df.orderBy(*order)


def _hash_unit(key: str, seed: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def sample_fraction(df: DataFrame, fraction: float = 0.1, key: str | None = None, seed: int = 42) -> DataFrame:
    """Bernoulli sample: repeatable by the hash of ``key``, else Spark's ``sample``."""
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.filter(_hash_unit(key, seed) < F.lit(fraction))


def sample_rows(df: DataFrame, n: int, key: str | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows: the smallest hashes of the key, else of the whole row (repeatable, one top-n per task)."""
    if key is None:
        return df.orderBy(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")])).limit(n)
    return df.orderBy(_hash_unit(key, seed), key).limit(n)
