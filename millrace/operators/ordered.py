"""Order-dependent computations that do not put a whole key into one task.

A key may hold a third of all rows. Rows of such a key are therefore cut into chunks of their order value; each (key,
chunk) is a window partition of its own and a small table of chunk values carries over the cuts. Results are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Time as a bigint of microseconds, for TIMESTAMP and TIMESTAMP_NTZ."""
    return F.unix_micros(ts.cast("timestamp"))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on keys of the same names, NULL matching NULL; the key columns of the left side stay."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.001) -> DataFrame:
    """Keys holding at least ``share`` of the rows. By arithmetic there are at most 1/share of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    return counts.filter(F.col("__n") >= F.lit(share) * total).select(*keys)


def skew_join(
    big: DataFrame, unique: DataFrame, keys: list[str], how: str = "left", salts: int = 32, share: float = 0.001
) -> DataFrame:
    """Join a table that may hold hot keys with a table holding each key once.

    Only the hot keys (at most 1/share, hence broadcast) are salted: their rows spread over ``salts`` tasks and their
    one row of the other side is copied ``salts`` times. The salt depends on the row and on its input partition, so
    identical copies spread too and a retried task gives the same salts.
    """
    hot = F.broadcast(hot_keys(big, keys, share).withColumn("__hot", F.lit(True)))
    spread = row_salt(big, salts)
    left = join_on(big, hot, keys).withColumn("__salt", F.when(F.col("__hot"), spread).otherwise(F.lit(0))).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = join_on(unique, hot, keys).withColumn("__salt", F.explode(copies)).drop("__hot")
    return join_on(left, right, [*keys, "__salt"], how).drop("__salt")


def row_salt(df: DataFrame, salts: int) -> Column:
    """A number below ``salts`` from the content and the input partition of a row."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(df)]) + F.spark_partition_id(), F.lit(salts)).cast("int")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def _keyed(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """Add the key as one struct and the chunk. A struct with NULL fields equals itself, so windows and joins agree on
    NULL keys, and a plain equality keeps the partitioning of the window for the join."""
    return df.withColumn("__key", F.struct(*(keys or [F.lit(0).alias("all")]))).withColumn("__chunk", chunk)


def _carried(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Join the one row per (key, chunk) of ``side`` to rows already partitioned that way."""
    side = side.withColumnsRenamed({"__key": "__r_key", "__chunk": "__r_chunk"})
    return rows.join(side, (F.col("__key") == F.col("__r_key")) & (F.col("__chunk") == F.col("__r_chunk")), "left")


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, columns: dict[str, str], share: float = 0.001, parts: int = 256
) -> DataFrame:
    """Add, for every row, values of the preceding row of its key. ``columns`` maps new name to source column.

    Only keys with at least ``share`` of the rows are cut, by ``chunk``, which must not decrease along ``order`` (for
    example the hour of the first order column). Without ``chunk`` each such key is cut at quantiles of its own values of the
    first order column (a number or a time), so that its ``parts`` hold about as many rows each, however its rows lie. The
    last row of each chunk is carried into the next one.
    """
    by_rows, chunk = chunk is None, F.lit(None) if chunk is None else chunk
    picked = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    keyed = _keyed(df, keys, chunk)
    hot = hot_keys(keyed, ["__key"], share).select(F.col("__key").alias("__h_key"), F.lit(True).alias("__hot"))
    # at most 1/share keys
    cut = keyed.join(F.broadcast(hot), F.col("__key") == F.col("__h_key"), "left")
    if by_rows:
        kind = df.schema[order[0]].dataType.typeName()
        place = micros(F.col(order[0])) if kind.startswith(("timestamp", "date")) else F.col(order[0])
        cut = cut.withColumn("__place", place.cast("double"))
        # at most 1/share keys with ``parts`` numbers each
        points = cut.filter("__hot").groupBy("__key").agg(F.percentile_approx("__place", [k / parts for k in range(1, parts)], 10000).alias("__points"))
        points = F.broadcast(points.withColumnRenamed("__key", "__p_key"))
        cut = cut.join(points, F.col("__key") == F.col("__p_key"), "left")
        # how many points lie below, as a binary search
        steps = F.array(*[F.lit(2**b) for b in reversed(range(parts.bit_length()))])
        below = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.get("__points", at + s - 1) < F.col("__place"), s).otherwise(0))
        cut = cut.withColumn("__chunk", below)
    cut = cut.withColumn("__chunk", F.when(F.col("__hot"), F.col("__chunk")))
    inside = Window.partitionBy("__key", "__chunk").orderBy(*order)
    rows = cut.withColumn("__prev", F.lag(picked).over(inside))
    last = cut.filter("__hot").groupBy("__key", "__chunk").agg(F.max_by(picked, F.struct(*order)).alias("__last"))
    across = Window.partitionBy("__key").orderBy("__chunk")
    carry = last.select("__key", "__chunk", F.lag("__last").over(across).alias("__carry"))
    out = _carried(rows, carry)
    previous = F.coalesce(F.col("__prev"), F.col("__carry"))
    return out.select(*df.columns, *[previous.getField(new).alias(new) for new in columns])


def cut_points(df: DataFrame, value: str, n: int = 256) -> list:
    """At most ``n - 1`` values that split a column into about equal parts (a sketch, a few numbers on the driver)."""
    row = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10000).alias("p")).first()
    return sorted(set(row["p"] or []))


def chunk_of(value: Column, points: list) -> Column:
    """Index of the part a value falls into, as a binary search in nested CASE expressions."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(points[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(points))


def with_fine_chunk(df: DataFrame, value: str, name: str, points: list, lo, hi, parts: int = 256) -> DataFrame:
    """Add a chunk number: each part between two cut points is divided again into ``parts`` of equal width. ``lo`` and
    ``hi`` are the extremes of the values; the number does not decrease with the value."""
    if lo is None or not points:
        return df.withColumn(name, F.lit(0))
    bounds = F.array(*[F.lit(float(b)) for b in (lo, *points, hi)])
    coarse = df.withColumn("__coarse", chunk_of(F.col(value), points))
    left, right = F.get(bounds, F.col("__coarse")), F.get(bounds, F.col("__coarse") + 1)
    share = F.coalesce(F.try_divide(F.col(value).cast("double") - left, right - left), F.lit(0.0))
    fine = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts)))
    return coarse.withColumn(name, F.col("__coarse") * parts + fine).drop("__coarse")


def with_running_sum(
    df: DataFrame, keys: list[str], order: str, chunk: Column, sums: dict[str, str]
) -> DataFrame:
    """Inclusive running sums along ``order`` within ``keys``; ``order`` values must be unique per key."""
    cut = _keyed(df, keys, chunk)
    inside = Window.partitionBy("__key", "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumns({f"__in_{n}": F.sum(src).over(inside) for n, src in sums.items()})
    totals = cut.groupBy("__key", "__chunk").agg(*[F.sum(src).alias(f"__t_{n}") for n, src in sums.items()])
    # one row per chunk of a key
    before = Window.partitionBy("__key").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__key", "__chunk", *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in sums])
    out = _carried(rows, offsets)
    total = [(F.col(f"__in_{n}") + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n) for n in sums]
    return out.select(*df.columns, *total)


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Number the rows of a table with a unique key 0..n-1, in the order of (md5(key), key).

    md5 spreads the keys evenly, so its first three hex digits cut the order into 4096 equal chunks; only their counts
    are ordered globally.
    """
    digest = F.md5(F.col(key).cast("string"))
    rows = df.withColumn("__h", digest).withColumn("__chunk", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__chunk").orderBy("__h", key)
    numbered = rows.withColumn("__rn", F.row_number().over(inside))
    # the offsets table has at most 4096 rows
    return (
        numbered.join(F.broadcast(offsets), "__chunk")
        .withColumn(name, F.col("__off") + F.col("__rn") - 1)
        .drop("__h", "__chunk", "__off", "__rn")
    )
