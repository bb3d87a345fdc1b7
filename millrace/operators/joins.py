"""Lookups, foreign keys and range joins.

No side is broadcast by a hint unless its size is bounded by construction: Catalyst and adaptive execution broadcast a
dimension when its measured size allows it, and otherwise join it by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import dense_index, skew_join


def lookup(
    df: DataFrame, dim: DataFrame, keys: list[str], cols: list[str], on_miss: dict | None = None,
    check_unique: bool = True, salted: bool = False,
) -> DataFrame:
    """Left join with a lookup table; adds ``matched``. A key that repeats in ``dim`` fails the query; a NULL key matches
    nothing.

    ``salted`` spreads hot keys of ``df`` explicitly, for a lookup table too large to broadcast.
    """
    side = dim.select(*keys, *cols).dropna(subset=keys)
    if check_unique:
        # counts of the keys alone; the table itself is joined as it is
        repeated = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("d")).scalar()
        guard = F.when(repeated > 0, F.raise_error(F.lit("lookup key is not unique")).cast("boolean"))
        side = side.withColumn("matched", F.coalesce(guard, F.lit(True)))
    else:
        side = side.withColumn("matched", F.lit(True))
    out = skew_join(df, side, keys) if salted else df.join(side, keys, "left")
    out = out.withColumn("matched", F.coalesce("matched", F.lit(False)))
    for c, value in (on_miss or {}).items():
        out = out.withColumn(c, F.when(F.col("matched"), F.col(c)).otherwise(F.lit(value)))
    return out


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows with a foreign key that has no parent (a NULL key refers to nothing and is no orphan)."""
    keys = parent.select(F.col(pk).alias("__pk")).distinct()
    return child.filter(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__pk"), "left_anti")


def orphan_ratio(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """One row: children, orphans, ratio. Children are counted per key before the join, so hot keys cost nothing."""
    per_key = child.groupBy(F.col(fk).alias("__fk")).agg(F.count(F.lit(1)).alias("__n"))
    keys = parent.select(F.col(pk).alias("__pk")).distinct()
    joined = per_key.join(keys, F.col("__fk") == F.col("__pk"), "left")
    lost = F.sum(F.when(F.col("__pk").isNull() & F.col("__fk").isNotNull(), F.col("__n")).otherwise(0))
    totals = joined.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("children"), F.coalesce(lost, F.lit(0)).alias("orphans"))
    return totals.withColumn("orphan_ratio", F.round(F.col("orphans") / F.greatest("children", F.lit(1)), 6))


def valid_children(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    keys = parent.select(F.col(pk).alias("__pk"))
    return child.join(keys, F.col(fk) == F.col("__pk"), "left_semi")


def assign_fk(child: DataFrame, parent: DataFrame, pk: str, fk: str, draw: Column, parents: int | None = None) -> DataFrame:
    """Give each child row the parent key at position ``floor(draw * parents)`` of the dense key index.

    Positions are uniform, so the join is even however large the parent is.
    """
    index = dense_index(parent.select(F.col(pk).alias(fk)), fk, "__idx")
    n = F.lit(parents) if parents is not None else parent.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = child.withColumn("__idx", F.floor(draw * n.cast("double")).cast("bigint"))
    return placed.join(index, "__idx", "left").drop("__idx")


def discover_fks(key_usage: DataFrame, constraint_usage: DataFrame) -> DataFrame:
    """Foreign keys from the two standard metadata views."""
    k = key_usage.select("constraint_name", F.col("table_name").alias("table"), F.col("column_name").alias("column"))
    c = constraint_usage.select(
        "constraint_name", F.col("table_name").alias("references_table"), F.col("column_name").alias("references_column")
    )
    return k.join(c, "constraint_name").filter(F.lower("constraint_name").contains("fk"))


def ipv4_to_long(ip: Column) -> Column:
    """Dotted address as a number, NULL if malformed."""
    ok = ip.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    parts = F.split(ip, r"\.")
    octets = [F.get(parts, F.lit(i)).cast("bigint") for i in range(4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ok, value)


BLOCK = 65536


def range_enrich(df: DataFrame, ranges: DataFrame, ip: str, lo: str, hi: str, cols: list[str]) -> DataFrame:
    """Left join of addresses (numbers) with non-overlapping ranges ``lo..hi``.

    Works on distinct addresses in blocks of 65,536: a block has at most 65,536 addresses and as many ranges, so the
    window that carries the last range start to each address is bounded. No pairs are formed.
    """
    points = df.select(F.col(ip).alias("__a")).distinct().filter("__a is not null")
    last = F.floor(F.col(hi) / BLOCK)
    cut = ranges.withColumn("__block", F.explode(F.sequence(F.floor(F.col(lo) / BLOCK), last)))
    starts = cut.select(
        "__block",
        F.greatest(F.col(lo), F.col("__block") * BLOCK).alias("__a"),
        F.lit(0).alias("__kind"),
        F.struct(F.col(hi).alias("__hi"), *cols).alias("__range"),
    )
    asked = points.select(
        F.floor(F.col("__a") / BLOCK).alias("__block"), "__a", F.lit(1).alias("__kind"),
        F.lit(None).cast(starts.schema["__range"].dataType).alias("__range"),
    )
    w = Window.partitionBy("__block").orderBy("__a", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = starts.unionByName(asked).withColumn("__range", F.last("__range", ignorenulls=True).over(w))
    found = carried.filter((F.col("__kind") == 1) & (F.col("__a") <= F.col("__range.__hi")))
    hits = found.select(F.col("__a").alias(ip), *[F.col(f"__range.{c}").alias(c) for c in cols])
    return df.join(hits, ip, "left")
