"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by name; a column an input lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def unmatched_except(df: DataFrame, *matched: DataFrame) -> DataFrame:
    """Rows of ``df`` in none of the others, copies counted."""
    return df.exceptAll(union_all(*matched))


def replicate(df: DataFrame, n: int, name: str = "copy") -> DataFrame:
    """``n`` copies of every row from one scan."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def name_diff(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Names added to or removed from a list, with ``change``."""
    a = previous.select(*keys).distinct().withColumn("__a", F.lit(1))
    b = current.select(*keys).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed")
    return both.select(*keys, change.alias("change")).filter("change is not null")


def name_intersect(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return previous.select(*keys).intersect(current.select(*keys))
