"""Change feeds and merges as joins, for tables without MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _picked(target: list[str], keys: list[str], found: Column, side: str) -> list[Column]:
    """Value of the update where there is one, else of the target."""
    rest = [c for c in target if c not in keys]
    return [F.when(found, F.col(f"{side}.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in rest]


def latest_changes(changes: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Last change per key, aggregated per task before the shuffle."""
    one = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.struct(*seq)).alias("r"))
    return one.select("r.*")


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], seq: list[str], op: str, deletes: tuple[str, ...] = ("delete",)) -> DataFrame:
    """The target after the last change of each key: inserted, updated or deleted."""
    last = latest_changes(changes, keys, seq)
    gone = F.col(f"u.{op}").isin(*deletes)
    joined = target.alias("t").join(last.withColumn("__u", F.lit(True)).alias("u"), keys, "full_outer")
    found = F.col("__u").isNotNull()
    kept = joined.filter(~(found & gone))
    return kept.select(*keys, *_picked(target.columns, keys, found, "u")).select(*target.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], seq: list[str] | None = None) -> DataFrame:
    """Matched rows replaced by the update (its NULLs included), others inserted. Of several updates of a key the last by
    ``seq`` holds; without ``seq`` a repeated key is an error."""
    if seq:
        updates = latest_changes(updates, keys, seq)
    else:
        twice = F.raise_error(F.concat(F.lit("several updates of one key: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
        one = updates.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*updates.columns)).alias("__r"))
        updates = one.select(F.when(F.col("__n") == 1, F.col("__r")).otherwise(twice).alias("__r")).select("__r.*")
    joined = target.alias("t").join(updates.withColumn("__u", F.lit(True)).alias("u"), keys, "full_outer")
    found = F.col("__u").isNotNull()
    return joined.select(*keys, *_picked(target.columns, keys, found, "u")).select(*target.columns)
