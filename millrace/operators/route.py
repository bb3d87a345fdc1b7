"""Routing. A NULL predicate never matches a route and always makes a record invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import row_salt

UNMATCHED = "unmatched"


def _cond(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def routes_of(routes: dict[str, Column | str], mode: str = "all") -> Column:
    """Array of the names of the routes a row takes; ``["unmatched"]`` if none."""
    hits = [F.when(_cond(c), F.lit(name)) for name, c in routes.items()]
    if mode == "first":
        return F.array(F.coalesce(*hits, F.lit(UNMATCHED)))
    taken = F.array_compact(F.array(*hits))
    return F.when(F.size(taken) == 0, F.array(F.lit(UNMATCHED))).otherwise(taken)


def route(df: DataFrame, routes: dict[str, Column | str], mode: str = "all", name: str = "route") -> DataFrame:
    """One row per route taken, in a single pass over the input."""
    return df.withColumn(name, F.explode(routes_of(routes, mode)))


def route_regex(df: DataFrame, col: str, patterns: dict[str, str], name: str = "route") -> DataFrame:
    return route(df, {n: F.col(col).rlike(p) for n, p in patterns.items()}, name=name)


def branch(df: DataFrame, routes: list[str], name: str = "route") -> dict[str, DataFrame]:
    """One DataFrame per route; persist ``df`` first if several of them are consumed."""
    return {r: df.filter(F.col(name) == r).drop(name) for r in [*routes, UNMATCHED]}


def route_mime(df: DataFrame, col: str, name: str = "route") -> DataFrame:
    """Content type by the first characters of the text."""
    text = F.col(col)
    kinds = {"json": text.rlike(r"^\s*[\{\[]"), "xml": text.rlike(r"^\s*<"), "csv": text.contains(",")}
    return route(df, kinds, mode="first", name=name)


def scan(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.filter(F.col(col).rlike(pattern))


def failed_rules(rules: dict[str, Column | str]) -> Column:
    """Names of the rules a row does not satisfy."""
    broken = [F.when(~F.coalesce(_cond(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]
    return F.array_compact(F.array(*broken))


def split_valid(df: DataFrame, rules: dict[str, Column | str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with ``_failed_rules``)."""
    marked = df.withColumn("_failed_rules", failed_rules(rules))
    return (
        marked.filter(F.size("_failed_rules") == 0).drop("_failed_rules"),
        marked.filter(F.size("_failed_rules") > 0),
    )


def distribute(df: DataFrame, n: int, by: str | None = None, name: str = "bucket") -> DataFrame:
    """Spread rows over ``n`` outputs: by a number column, else by the content and input partition of the row."""
    return df.withColumn(name, F.pmod(F.col(by), F.lit(n)).cast("int") if by else row_salt(df, n))


def partition_by(df: DataFrame, field: str, salts: int = 16) -> DataFrame:
    """Bring records of one field value together, in up to ``salts`` partitions, so that a frequent value is not one task;
    ``salts`` 1 puts each value into one partition."""
    if salts == 1:
        return df.repartition(F.col(field))
    return df.withColumn("__salt", row_salt(df, salts)).repartition(F.col(field), F.col("__salt")).drop("__salt")


def to_dead_letter(df: DataFrame, error: Column | str, source: str, stamped: bool = True) -> DataFrame:
    """Rejected rows as (source, error, record JSON, time)."""
    payload = [c for c in df.columns if not c.startswith("_")]
    out = df.select(
        F.lit(source).alias("_source"),
        (F.lit(error) if isinstance(error, str) else error).alias("_error"),
        F.to_json(F.struct(*payload)).alias("_record"),
    )
    return out.withColumn("_rejected_at", F.current_timestamp()) if stamped else out
