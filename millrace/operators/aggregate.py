"""Aggregations that are not part of the profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def with_row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    """Append the number of rows, as a scalar subquery."""
    return df.withColumn(name, df.agg(F.count(F.lit(1)).alias("n")).scalar())


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Count rows while they pass; read ``observation.get`` after an action."""
    seen = Observation(name)
    extra = [c.alias(n) for n, c in metrics.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *extra), seen


def group_sum_count(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"))


def string_agg(
    df: DataFrame, keys: list[str], col: str, sep: str, order: str | None = None, distinct: bool = False,
    name: str = "joined",
) -> DataFrame:
    """Texts of a group joined in order, as GROUP_CONCAT / STRING_AGG do; the result is one text per group."""
    if distinct:
        df = df.select(*keys, col).distinct()
    text = sep.replace("\\", "\\\\").replace("'", "\\'")
    return df.groupBy(*keys).agg(F.expr(f"listagg(`{col}`, '{text}') within group (order by `{order or col}`)").alias(name))


def distinct_per_group(df: DataFrame, keys: list[str], col: str, exact: bool = True, name: str = "distinct_count") -> DataFrame:
    """Distinct values per group: exact, or a HyperLogLog estimate."""
    return df.groupBy(*keys).agg((F.count_distinct(col) if exact else F.approx_count_distinct(col)).alias(name))


def crawl_totals(meta: DataFrame) -> DataFrame:
    """Tables, columns and rows per source from a table list."""
    return meta.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.sum("n_columns").alias("total_columns"),
        F.sum("row_count").alias("total_rows"),
    )


def execution_report(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of statuses and the success rate in percent, overall or by role."""
    out = log.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("status") == "SUCCESS").alias("successes"),
        F.count_if(F.col("status") == "FAILED").alias("failures"),
        F.count_if(F.col("status").isin("RECOVERED", "PASSTHROUGH", "DLQ")).alias("recovered"),
        F.sum(F.coalesce("rows_processed", F.lit(0))).alias("rows_processed"),
    )
    return out.withColumn("success_rate", F.round(F.col("successes") * 100.0 / F.greatest("steps", F.lit(1)), 1))


def retention(sources: list[DataFrame], sinks: list[DataFrame]) -> DataFrame:
    """Rows that went in, rows that came out, and their ratio in percent (NULL if either is empty)."""

    def total(dfs: list[DataFrame], name: str) -> DataFrame:
        counts = [d.agg(F.count(F.lit(1)).alias("n")) for d in dfs]
        all_counts = counts[0]
        for c in counts[1:]:
            all_counts = all_counts.unionAll(c)
        return all_counts.agg(F.sum("n").alias(name))

    both = total(sources, "source_rows").withColumn("sink_rows", total(sinks, "sink_rows").scalar())
    ratio = F.round(F.col("sink_rows") * 100.0 / F.col("source_rows"), 1)
    positive = (F.col("sink_rows") > 0) & (F.col("source_rows") > 0)
    return both.withColumn("data_retention_pct", F.when(positive, ratio))
