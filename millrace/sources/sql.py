"""SQL over DataFrames, and table statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """Run a query over named DataFrames: ``{name}`` in the text stands for a DataFrame, ``:name`` for a parameter."""
    return spark.sql(sql, args=args, **views)


def table_stats(spark: SparkSession, table: str, columns: bool = True) -> DataFrame:
    """Compute optimizer statistics of a table and return its extended description."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (" FOR ALL COLUMNS" if columns else ""))
    return spark.sql(f"DESCRIBE EXTENDED {table}")


def refresh(spark: SparkSession, table: str) -> None:
    spark.sql(f"REFRESH TABLE {table}")
