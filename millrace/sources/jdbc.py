"""JDBC tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Driver classes by the name found in a URL or connection name.
DRIVERS = {
    "oracle": "oracle.jdbc.driver.OracleDriver",
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver",
}


def driver_for(name: str) -> str | None:
    return next((d for key, d in DRIVERS.items() if key in name.lower()), None)


def _options(url: str, driver: str | None) -> dict[str, str]:
    chosen = driver or driver_for(url)
    return {"url": url, **({"driver": chosen} if chosen else {})}


def read_jdbc(
    spark: SparkSession, url: str, table_or_query: str, column: str | None = None, lo=None, hi=None, n: int = 8,
    fetch_size: int = 10000, driver: str | None = None,
) -> DataFrame:
    """A table, or a query as a subquery; with ``column`` the read is split into ``n`` ranges between ``lo`` and ``hi``.
    Filters and columns are pushed into the database."""
    source = table_or_query
    if table_or_query.lstrip().lower().startswith("select"):
        source = f"({table_or_query}) subq"
    reader = spark.read.format("jdbc").options(**_options(url, driver)).option("dbtable", source).option("fetchsize", fetch_size)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", lo).option("upperBound", hi).option("numPartitions", n)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000, mode: str = "append", connections: int = 8, driver: str | None = None) -> None:
    """Batched inserts over at most ``connections`` connections."""
    (
        df.write.format("jdbc").options(**_options(url, driver)).option("dbtable", table).option("batchsize", batch_size)
        .option("numPartitions", connections).mode(mode).save()
    )


def read_incremental(df: DataFrame, column: str, last_max) -> tuple[DataFrame, DataFrame]:
    """(rows above the stored maximum, one row with the new maximum); the filter is pushed to the source."""
    delta = df if last_max is None else df.filter(F.col(column) > F.lit(last_max))
    start = F.lit(last_max) if last_max is not None else F.lit(None)
    return delta, delta.agg(F.coalesce(F.max(column), start).alias("new_max"))
