"""Bronze, silver and gold layers."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.project import enforce
from millrace.operators.windows import dedup
from millrace.plans.quality import Rule, apply_rules, not_all_null, rules_sql
from millrace.spec import NOT_NULL_DEFAULTS, Blueprint, ColumnSpec, TableSpec, spark_type

log = logging.getLogger(__name__)

BRONZE_META = ("_ingested_at", "_source", "_batch_id")


def to_bronze(df: DataFrame, source: str, batch: str) -> DataFrame:
    """Rows as they are, with time, source and batch."""
    return df.withColumns({"_ingested_at": F.current_timestamp(), "_source": F.lit(source), "_batch_id": F.lit(batch)})


def silver_rows(bronze: DataFrame, spec: list[ColumnSpec]) -> DataFrame:
    """Bronze metadata dropped, schema enforced."""
    return enforce(bronze.drop(*BRONZE_META), spec)


def to_silver(
    bronze: DataFrame, spec: TableSpec, rules: list[Rule] | None = None, order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(silver rows, violations). All-NULL rows are dropped by default, before NOT NULL columns are filled."""
    data = bronze.drop(*BRONZE_META)
    data = data.filter(not_all_null(data).expression)
    kept, found = apply_rules(enforce(data, spec.columns), rules or [], spec.name, "silver", order)
    return kept.withColumn("_processed_at", F.current_timestamp()), found


def to_gold(silver: DataFrame, keys: list[str] | None = None, aggs: dict[str, Column] | None = None) -> DataFrame:
    """A published copy, or aggregates by ``keys``."""
    rows = silver.drop("_processed_at")
    if aggs:
        rows = rows.groupBy(*(keys or [])).agg(*[c.alias(n) for n, c in aggs.items()])
    return rows.withColumn("_published_at", F.current_timestamp())


def clean_stats(bronze: DataFrame, spec: list[ColumnSpec], order: list[str] | None = None) -> DataFrame:
    """What cleaning does to a table: rows in, rows dropped (all NULL, or a repeated primary key of which the first row
    in ``order`` stays), NULLs filled in NOT NULL columns."""
    data = bronze.drop(*BRONZE_META)
    have = set(data.columns)
    total = data.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = data.filter(not_all_null(data).expression)
    keys = [c.name for c in spec if c.primary_key and c.name in have]
    if keys:
        kept = dedup(kept, keys, order or keys)

    def filled(c: ColumnSpec) -> Column:
        kind = spark_type(c.data_type)
        value = F.col(c.name).try_cast(kind) if c.name in have else F.lit(None)
        return F.count_if(value.isNull()).cast("bigint")

    must = [c for c in spec if not c.nullable and spark_type(c.data_type).split("(")[0] in NOT_NULL_DEFAULTS]
    nulls = F.lit(0).cast("bigint")
    for c in must:
        nulls = nulls + filled(c)
    counts = kept.agg(F.count(F.lit(1)).alias("kept"), nulls.alias("nulls_filled")).withColumn("rows_in", total)
    return counts.select("rows_in", (F.col("rows_in") - F.col("kept")).alias("rows_dropped"), "nulls_filled")


@dataclass
class LayerResult:
    """Row counts per layer and table, violations per table, and the tables that failed with their error."""

    rows: dict[str, dict[str, int]] = field(default_factory=lambda: {"bronze": {}, "silver": {}, "gold": {}})
    violations: dict[str, list[dict]] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    @property
    def success(self) -> bool:
        return not self.failed


def _write(df: DataFrame, path: str, label: str) -> int:
    """Write and count in the same pass."""
    seen = Observation(label)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def run_layers(
    spark: SparkSession, tables: dict[str, DataFrame], blueprint: Blueprint, root: str, rules: list[Rule] | None = None,
    batch: str = "1",
) -> LayerResult:
    """Take every table through the three layers under ``root``; one failing table does not stop the others."""
    result = LayerResult()
    for name, df in tables.items():
        try:
            path = {layer: f"{root}/{layer}/{name}" for layer in ("bronze", "silver", "gold")}
            result.rows["bronze"][name] = _write(to_bronze(df, blueprint.source, batch), path["bronze"], f"bronze_{name}")
            silver, found = to_silver(spark.read.parquet(path["bronze"]), blueprint.table(name), rules)
            result.rows["silver"][name] = _write(silver, path["silver"], f"silver_{name}")
            result.violations[name] = [r.asDict() for r in found.collect()]
            gold = to_gold(spark.read.parquet(path["silver"]))
            result.rows["gold"][name] = _write(gold, path["gold"], f"gold_{name}")
        except Exception as e:  # noqa: BLE001 - reported per table
            log.warning("layer run failed for %s: %s", name, e)
            result.failed[name] = str(e)
    return result


def declared_layers(table: str, rules: list[Rule]) -> str:
    """The same flow as declarative streaming and materialized table definitions."""
    constraints = ",\n  ".join(rules_sql([r for r in rules if r.expression]))
    head = f" (\n  {constraints}\n)" if constraints else ""
    return (
        f"CREATE OR REFRESH STREAMING TABLE bronze_{table} AS\n"
        f"SELECT *, current_timestamp() AS _ingested_at FROM STREAM source_{table};\n\n"
        f"CREATE OR REFRESH STREAMING TABLE silver_{table}{head} AS\n"
        f"SELECT * EXCEPT (_ingested_at), current_timestamp() AS _processed_at FROM STREAM bronze_{table};\n\n"
        f"CREATE OR REFRESH MATERIALIZED VIEW gold_{table} AS\n"
        f"SELECT *, current_timestamp() AS _published_at FROM silver_{table};\n"
    )
