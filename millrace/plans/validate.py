"""Comparison of a table with its specification, and scores."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ordered import with_fine_chunk, with_running_sum
from millrace.plans.generate import generate_all, rows_of
from millrace.plans.layers import LayerResult, run_layers
from millrace.plans.profile import statistics
from millrace.plans.quality import Rule
from millrace.spec import DEFAULTS, Blueprint, ColumnSpec, Settings, TableSpec, spark_type


def compare_columns(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("column_name",)) -> DataFrame:
    """Full outer join of two column lists (keys, data_type) with status match, missing, extra or type_mismatch; columns
    starting with an underscore are not compared."""
    named = ~F.startswith("column_name", F.lit("_"))
    want = expected.filter(named).select(*keys, F.col("data_type").alias("expected_type"))
    have = actual.filter(named).select(*keys, F.col("data_type").alias("actual_type"))
    status = (
        F.when(F.col("actual_type").isNull(), "missing").when(F.col("expected_type").isNull(), "extra")
        .when(F.col("actual_type") != F.col("expected_type"), "type_mismatch").otherwise("match")
    )
    return want.join(have, list(keys), "full_outer").withColumn("status", status)


def compare_schema(df: DataFrame, spec: list[ColumnSpec]) -> DataFrame:
    """Compare a table with its specification; types in their canonical Spark form."""
    spark = df.sparkSession
    want = [(c.name, spark_type(c.data_type)) for c in spec]
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    kind = "column_name string, data_type string"
    return compare_columns(spark.createDataFrame(want, kind), spark.createDataFrame(have, kind))


def schema_score(comparison: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Matched columns over expected ones, overall or per table; 1 if nothing is expected."""
    counts = comparison.groupBy(*by).agg(
        F.count_if(F.col("status") == "match").alias("matched"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "extra").alias("extra"),
        F.count_if(F.col("status") == "type_mismatch").alias("type_mismatches"),
    )
    expected = F.col("matched") + F.col("missing") + F.col("type_mismatches")
    return counts.withColumn("score", F.when(expected == 0, 1.0).otherwise(F.col("matched") / expected))


def fidelity_columns(expected: DataFrame, actual: DataFrame, scale: float = 1.0, settings: Settings = DEFAULTS) -> DataFrame:
    """Compare two profiles column by column; a check without expected statistics does not count, a column missing in
    ``actual`` scores 0. Distinct counts of unique columns grow with ``scale``."""
    e = expected.select(
        "column_name", F.col("row_count").alias("e_rows"), F.col("null_ratio").alias("e_nulls"), F.col("distinct_count").alias("e_distinct"),
        F.col("min_number").alias("e_min"), F.col("max_number").alias("e_max"), F.col("mean").alias("e_mean"),
    )
    a = actual.select(
        "column_name", F.lit(True).alias("present"), F.col("row_count").alias("actual_rows"), F.col("null_ratio").alias("a_nulls"), F.col("distinct_count").alias("a_distinct"),
        F.col("min_number").alias("a_min"), F.col("max_number").alias("a_max"), F.col("mean").alias("a_mean"),
    )
    grown = F.when(F.col("e_distinct") >= F.col("e_rows") * 0.99, F.col("e_distinct") * F.lit(float(scale))).otherwise(F.col("e_distinct"))
    smaller, larger = F.least("a_distinct", grown), F.greatest(F.col("a_distinct"), grown, F.lit(1))
    checks = {
        "null_ratio_ok": F.abs(F.col("a_nulls") - F.col("e_nulls")) <= settings.null_ratio_tolerance,
        "cardinality_ok": F.when(F.col("e_distinct") > 0, smaller / larger >= settings.cardinality_ratio),
        "range_ok": F.when(
            F.col("e_min").isNotNull() & F.col("a_min").isNotNull(),
            (F.col("a_min") >= F.col("e_min")) & (F.col("a_max") <= F.col("e_max")),
        ),
        "mean_ok": F.abs(F.col("a_mean") - F.col("e_mean")) / F.greatest(F.abs("e_mean"), F.lit(1.0)) <= settings.mean_tolerance,
    }
    out = e.join(a, "column_name", "left").withColumns(checks)
    passed = reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(False)).cast("int") for c in checks])
    asked = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in checks])
    score = F.when(F.col("present").isNull(), 0.0).when(asked == 0, 1.0).otherwise(passed / asked)
    return out.select("column_name", *checks, score.alias("score"), "actual_rows")


def fidelity_table(columns: DataFrame, expected_rows: int | Column, settings: Settings = DEFAULTS) -> DataFrame:
    """0.2 for the row count (half of it when it is off) and 0.8 for the mean column score."""
    want = F.lit(expected_rows) if isinstance(expected_rows, int) else expected_rows
    rows = F.coalesce(F.max("actual_rows"), F.lit(0).cast("bigint")).alias("actual_rows")
    out = columns.agg(F.coalesce(F.avg("score"), F.lit(1.0)).alias("column_score"), rows).withColumn("expected_rows", want)
    off = F.abs(F.col("actual_rows") - F.col("expected_rows")) / F.greatest("expected_rows", F.lit(1))
    out = out.withColumn("row_count_match", off <= settings.row_count_tolerance)
    score = F.when(F.col("row_count_match"), 1.0).otherwise(0.5) * 0.2 + F.col("column_score") * 0.8
    return out.withColumn("overall_score", score)


def ks_distance(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance, exact on distinct values.

    Values are counted per side first; the running shares are built in parallel over 64 parts of the value range, cut by
    a sketch so that they hold about equally many rows, and each divided again by 256.
    """
    both = (
        a.select(F.col(value).alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb"))
        .unionByName(b.select(F.col(value).alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb")))
        .filter("v is not null")
    )
    n = 64
    sketch = both.agg(
        F.percentile_approx("v", [i / n for i in range(1, n)], 10000).alias("p"), F.sum("na").alias("na"), F.sum("nb").alias("nb"),
        F.min("v").alias("lo"), F.max("v").alias("hi"),
    ).first()
    counts = both.groupBy("v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    points = sorted(set(sketch["p"] or []))
    counts = with_fine_chunk(counts, "v", "__part", points, sketch["lo"], sketch["hi"])
    running = with_running_sum(counts, [], "v", F.col("__part"), {"ca": "na", "cb": "nb"})
    gap = F.max(F.abs(F.col("ca") / F.lit(sketch["na"]) - F.col("cb") / F.lit(sketch["nb"])))
    return running.agg(gap.alias("ks"), F.max("ca").alias("n_a"), F.max("cb").alias("n_b"))


def category_distance(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Total variation distance of the value frequencies of two tables, NULL as a value of its own."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col(col).alias(f"v_{name}")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        return counts.withColumn(name, F.col(f"n_{name}") / df.agg(F.count(F.lit(1)).alias("n")).scalar())

    x, y = shares(a, "fa"), shares(b, "fb")
    joined = x.join(y, F.col("v_fa").eqNullSafe(F.col("v_fb")), "full_outer")
    diff = F.abs(F.coalesce("fa", F.lit(0.0)) - F.coalesce("fb", F.lit(0.0)))
    return joined.agg((F.sum(diff) / 2).alias("total_variation"))


def level(score: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(score >= settings.green, "green").when(score >= settings.amber, "amber").otherwise("red")


def score_tables(dims: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Confidence per table from (table_name, schema_score, fidelity_score, violations, layers_ok).

    A dimension that was not measured (NULL) counts as 1.
    """
    w = settings.weights
    quality = F.when(F.col("violations").isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - F.col("violations") * F.lit(0.1)))
    parts = (
        F.coalesce("schema_score", F.lit(1.0)) * w["schema"]
        + F.coalesce("fidelity_score", F.lit(1.0)) * w["data_fidelity"]
        + F.coalesce(quality, F.lit(1.0)) * w["quality"]
        + F.when(F.coalesce("layers_ok", F.lit(True)), 1.0).otherwise(0.0) * w["pipeline"]
    )
    advice = F.array_compact(
        F.array(
            F.when(F.col("schema_score") < 1, "Columns are missing or have other types"),
            F.when(F.col("fidelity_score") < 1, "Distributions deviate from the specification"),
            F.when(F.col("violations") > 0, F.format_string("%d quality violations detected", F.col("violations").cast("bigint"))),
            F.when(~F.col("layers_ok"), "Layer run failed for this table"),
        )
    )
    out = dims.withColumn("overall", parts)
    return out.select("table_name", F.round("overall", 4).alias("overall_score"), level(F.col("overall"), settings).alias("level"), advice.alias("recommendations"))


def score_workspace(tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Mean of the table scores, level and counts per level; no tables give 0 and red."""
    counts = {name: F.count_if(F.col("level") == name).alias(name) for name in ("green", "amber", "red")}
    out = tables.agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.avg("overall_score"), F.lit(0.0)).alias("mean"), *counts.values())
    lev = level(F.col("mean"), settings)
    summary = F.when(F.col("tables") == 0, "No tables validated").otherwise(
        F.format_string(
            "%d tables validated: %d green, %d amber, %d red. Overall confidence: %.1f%% (%s)",
            "tables", "green", "amber", "red", F.col("mean") * 100, lev,
        )
    )
    return out.select(
        F.round("mean", 4).alias("overall_score"), lev.alias("level"), "tables", "green", "amber", "red", summary.alias("summary")
    )


def spec_profile(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """The statistics of a specification in the shape of a profile."""
    rows = []
    for c in spec.columns:
        s = c.stats
        num = lambda k: None if s.get(k) is None or isinstance(s.get(k), str) else float(s[k])
        rows.append((c.name, spec.row_count, float(s.get("null_ratio") or 0.0), s.get("distinct_count"), num("min_number") if "min_number" in s else num("min"), num("max_number") if "max_number" in s else num("max"), num("mean")))
    return spark.createDataFrame(
        rows, "column_name string, row_count bigint, null_ratio double, distinct_count bigint, min_number double, max_number double, mean double"
    )


def validate_table(
    spark: SparkSession, df: DataFrame, spec: TableSpec, scale: float = 1.0, violations: int = 0, layers_ok: bool = True,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row with the inputs of the confidence score of a table."""
    actual = statistics(df, accuracy=0)
    columns = fidelity_columns(spec_profile(spark, spec), actual, scale, settings)
    table = fidelity_table(columns, rows_of(spec, scale, None), settings)
    schema = schema_score(compare_schema(df, spec.columns)).select("score").scalar()
    return table.select(
        F.lit(spec.name).alias("table_name"), schema.alias("schema_score"), F.col("overall_score").alias("fidelity_score"),
        F.lit(violations).alias("violations"), F.lit(layers_ok).alias("layers_ok"),
    )


def validate(
    spark: SparkSession, blueprint: Blueprint, tables: dict[str, DataFrame], scale: float = 1.0, run: LayerResult | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scores per table, score of the workspace)."""
    dims = []
    for name, df in tables.items():
        found = len(run.violations.get(name, [])) if run else 0
        ok = name not in run.failed if run else True
        dims.append(validate_table(spark, df, blueprint.table(name), scale, found, ok))
    scores = score_tables(reduce(DataFrame.unionByName, dims))
    return scores, score_workspace(scores)


def save_report(scores: DataFrame, workspace: DataFrame, path: str, workspace_id: str) -> None:
    """Append one report row: ids, score, level, summary, table scores as JSON, time."""
    listed = scores.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*scores.columns)))).alias("t")).scalar()
    workspace.select(
        F.lit(workspace_id).alias("workspace_id"), "overall_score", "level", "summary", listed.alias("tables_json"),
        F.current_timestamp().alias("created_at"),
    ).write.mode("append").parquet(path)


def run_workstreams(
    spark: SparkSession, blueprint: Blueprint, streams: list[dict], root: str, rules: list[Rule] | None = None,
    max_parallel: int = DEFAULTS.max_parallel,
) -> dict[str, dict]:
    """Independent runs (name, tables, scale, priority), several at a time, each in a folder of its own.

    Threads only submit Spark jobs; with the FAIR scheduler they share the cluster.
    """

    def one(stream: dict) -> tuple[str, dict]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", stream["name"])
        scale = stream.get("scale", 1.0)
        made = generate_all(spark, blueprint, scale, stream.get("seed", 42), stream.get("tables"))
        folder = f"{root}/{stream['name']}"
        run = run_layers(spark, made, blueprint, folder, rules, stream["name"])
        done = {t: spark.read.parquet(f"{folder}/gold/{t}").drop("_published_at") for t in made if t not in run.failed}
        scores, workspace = validate(spark, blueprint, done, scale, run)
        save_report(scores, workspace, f"{root}/reports", stream["name"])
        return stream["name"], {"run": run, "workspace": workspace.first().asDict()}

    ordered = sorted(streams, key=lambda s: s.get("priority", 0))
    with ThreadPoolExecutor(max_workers=max_parallel) as pool:
        return dict(pool.map(one, ordered))
