"""The flagship chain: profile two tables, generate both with a foreign key, conform them with rules, compare, score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.joins import orphan_ratio
from millrace.plans import blueprint as B
from millrace.plans import generate as G
from millrace.plans import layers as L
from millrace.plans import profile as P
from millrace.plans import quality as Q
from millrace.plans import validate as V
from millrace.queries.base import Registry
from millrace.runtime import load, scratch_path
from millrace.spec import Blueprint, ForeignKey

R = Registry()

KEYS = {"customer": "c_custkey", "orders": "o_orderkey"}
SEED = 42


def blueprint(spark: SparkSession, folder: str) -> Blueprint:
    """Specifications of customers and orders, with the measured orphan ratio of their key."""
    tables = {t: load(spark, folder, t) for t in KEYS}
    lost = orphan_ratio(tables["orders"], tables["customer"], "o_custkey", "c_custkey").first()["orphan_ratio"]
    fks = {"customer": [], "orders": [ForeignKey("o_custkey", "customer", "c_custkey", lost)]}
    return Blueprint("shop", [B.to_table_spec(t, P.profile(df, domain=G.CATEGORICAL_LIMIT), (KEYS[t],), fks[t]) for t, df in tables.items()], "files")


@R.add("readiness_slice")
def readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Score table of the synthetic copies: (table_name, overall_score, level, recommendations)."""
    bp = blueprint(spark, folder)
    made = G.generate_all(spark, bp, 1.0, SEED, cap=None)
    root = scratch_path(spark, "readiness")
    rules = [r for spec in bp.tables for r in Q.rules_for(spec)]
    run = L.run_layers(spark, made, bp, root, rules)
    dims = []
    for name in made:
        gold = spark.read.parquet(f"{root}/gold/{name}").drop("_published_at")
        dims.append(V.validate_table(spark, gold, bp.table(name), 1.0, len(run.violations[name]), name not in run.failed))
    scores = V.score_tables(reduce(DataFrame.unionByName, dims))
    return scores.withColumn("recommendations", F.array_join("recommendations", "; "))
