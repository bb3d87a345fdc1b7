"""Quality rules: SQL predicates and key rules, evaluated together on the same input.

A row for which a predicate is NULL violates it. All rules see the rows before any of them drops something.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.route import failed_rules
from millrace.operators.windows import dedup
from millrace.spec import TableSpec, base_type


@dataclass(frozen=True)
class Rule:
    """``expression`` is a predicate; for a unique rule ``keys`` is set instead."""

    name: str
    expression: str = ""
    action: str = "warn"
    layer: str = "silver"
    table: str = ""
    keys: tuple[str, ...] = field(default=())
    parent: DataFrame | None = None
    parent_key: str = ""


class RuleViolation(Exception):
    """A rule with the action ``fail`` has violating rows."""


def not_null(col: str, action: str = "warn", table: str = "") -> Rule:
    return Rule(f"{table}_{col}_not_null" if table else f"{col}_not_null", f"`{col}` IS NOT NULL", action, table=table)


def in_range(col: str, lo=None, hi=None, action: str = "warn", table: str = "") -> Rule:
    parts = ([f"`{col}` >= {lo}"] if lo is not None else []) + ([f"`{col}` <= {hi}"] if hi is not None else [])
    return Rule(f"{table}_{col}_range" if table else f"{col}_range", " AND ".join(parts) or "true", action, table=table)


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_set(col: str, values: list, action: str = "warn", table: str = "") -> Rule:
    listed = ", ".join(_sql_text(v) if isinstance(v, str) else str(v) for v in values)
    return Rule(f"{table}_{col}_accepted" if table else f"{col}_accepted", f"`{col}` IN ({listed})", action, table=table)


def unique(cols: list[str], action: str = "warn", table: str = "") -> Rule:
    name = "_".join(cols)
    return Rule(f"{table}_{name}_unique" if table else f"{name}_unique", action=action, table=table, keys=tuple(cols))


def has_parent(col: str, parent: DataFrame, parent_key: str, action: str = "warn", table: str = "") -> Rule:
    """The foreign key is NULL or occurs in the parent."""
    return Rule(f"{col}_relationship", action=action, table=table, keys=(col,), parent=parent, parent_key=parent_key)


def not_all_null(df: DataFrame, action: str = "drop") -> Rule:
    """At least one column has a value; the default rule of the silver layer."""
    return Rule("no_all_null_rows", "NOT (" + " AND ".join(f"`{c}` IS NULL" for c in df.columns) + ")", action)


def _predicates(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.expression]


def violations(df: DataFrame, rules: list[Rule], table: str = "", layer: str = "silver") -> DataFrame:
    """(rule, table_name, layer, action, violating_rows, total_rows, violation_ratio) for every rule.

    All predicates are counted in one aggregate. Key rules count each key first, so a hot key is one row.
    """
    simple = _predicates(rules)
    parts = []
    broken = [F.count_if(~F.coalesce(F.expr(r.expression), F.lit(False))).alias(f"v{i}") for i, r in enumerate(simple)]
    rows = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.col(f"v{i}").alias("violating_rows"), F.col("n").alias("total_rows"))
        for i, r in enumerate(simple)
    ]
    if rows:
        parts.append(df.agg(F.count(F.lit(1)).alias("n"), *broken).select(F.inline(F.array(*rows))))
    for r in rules:
        if r.expression:
            continue
        per_key = df.groupBy(*r.keys).agg(F.count(F.lit(1)).alias("n"))
        if r.parent is None:
            bad = F.sum(F.col("n") - 1)
        else:
            known = r.parent.select(F.col(r.parent_key).alias("__pk")).distinct()
            per_key = per_key.join(known, F.col(r.keys[0]) == F.col("__pk"), "left")
            bad = F.sum(F.when(F.col("__pk").isNull() & F.col(r.keys[0]).isNotNull(), F.col("n")).otherwise(0))
        zero = F.lit(0).cast("bigint")
        parts.append(
            per_key.agg(F.coalesce(bad, zero).alias("violating_rows"), F.coalesce(F.sum("n"), zero).alias("total_rows"))
            .select(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), "violating_rows", "total_rows")
        )
    found = reduce(DataFrame.unionByName, parts)
    ratio = F.round(F.col("violating_rows") / F.greatest("total_rows", F.lit(1)), 4)
    return found.select(
        "rule", F.lit(table).alias("table_name"), F.lit(layer).alias("layer"), "action", "violating_rows", "total_rows",
        ratio.alias("violation_ratio"),
    )


def keep(df: DataFrame, rules: list[Rule], order: list[str] | None = None) -> DataFrame:
    """Rows that survive the ``drop`` rules; of a repeated unique key the first row in ``order``."""
    drops = [r for r in rules if r.action == "drop"]
    passing = [F.coalesce(F.expr(r.expression), F.lit(False)) for r in drops if r.expression]
    out = df.filter(reduce(Column.__and__, passing)) if passing else df
    for r in drops:
        if r.expression:
            continue
        if r.parent is None:
            out = dedup(out, list(r.keys), order or list(r.keys))
        else:
            known = r.parent.select(F.col(r.parent_key).alias("__pk")).distinct()
            fk = F.col(r.keys[0])
            out = out.join(known, fk == F.col("__pk"), "left").filter(fk.isNull() | F.col("__pk").isNotNull()).drop("__pk")
    return out


def apply_rules(
    df: DataFrame, rules: list[Rule], table: str = "", layer: str = "silver", order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, violations with at least one row). A violated ``fail`` rule raises :class:`RuleViolation`."""
    mine = [r for r in rules if r.layer == layer and r.table in ("", table)]
    if not mine:
        schema = "rule string, table_name string, layer string, action string, violating_rows bigint, total_rows bigint, violation_ratio double"
        return df, df.sparkSession.createDataFrame([], schema)
    fatal = [r for r in mine if r.action == "fail"]
    if fatal:
        hit = violations(df, fatal, table, layer).filter("violating_rows > 0").collect()
        if hit:
            raise RuleViolation(", ".join(f"{r['rule']}: {r['violating_rows']} rows" for r in hit))
    return keep(df, mine, order), violations(df, mine, table, layer).filter("violating_rows > 0")


def quarantine(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that violate a predicate, with the names of the failed rules."""
    marked = df.withColumn("_failed_rules", failed_rules({r.name: r.expression for r in _predicates(rules)}))
    return marked.filter(F.size("_failed_rules") > 0)


def try_transform(df: DataFrame, exprs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per-record error capture. ``exprs`` maps a new column to (expression that gives NULL on error, input column);
    ``_errors`` lists the new columns that failed although their input was there."""
    out = df.withColumns({n: F.expr(e) for n, (e, _) in exprs.items()})
    failed = [F.when(F.col(n).isNull() & F.col(src).isNotNull(), F.lit(n)) for n, (_, src) in exprs.items()]
    return out.withColumn("_errors", F.array_compact(F.array(*failed)))


def rules_for(spec: TableSpec) -> list[Rule]:
    """Not-null, unique and range rules that follow from a specification."""
    rules = []
    for c in spec.columns:
        if not c.nullable:
            rules.append(not_null(c.name, table=spec.name))
        if c.primary_key:
            rules.append(unique([c.name], table=spec.name))
        lo = c.stats.get("min_number", c.stats.get("min"))
        hi = c.stats.get("max_number", c.stats.get("max"))
        if lo is not None and hi is not None and base_type(c.data_type) in ("int", "bigint", "smallint", "float", "double", "decimal"):
            rules.append(in_range(c.name, repr(lo) + ("D" if isinstance(lo, float) else ""), repr(hi) + ("D" if isinstance(hi, float) else ""), table=spec.name))
    return rules


def rules_sql(rules: list[Rule]) -> list[str]:
    """Rules as constraint clauses of a declarative table definition."""
    ending = {"warn": "", "drop": " ON VIOLATION DROP ROW", "fail": " ON VIOLATION FAIL UPDATE"}
    return [f"CONSTRAINT {r.name} EXPECT ({r.expression}){ending[r.action]}" for r in _predicates(rules)]
