"""Synthetic tables as pure column expressions over ``spark.range``: no rows on the driver, no shuffle, same values on
any partitioning."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.hashrand import normal_ppf, permuted, uniform
from millrace.spec import Blueprint, ColumnSpec, ForeignKey, TableSpec, base_type, spark_type

ALPHANUMERIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
INTEGERS = ("int", "bigint", "smallint", "tinyint", "integer", "long")
REALS = ("float", "double", "decimal", "numeric")
CATEGORICAL_LIMIT = 100


def _number(stats: dict, which: str, default: float) -> float:
    for key in (f"{which}_number", which):
        if stats.get(key) is not None:
            return float(stats[key])
    return default


def gen_uniform_integer(u: Column, lo: int, hi: int) -> Column:
    return (F.lit(int(lo)) + F.floor(u * F.lit(float(int(hi) - int(lo) + 1)))).cast("bigint")


def gen_normal(u: Column, mean: float, sd: float, lo: float, hi: float) -> Column:
    """Normal draw clipped to the observed range."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.lit(float(mean)) + F.lit(float(sd)) * normal_ppf(u)))


def gen_integer(u: Column, stats: dict) -> Column:
    lo, hi = _number(stats, "min", 0), _number(stats, "max", 1000)
    if stats.get("mean") is not None and (stats.get("stddev") or 0) > 0:
        return F.round(gen_normal(u, stats["mean"], stats["stddev"], lo, hi)).cast("bigint")
    return gen_uniform_integer(u, lo, hi)


def gen_float(u: Column, stats: dict) -> Column:
    lo, hi = _number(stats, "min", 0.0), _number(stats, "max", 1.0)
    if stats.get("mean") is not None and (stats.get("stddev") or 0) > 0:
        return F.round(gen_normal(u, stats["mean"], stats["stddev"], lo, hi), 4)
    return F.round(F.lit(lo) + u * F.lit(hi - lo), 4)


def gen_categorical(u: Column, top_values: list[dict]) -> Column:
    """A value with the probability of its frequency; the list is short (top values)."""
    total = sum(t["frequency"] for t in top_values)
    bound, out = 0.0, None
    for t in top_values[:-1]:
        bound += t["frequency"]
        cond, value = u * F.lit(total) < F.lit(bound), F.lit(str(t["value"]))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    last = F.lit(str(top_values[-1]["value"]))
    return last if out is None else out.otherwise(last)


def gen_quantile(u: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear inverse distribution through (probability, value) points."""
    out = None
    for (p0, v0), (p1, v1) in zip(points, points[1:]):
        value = F.lit(float(v0)) + (u - F.lit(float(p0))) * F.lit((v1 - v0) / (p1 - p0))
        out = F.when(u < F.lit(float(p1)), value) if out is None else out.when(u < F.lit(float(p1)), value)
    return F.round(out.otherwise(F.lit(float(points[-1][1]))), 4)


def quantile_points(stats: dict) -> list[tuple[float, float]]:
    inner = [(p / 100, stats[f"p{p}"]) for p in (25, 50, 75, 95, 99)]
    return [(0.0, _number(stats, "min", 0)), *inner, (1.0, _number(stats, "max", 1))]


def gen_date(u: Column, lo: str, hi: str) -> Column:
    """A uniform day of the closed interval; 365 days if it is empty."""
    first, last = F.to_date(F.lit(str(lo)[:10])), F.to_date(F.lit(str(hi)[:10]))
    days = F.datediff(last, first)
    span = F.when(days > 0, days + 1).otherwise(365)
    return F.date_add(first, F.floor(u * span.cast("double")).cast("int"))


def gen_timestamp(u: Column, v: Column, lo: str, hi: str) -> Column:
    """A uniform day and a uniform second of the day."""
    seconds = F.unix_seconds(gen_date(u, lo, hi).cast("timestamp")) + F.floor(v * F.lit(86400.0))
    return F.timestamp_seconds(seconds)


def gen_boolean(u: Column, true_ratio: float) -> Column:
    return u < F.lit(float(true_ratio))


def _letters(seed: int, table: str, column: str, row_id: Column, alphabets: list[str]) -> list[Column]:
    """One character per alphabet; each digest gives sixteen bytes."""
    digests = [
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(table), F.lit(f"{column}#{d}"), row_id.cast("string")))
        for d in range((len(alphabets) + 15) // 16)
    ]
    out = []
    for i, alphabet in enumerate(alphabets):
        byte = F.conv(F.substring(digests[i // 16], 2 * (i % 16) + 1, 2), 16, 10).cast("int")
        out.append(F.substring(F.lit(alphabet), F.floor(byte * len(alphabet) / 256.0).cast("int") + 1, F.lit(1)))
    return out


def gen_string(seed: int, table: str, column: str, row_id: Column, min_length: int, max_length: int) -> Column:
    """Random letters and digits with a uniform length. The expression has the same size for any length: digests of sixteen
    bytes, as many as the row's length asks for, and a letter for each byte."""
    size = F.lit(min_length) + F.floor(uniform(seed, table, column + "#len", row_id) * F.lit(float(max_length - min_length + 1)))
    size = size.cast("int")
    digests = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / 16).cast("int")),
        lambda d: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(table), F.concat(F.lit(f"{column}#"), d.cast("string")), row_id.cast("string"))),
    )

    def letter(digest: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        return F.substring(F.lit(ALPHANUMERIC), F.floor(byte * len(ALPHANUMERIC) / 256.0).cast("int") + 1, F.lit(1))

    letters = F.flatten(F.transform(digests, lambda digest: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: letter(digest, i))))
    return F.array_join(F.slice(letters, F.lit(1), size), "")


def pattern_alphabets(pattern: str) -> list[str]:
    """The character choices of a simple pattern: classes, escapes, literals, ``{n}``, ``+`` (three) and optional groups
    (left out)."""
    plain = re.sub(r"\([^()]*\)\?", "", pattern.strip("^$"))
    out = []
    for atom, count in re.findall(r"(\\.|\[[^\]]+\]|[^\\\[\]{}+*?])(\{\d+\}|[+*?])?", plain):
        if atom == r"\d":
            chars = "0123456789"
        elif atom == r"\w":
            chars = ALPHANUMERIC
        elif atom.startswith("["):
            chars = re.sub(r"(\w)-(\w)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), atom[1:-1])
        else:
            chars = atom[-1]
        times = int(count[1:-1]) if count.startswith("{") else {"": 1, "+": 3, "*": 3, "?": 1}[count]
        out += [chars] * times
    return out


def gen_pattern(seed: int, table: str, column: str, row_id: Column, pattern: str) -> Column:
    return F.concat(*_letters(seed, table, column, row_id, pattern_alphabets(pattern)))


def gen_key(row_id: Column, kind: str, first: int = 1) -> Column:
    """A unique key: consecutive numbers, or their text for text keys."""
    return (row_id + F.lit(int(first))).cast(spark_type(kind))


def null_count(n: int, ratio: float) -> int:
    return n - int(n * (1 - ratio))


def with_nulls(value: Column, row_id: Column, n: int, ratio: float, shift: int) -> Column:
    """Exactly ``n - int(n * (1 - ratio))`` NULLs, at the rows a bijection of 0..n-1 puts first."""
    k = null_count(n, ratio)
    return value if k == 0 else F.when(permuted(row_id, n, shift) >= k, value)


def _shift(seed: int, table: str, column: str) -> int:
    return int(hashlib.md5(f"{seed}|{table}|{column}".encode()).hexdigest()[:12], 16)


def is_categorical(stats: dict) -> bool:
    """Few values, all of them known: the frequencies add up to the share of rows that are not NULL."""
    tops = stats.get("top_values") or []
    covered = sum(t["frequency"] for t in tops) >= (1 - (stats.get("null_ratio") or 0.0)) * (1 - 1e-6)
    return 0 < len(tops) <= CATEGORICAL_LIMIT and covered


def first_key(spec: ColumnSpec) -> int:
    lo = spec.stats.get("min_number", spec.stats.get("min"))
    return int(lo) if lo is not None else 1


def column_value(spec: ColumnSpec, table: str, row_id: Column, n: int, seed: int, quantiles: bool = False) -> Column:
    """One generated column, in its declared type and with its share of NULLs."""
    stats, kind, base = spec.stats, spark_type(spec.data_type), base_type(spec.data_type)
    u = uniform(seed, table, spec.name, row_id)
    if spec.primary_key:
        return gen_key(row_id, spec.data_type, first_key(spec)).alias(spec.name)
    if base in ("boolean", "bool"):
        ratio = next((t["frequency"] for t in stats.get("top_values") or [] if str(t["value"]).lower() == "true"), stats.get("true_ratio", 0.5))
        value = gen_boolean(u, ratio)
    elif is_categorical(stats):
        value = gen_categorical(u, stats["top_values"])
    elif base in INTEGERS or base in REALS:
        if quantiles and stats.get("p50") is not None:
            value = gen_quantile(u, quantile_points(stats))
            value = F.round(value) if base in INTEGERS else value
        else:
            value = gen_integer(u, stats) if base in INTEGERS else gen_float(u, stats)
    elif base == "date" or base.startswith("timestamp") or base == "datetime":
        lo = stats.get("min_value") or stats.get("min") or stats.get("min_date") or "2020-01-01"
        hi = stats.get("max_value") or stats.get("max") or stats.get("max_date") or "2025-12-31"
        value = gen_date(u, lo, hi) if base == "date" else gen_timestamp(u, uniform(seed, table, spec.name + "#s", row_id), lo, hi)
    elif stats.get("pattern"):
        value = gen_pattern(seed, table, spec.name, row_id, stats["pattern"])
    else:
        lo = 5 if stats.get("min_length") is None else stats["min_length"]
        hi = 20 if stats.get("max_length") is None else stats["max_length"]
        value = gen_string(seed, table, spec.name, row_id, lo, max(lo, hi))
    value = value.cast(kind)
    return with_nulls(value, row_id, n, stats.get("null_ratio") or 0.0, _shift(seed, table, spec.name)).alias(spec.name)


def fk_value(fk: ForeignKey, child: str, row_id: Column, parent: TableSpec, parent_rows: int, seed: int) -> Column:
    """A key of the generated parent table, by formula; a share ``orphan_ratio`` lies outside its domain, same type."""
    key = parent.column(fk.references_column)
    first = first_key(key)
    pick = F.floor(uniform(seed, child, fk.column, row_id) * F.lit(float(parent_rows))).cast("bigint")
    chosen = gen_key(pick, key.data_type, first)
    if not fk.orphan_ratio:
        return chosen
    outside = gen_key(pick + F.lit(parent_rows), key.data_type, first)
    return F.when(uniform(seed, child, fk.column + "#orphan", row_id) < F.lit(fk.orphan_ratio), outside).otherwise(chosen)


class TooManyRows(ValueError):
    """A specification asks for more rows than the given limit."""


def rows_of(spec: TableSpec, scale: float, cap: int | None = None) -> int:
    """Rows to make, at least one. With ``cap``, asking for more is an error; rows are never cut off."""
    n = max(1, int(spec.row_count * scale))
    if cap is not None and n > cap:
        raise TooManyRows(f"{spec.name}: {n} rows asked, {cap} allowed")
    return n


def gen_rows(spark: SparkSession, n: int) -> DataFrame:
    """n rows with an id and the time of the run."""
    return spark.range(n).withColumn("generated_at", F.current_timestamp())


def generate(
    spark: SparkSession, spec: TableSpec, scale: float = 1.0, seed: int = 42, parents: Blueprint | None = None,
    cap: int | None = None, quantiles: bool = False,
) -> DataFrame:
    """One synthetic table. Foreign keys to tables of ``parents`` use the key formula of the parent."""
    n = rows_of(spec, scale, cap)
    row_id = F.col("id")
    known = {t.name: t for t in parents.tables} if parents else {}
    fks = {fk.column: fk for fk in spec.foreign_keys if fk.references_table in known}
    out = []
    for c in spec.columns:
        fk = fks.get(c.name)
        if fk is None:
            out.append(column_value(c, spec.name, row_id, n, seed, quantiles))
            continue
        parent = known[fk.references_table]
        value = fk_value(fk, spec.name, row_id, parent, rows_of(parent, scale, cap), seed).cast(spark_type(c.data_type))
        out.append(with_nulls(value, row_id, n, c.stats.get("null_ratio") or 0.0, _shift(seed, spec.name, c.name)).alias(c.name))
    return spark.range(n).select(*out)


def generation_order(blueprint: Blueprint, subset: list[str] | None = None) -> list[str]:
    """Table names with parents before children; tables in a cycle keep their given order."""
    wanted = subset or [t.name for t in blueprint.tables]
    parents = {t.name: [fk.references_table for fk in t.foreign_keys] for t in blueprint.tables}
    done: list[str] = []

    def visit(name: str, trail: tuple[str, ...]) -> None:
        if name in done or name in trail or name not in parents:
            return
        for p in parents[name]:
            visit(p, (*trail, name))
        if name not in done:
            done.append(name)

    for name in wanted:
        visit(name, ())
    return [n for n in done if n in wanted]


def generate_all(
    spark: SparkSession, blueprint: Blueprint, scale: float = 1.0, seed: int = 42, tables: list[str] | None = None,
    cap: int | None = None,
) -> dict[str, DataFrame]:
    """All tables, or a subset, in generation order."""
    return {n: generate(spark, blueprint.table(n), scale, seed, blueprint, cap) for n in generation_order(blueprint, tables)}
