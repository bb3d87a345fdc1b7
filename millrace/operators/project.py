"""Projections: setting, restructuring, enforcing and serialising columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.attr import one_line_base64
from millrace.spec import NOT_NULL_DEFAULTS, ColumnSpec, spark_type


def clean_name(name: str) -> str:
    """Lower case, every other character than letters, digits and underscore becomes an underscore."""
    return re.sub(r"[^a-z0-9_]", "_", name.lower())


def update_columns(df: DataFrame, changes: dict[str, Column | str]) -> DataFrame:
    """Set many columns at once from columns or SQL expressions; all see the input values."""
    return df.withColumns({clean_name(n): F.expr(e) if isinstance(e, str) else e for n, e in changes.items()})


def enforce(df: DataFrame, spec: list[ColumnSpec]) -> DataFrame:
    """Cast to the declared types, add missing columns as typed NULL, fill NOT NULL columns with type defaults.

    Declared columns first and in order, others after them. Values that do not fit the type become NULL.
    """
    have = set(df.columns)
    out = []
    for c in spec:
        kind = spark_type(c.data_type)
        value = F.col(c.name).try_cast(kind) if c.name in have else F.lit(None).cast(kind)
        if not c.nullable and kind.split("(")[0] in NOT_NULL_DEFAULTS:
            value = F.coalesce(value, F.expr(f"cast({NOT_NULL_DEFAULTS[kind.split('(')[0]]} as {kind})"))
        out.append(value.alias(c.name))
    declared = {c.name for c in spec}
    return df.select(*out, *[c for c in df.columns if c not in declared])


def restructure(
    df: DataFrame,
    shift: dict[str, str] | None = None,
    default: dict[str, object] | None = None,
    remove: list[str] | None = None,
    modify: dict[str, str] | None = None,
) -> DataFrame:
    """Declarative record change: ``modify`` overwrites by expression, ``default`` fills NULL or missing fields,
    ``remove`` drops fields, ``shift`` maps old names to new ones; ``outer.inner`` nests into a struct."""
    out = df
    if modify:
        out = out.withColumns({n: F.expr(e) for n, e in modify.items()})
    for name, value in (default or {}).items():
        filled = F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value)
        out = out.withColumn(name, filled)
    if remove:
        out = out.drop(*remove)
    if not shift:
        return out
    flat, nested = [], {}
    for name in out.columns:
        target = shift.get(name, name)
        if "." in target:
            outer, inner = target.split(".", 1)
            nested.setdefault(outer, []).append(F.col(name).alias(inner))
        else:
            flat.append(F.col(name).alias(target))
    return out.select(*flat, *[F.struct(*parts).alias(outer) for outer, parts in nested.items()])


def to_json_column(df: DataFrame, cols: list[str] | None = None, name: str = "_json") -> DataFrame:
    return df.withColumn(name, F.to_json(F.struct(*(cols or df.columns))))


def to_csv_column(df: DataFrame, cols: list[str] | None = None, name: str = "_csv") -> DataFrame:
    """One delimited text per row, quoted where needed."""
    return df.withColumn(name, F.to_csv(F.struct(*(cols or df.columns))))


def stamp(df: DataFrame, source: str) -> DataFrame:
    return df.withColumns({"_processed_at": F.current_timestamp(), "_source": F.lit(source)})


def hash_columns(df: DataFrame, cols: list[str], algorithm: str = "SHA-256", suffix: str = "_hash") -> DataFrame:
    """Hex digest of columns: SHA-256, SHA-512 or MD5."""
    size = 512 if "512" in algorithm else 256

    def digest(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.md5(text) if "MD5" in algorithm.upper() else F.sha2(text, size)

    return df.withColumns({c + suffix: digest(c) for c in cols})


def encrypt_columns(df: DataFrame, key: Column, cols: list[str] | None = None) -> DataFrame:
    """AES-GCM to base64; by default every column but those named like an id, key or timestamp."""
    chosen = cols or [c for c in df.columns if c.lower() not in ("id", "key", "timestamp")]
    return df.withColumns({c: one_line_base64(F.aes_encrypt(F.col(c).cast("string"), key, F.lit("GCM"))) for c in chosen})


def decrypt_columns(df: DataFrame, key: Column, cols: list[str]) -> DataFrame:
    """Inverse of :func:`encrypt_columns`; what cannot be decrypted becomes NULL."""
    return df.withColumns(
        {c: F.try_aes_decrypt(F.unbase64(F.col(c)), key, F.lit("GCM")).cast("string") for c in cols}
    )


def base64_column(df: DataFrame, col: str, decode: bool = False) -> DataFrame:
    value = F.unbase64(F.col(col)).cast("string") if decode else one_line_base64(F.encode(F.col(col), "UTF-8"))
    return df.withColumn(col, value)


def recode(df: DataFrame, col: str, source: str, target: str) -> DataFrame:
    """Bytes in one character set to bytes in another."""
    return df.withColumn(col, F.encode(F.decode(F.col(col), source), target))


def cut_bytes(df: DataFrame, col: str, offset: int, length: int, name: str = "_modified") -> DataFrame:
    """Keep ``length`` bytes from the 0-based ``offset``."""
    return df.withColumn(name, F.substring(F.col(col).cast("binary"), offset + 1, length))
