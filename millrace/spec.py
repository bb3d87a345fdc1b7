"""Types, thresholds and specifications shared by the library."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Settings:
    """Limits and tolerances; the defaults are fixed values."""

    max_rows_per_table: int = 10_000_000
    profile_sample_rows: int = 50_000
    top_values: int = 20
    null_ratio_tolerance: float = 0.01
    row_count_tolerance: float = 0.05
    cardinality_ratio: float = 0.5
    mean_tolerance: float = 0.2
    ks_threshold: float = 0.05
    green: float = 0.90
    amber: float = 0.70
    max_parallel: int = 5
    weights: dict = field(
        default_factory=lambda: {"schema": 0.25, "data_fidelity": 0.35, "quality": 0.20, "pipeline": 0.20}
    )


DEFAULTS = Settings()

# Type names of four database dialects and their canonical names.
DIALECT_TYPES = {
    "number": "decimal",
    "varchar2": "varchar",
    "nvarchar2": "varchar",
    "clob": "text",
    "nclob": "text",
    "blob": "binary",
    "raw": "binary",
    "nvarchar": "varchar",
    "nchar": "char",
    "bit": "boolean",
    "money": "decimal",
    "smallmoney": "decimal",
    "datetime2": "timestamp",
    "datetimeoffset": "timestamp",
    "uniqueidentifier": "varchar",
    "image": "binary",
    "ntext": "text",
    "serial": "int",
    "bigserial": "bigint",
    "smallserial": "smallint",
    "real": "float",
    "double precision": "double",
    "character varying": "varchar",
    "character": "char",
    "bytea": "binary",
    "json": "text",
    "jsonb": "text",
    "uuid": "varchar",
    "interval": "varchar",
    "mediumint": "int",
    "mediumtext": "text",
    "longtext": "text",
    "tinytext": "text",
    "enum": "varchar",
    "set": "varchar",
    "year": "int",
}

# Canonical type name to Spark type name (decimals keep their declared precision).
SPARK_TYPES = {
    "string": "string",
    "varchar": "string",
    "char": "string",
    "text": "string",
    "tinyint": "tinyint",
    "byte": "tinyint",
    "smallint": "smallint",
    "short": "smallint",
    "int": "int",
    "integer": "int",
    "bigint": "bigint",
    "long": "bigint",
    "float": "float",
    "double": "double",
    "boolean": "boolean",
    "bool": "boolean",
    "date": "date",
    "timestamp": "timestamp",
    "datetime": "timestamp",
    "timestamp_ntz": "timestamp_ntz",
    "binary": "binary",
}

# What fills NULL in a NOT NULL column.
NOT_NULL_DEFAULTS = {
    "string": "''",
    "tinyint": "0",
    "smallint": "0",
    "int": "0",
    "bigint": "0",
    "float": "0.0",
    "double": "0.0",
    "decimal": "0",
    "boolean": "false",
    "date": "'1970-01-01'",
    "timestamp": "'1970-01-01 00:00:00'",
    "timestamp_ntz": "'1970-01-01 00:00:00'",
}


def base_type(name: str) -> str:
    """Type name without length or precision, canonical over the dialects."""
    plain = name.lower().split("(")[0].strip()
    return DIALECT_TYPES.get(plain, plain)


def spark_type(name: str) -> str:
    """Spark SQL type for a declared type; unknown names become string, decimals keep (p,s), default (18,4)."""
    base = base_type(name)
    if base in ("decimal", "numeric"):
        args = re.search(r"\(\s*(\d+)\s*(?:[,.]\s*(\d+)\s*)?\)", name)
        return f"decimal({args[1]},{args[2] or 0})" if args else "decimal(18,4)"
    return SPARK_TYPES.get(base, "string")


@dataclass
class ColumnSpec:
    """One column: declared type, key flags and statistics (keys as in the profile)."""

    name: str
    data_type: str = "string"
    nullable: bool = True
    primary_key: bool = False
    stats: dict = field(default_factory=dict)


@dataclass
class ForeignKey:
    column: str
    references_table: str
    references_column: str
    orphan_ratio: float = 0.0


@dataclass
class TableSpec:
    name: str
    columns: list[ColumnSpec]
    row_count: int = 1000
    foreign_keys: list[ForeignKey] = field(default_factory=list)

    def column(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)


@dataclass
class Blueprint:
    blueprint_id: str
    tables: list[TableSpec]
    source: str = ""

    def table(self, name: str) -> TableSpec:
        return next(t for t in self.tables if t.name == name)


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
