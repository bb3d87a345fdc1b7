"""Blueprints: catalogue crawl, assembled specification, store, drift, keys and specifications from files."""

from __future__ import annotations

import logging
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.joins import orphan_ratio
from millrace.plans.profile import statistics
from millrace.runtime import stored
from millrace.spec import DIALECT_TYPES, Blueprint, ColumnSpec, ForeignKey, TableSpec

log = logging.getLogger(__name__)

SYSTEM_SCHEMAS = ("information_schema", "sys", "pg_catalog")


def crawl_tables(tables: dict[str, DataFrame], source: str) -> DataFrame:
    """(source, table_name, n_columns, row_count); all counts in one job."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(source).alias("source"), F.lit(name).alias("table_name"),
            F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "row_count",
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def crawl(spark: SparkSession, databases: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Crawl the session catalogue; a table that cannot be opened is logged and reported in the second result."""
    found, failed = {}, []
    for db in databases or [d.name for d in spark.catalog.listDatabases()]:
        if db.lower() in SYSTEM_SCHEMAS:
            continue
        for t in spark.catalog.listTables(db):
            name = f"{db}.{t.name}"
            try:
                df = spark.table(name)
                df.schema
                found[name] = df
            except Exception as e:  # noqa: BLE001 - any reader error makes the table unreadable
                log.warning("skipping %s: %s", name, e)
                failed.append(name)
    return crawl_tables(found, "catalog"), failed


def columns_of(tables: dict[str, DataFrame]) -> list[tuple[str, str, int, str]]:
    return [(t, f.name, i, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]


def column_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame(columns_of(tables), "table_name string, column_name string, position int, data_type string")


def assemble(profiles: DataFrame, relationships: DataFrame, blueprint_id: str, source: str) -> DataFrame:
    """One blueprint row: tables with their column statistics and relationships as JSON. ``profiles`` is the union of
    profiles with ``table_name``; its size is the number of columns, not of rows."""
    stats = F.struct(
        "distinct_count", "null_ratio", F.col("min_value").alias("min"), F.col("max_value").alias("max"), "mean", "stddev",
        "min_length", "max_length", "pattern", "top_values",
        F.struct("p25", "p50", "p75", "p95", "p99").alias("percentiles"),
    )
    column = F.struct(
        "position", F.col("column_name").alias("name"), "data_type", (F.col("null_ratio") > 0).alias("nullable"),
        F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"), stats.alias("stats"),
    )
    if "is_primary_key" not in profiles.columns:
        profiles = profiles.withColumn("is_primary_key", F.lit(False))
    tables = profiles.groupBy(F.col("table_name").alias("name")).agg(
        F.max("row_count").alias("row_count"), F.array_sort(F.collect_list(column)).alias("columns")
    )
    listed = tables.agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "row_count", "columns")))).alias("tables_json"), F.count(F.lit(1)).alias("table_count"))
    rel = relationships.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*relationships.columns)))).alias("r")).scalar()
    return listed.select(
        F.lit(blueprint_id).alias("blueprint_id"), F.lit(source).alias("source"), "table_count", "tables_json",
        rel.alias("relationships_json"),
    )


def save(blueprint: DataFrame, path: str, version: int) -> None:
    """Append one version; there is no time travel on Parquet, so versions are a column."""
    stamped = blueprint.withColumns({"version": F.lit(version), "created_at": F.current_timestamp()})
    stamped.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, blueprint_id: str | None = None) -> DataFrame:
    """Newest version of each blueprint, or of one."""
    stored = spark.read.parquet(path)
    if blueprint_id:
        stored = stored.filter(F.col("blueprint_id") == blueprint_id)
    newest = stored.groupBy("blueprint_id").agg(F.max_by(F.struct(*stored.columns), "version").alias("r"))
    return newest.select("r.*")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """All saved versions without their documents."""
    return spark.read.parquet(path).select("blueprint_id", "version", "source", "table_count", "created_at")


def drift(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Compare two column tables (table_name, column_name, data_type): tables and columns added or removed (columns only
    in tables both have) and changed types."""
    a = previous.select("table_name", "column_name", F.col("data_type").alias("old_type"))
    b = current.select("table_name", "column_name", F.col("data_type").alias("new_type"))
    ta = a.select("table_name").distinct().withColumn("in_old", F.lit(True))
    tb = b.select("table_name").distinct().withColumn("in_new", F.lit(True))
    tables = ta.join(tb, "table_name", "full_outer")
    table_change = F.when(F.col("in_old").isNull(), "table_added").when(F.col("in_new").isNull(), "table_removed")
    none = F.lit(None).cast("string")
    moved = tables.select("table_name", none.alias("column_name"), table_change.alias("change"), none.alias("old_type"), none.alias("new_type"))
    shared = tables.filter("in_old and in_new").select("table_name")
    cols = a.join(b, ["table_name", "column_name"], "full_outer").join(shared, "table_name", "left_semi")
    column_change = (
        F.when(F.col("old_type").isNull(), "column_added").when(F.col("new_type").isNull(), "column_removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
    )
    changed = cols.select("table_name", "column_name", column_change.alias("change"), "old_type", "new_type")
    return moved.unionByName(changed).filter("change is not null")


def has_drift(changes: DataFrame) -> DataFrame:
    return changes.agg((F.count(F.lit(1)) > 0).alias("has_drift"))


def statistic_drift(previous: DataFrame, current: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Columns of two profiles whose null ratio or mean moved by more than the tolerance."""
    a = previous.select("column_name", F.col("null_ratio").alias("old_nulls"), F.col("mean").alias("old_mean"))
    b = current.select("column_name", F.col("null_ratio").alias("new_nulls"), F.col("mean").alias("new_mean"))
    moved = F.abs(F.col("new_mean") - F.col("old_mean")) / F.greatest(F.abs("old_mean"), F.lit(1.0)) > tolerance
    both = a.join(b, "column_name").withColumn("mean_moved", F.coalesce(moved, F.lit(False)))
    return both.withColumn("nulls_moved", F.abs(F.col("new_nulls") - F.col("old_nulls")) > 0.01).filter("mean_moved or nulls_moved")


# classes of types whose values can be compared; floating point numbers make no keys
KEY_KINDS = {"tinyint": "n", "smallint": "n", "int": "n", "bigint": "n", "string": "s", "date": "d", "timestamp": "t", "timestamp_ntz": "t"}
#: Values of a column (or tuples of a column set) that the first, refuting look takes in, about.
LOOK = 100_000


def _key_kind(data_type: str) -> str | None:
    return "m" if data_type.startswith("decimal") else KEY_KINDS.get(data_type)


def _key_text(col: str, kind: str) -> Column:
    """A value as a text that is equal exactly for equal values of a kind."""
    v = F.col(f"`{col}`").cast("string")
    if kind == "m":  # decimals of any scale
        return F.when(v.contains("."), F.regexp_replace(F.regexp_replace(v, "0+$", ""), r"\.$", "")).otherwise(v)
    return F.unix_micros(F.col(f"`{col}`").cast("timestamp")).cast("string") if kind == "t" else v


def infer_keys(tables: dict[str, DataFrame], pk_only: bool = False, composite: int = 1) -> DataFrame:
    """Candidate keys: (kind, table_name, column_name, references_table, references_column); columns of a key are joined by commas.

    A primary key is an integral, decimal, date, time or text column without NULLs in which no value repeats. Tables that have none
    are searched for keys of up to ``composite`` columns, level by level; the first level with a key ends the search, so all keys found are
    minimal. A foreign key is a column (or for a key of several columns a tuple of columns) of the same kind all of whose values
    occur in a primary key of another table; tuples are built only from columns that are included one by one.

    Everything is decided exactly. A first look at the values whose hash falls into a share of about ``LOOK`` rows a table keeps all
    rows of each value it looks at, so what it refutes is refuted; only the rest is shuffled whole. Ranges prune inclusions.
    """
    spark = next(iter(tables.values())).sparkSession
    stats = {t: {r["column_name"]: r for r in statistics(df, accuracy=0, distinct=False, text_range=True).collect()} for t, df in tables.items()}
    kinds = {(t, c): _key_kind(s["data_type"]) for t, own in stats.items() for c, s in own.items() if s["non_null_count"] > 0}
    columns = [x for x, k in kinds.items() if k]
    rows = {t: max([s["row_count"] for s in own.values()], default=0) for t, own in stats.items()}
    share = max(1, max(rows.values(), default=0) // LOOK)

    def cells(sets: list[tuple[str, tuple[str, ...]]], part: int) -> DataFrame:
        """(tag, v, w): the values of column sets as two hashes, from one scan of each table; only one value in ``part``. Rows with a NULL in the set are left out."""
        parts = []
        for t in dict.fromkeys(t for t, _ in sets):
            mine = []
            for k, (_, cols) in enumerate(sets):
                if sets[k][0] == t:
                    text = [_key_text(c, kinds[t, c]) for c in cols]
                    there = reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in cols])
                    mine.append(F.when(there, F.struct(F.lit(k).alias("tag"), F.xxhash64(*text).alias("v"), F.xxhash64(F.lit(1), *text).alias("w"))))
            parts.append(tables[t].select(F.inline(F.array_compact(F.array(*mine)))))
        every = reduce(DataFrame.unionAll, parts)
        return every.filter(F.pmod("v", F.lit(part)) == 0) if part > 1 else every

    def unique(sets: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, tuple[str, ...]]]:
        """The column sets in which nothing repeats."""
        for part in dict.fromkeys((share, 1)):
            if sets:
                twice = cells(sets, part).groupBy("tag", "v", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                gone = {r.tag for r in twice.select("tag").distinct().collect()}
                sets = [x for k, x in enumerate(sets) if k not in gone]
        return sets

    def included(pairs: list[tuple]) -> list[tuple]:
        """The pairs (column set, column set) of which all values of the first occur in the second."""
        for part in dict.fromkeys((share, 1)):
            if pairs:
                sets = list(dict.fromkeys(x for p in pairs for x in p))
                asked = F.broadcast(spark.createDataFrame([(sets.index(a), sets.index(b)) for a, b in pairs], "tag int, key int"))
                values = cells(sets, part).distinct()
                child = values.join(asked.select("tag").distinct(), "tag", "left_semi")
                parent = values.withColumnRenamed("tag", "key").join(asked.select("key").distinct(), "key", "left_semi")
                met = child.join(parent, ["v", "w"]).join(asked, ["tag", "key"], "left_semi").groupBy("tag", "key").agg(F.count(F.lit(1)).alias("n"))
                all_of = {r.tag: r.n for r in child.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).collect()}
                got = {(r.tag, r.key): r.n for r in met.collect()}
                pairs = [(a, b) for a, b in pairs if got.get((sets.index(a), sets.index(b)), 0) == all_of.get(sets.index(a), 0)]
        return pairs

    def possible(a: tuple[str, str], b: tuple[str, str]) -> bool:
        if a[0] == b[0] or kinds[a] != kinds[b]:
            return False
        s, p = stats[a[0]][a[1]], stats[b[0]][b[1]]
        lo, hi = ("min_number", "max_number") if kinds[a] in "nm" else ("min_value", "max_value")
        return s[lo] >= p[lo] and s[hi] <= p[hi]

    full = {x for x in columns if stats[x[0]][x[1]]["null_count"] == 0}
    keys = unique([(t, (c,)) for t, c in columns if (t, c) in full])
    for size in range(2, composite + 1):
        bare = [t for t in tables if t not in {k[0] for k in keys}]
        keys += unique([(t, cols) for t in bare for cols in combinations([c for x, c in columns if x == t and (x, c) in full], size)])
    found = [("primary_key", t, ",".join(cols), None, None) for t, cols in keys]
    if not pk_only:
        targets = dict.fromkeys((t, c) for t, cols in keys for c in cols)
        single = included([((a[0], (a[1],)), (b[0], (b[1],))) for a in columns for b in targets if possible(a, b)])
        tuples = []
        for pt, cols in keys:
            if len(cols) == 1:
                tuples += [(a, b) for a, b in single if b == (pt, cols)]
                continue
            for t in tables:
                options = [[a[1][0] for a, b in single if a[0] == t and b == (pt, (c,))] for c in cols]
                tuples += [((t, x), (pt, cols)) for x in product(*options) if len(set(x)) == len(x)]
        done = [x for x in tuples if len(x[1][1]) == 1]
        done += included([x for x in tuples if len(x[1][1]) > 1])
        found += [("foreign_key", t, ",".join(x), pt, ",".join(cols)) for (t, x), (pt, cols) in done]
    return spark.createDataFrame(
        found, "kind string, table_name string, column_name string, references_table string, references_column string"
    )


def relationships(fks: DataFrame) -> DataFrame:
    """Foreign keys as one-to-many relationships."""
    return fks.select(
        F.col("references_table").alias("from_table"), F.col("table_name").alias("to_table"),
        F.lit("one_to_many").alias("relationship_type"),
        F.col("references_column").alias("from_column"), F.col("column_name").alias("to_column"),
    )


def default_stats(columns: DataFrame, rows: int = 1000) -> DataFrame:
    """Statistics from type and constraints where there is no data.

    ``columns`` has data_type, nullable, is_primary_key and, if known, num_precision, num_scale, max_len,
    default_value, check_values (array). The numbers are fixed values.
    """
    have = set(columns.columns)

    def opt(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    base = F.lower(F.trim(F.substring_index("data_type", "(", 1)))
    pk = F.coalesce(opt("is_primary_key", "boolean"), F.lit(False))
    checks = F.col("check_values") if "check_values" in have else F.lit(None).cast("array<string>")
    checked = F.coalesce(F.size(checks), F.lit(0)) > 0
    n = float(rows)
    small = base.isin("int", "integer", "smallint", "tinyint")
    big = base.isin("bigint", "long")
    real = base.isin("float", "double")
    dec = base.isin("decimal", "numeric")
    text = base.isin("varchar", "char", "text", "string")
    day = base == "date"
    moment = base.isin("timestamp", "datetime")
    flag = base.isin("boolean", "bool")
    binary = base == "binary"
    other = ~(small | big | real | dec | text | day | moment | flag | binary)
    precision, scale = F.coalesce(opt("num_precision", "int"), F.lit(10)), F.coalesce(opt("num_scale", "int"), F.lit(2))
    dec_max = F.least(F.pow(F.lit(10.0), precision - scale) - 1, F.lit(100000.0))
    length = F.coalesce(opt("max_len", "int"), F.lit(50))
    seq = (small | big) & pk
    default = F.lower(opt("default_value", "string"))
    truth = F.when(default.isin("true", "1", "yes"), 0.7).when(default.isin("false", "0", "no"), 0.3).otherwise(0.5)
    dates = day | moment
    free = ~checked

    def pick(*cases) -> Column:
        out = F.lit(None).cast("double")
        for cond, value in reversed(cases):
            out = F.when(cond, value if isinstance(value, Column) else F.lit(float(value))).otherwise(out)
        return F.when(free, out)

    distinct = pick((seq, n), (small, min(500, rows)), (big, min(5000, rows)), (real | dec, min(800, rows)), (text | other, min(rows, 500)), (day, min(rows, 2000)), (moment | binary, n), (flag, 2))
    return columns.withColumns(
        {
            "null_ratio": F.when(F.coalesce(F.col("nullable"), F.lit(True)), 0.05).otherwise(0.0),
            "distinct_count": F.when(checked, F.size(checks)).otherwise(distinct).cast("bigint"),
            "min_number": pick((small | big, 1), (real | dec, 0)),
            "max_number": pick((seq, n), (small, 1000), (big, 100000), (real, 10000), (dec, dec_max)),
            "mean": pick((seq, n / 2), (small, 500), (big, 50000), (real, 100), (dec, dec_max / 10)),
            "stddev": pick((seq, n / 6), (small, 300), (big, 30000), (real, 50), (dec, dec_max / 20)),
            "min_length": pick((text, F.least(F.lit(3), length).cast("double")), (binary, 10), (other, 5)).cast("int"),
            "max_length": pick((text, F.least(length, F.lit(100)).cast("double")), (binary, 100), (other, 20)).cast("int"),
            "min_date": F.when(free & dates, F.lit("2020-01-01")),
            "max_date": F.when(free & dates, F.lit("2025-12-31")),
            "true_ratio": F.when(free & flag, truth),
        }
    )


# Words in column names and the type they suggest, in this order.
NAME_TYPES = [
    ("timestamp", "date|time|timestamp|created|modified"),
    ("int", "count|num|qty|amount|total|size"),
    ("decimal", "price|cost|rate|pct|percent|ratio|score"),
    ("boolean", "flag|is_|has_|enabled|active"),
]


def guess_types(df: DataFrame, col: str, name: str = "data_type") -> DataFrame:
    """Types of columns known by name only, as when just a SQL text names them; varchar if nothing fits."""
    guesses = [F.when(F.col(col).rlike(words), F.lit(kind)) for kind, words in NAME_TYPES]
    return df.withColumn(name, F.coalesce(*guesses, F.lit("varchar")))


def normalize_types(df: DataFrame, col: str, name: str = "canonical_type") -> DataFrame:
    """Dialect type names to canonical ones; length and precision are dropped, unknown names stay."""
    return df.withColumn(name, _canonical(F.lower(F.trim(F.substring_index(col, "(", 1)))))


def _canonical(base: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DIALECT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, base), base)


# Header names accepted in mapping files.
HEADERS = {
    "source_table": ["source_table", "src_table", "source_tbl", "from_table"],
    "source_column": ["source_column", "src_column", "src_col", "from_column"],
    "source_type": ["source_type", "src_type", "source_data_type", "src_data_type"],
    "target_table": ["target_table", "tgt_table", "target_tbl", "to_table"],
    "target_column": ["target_column", "tgt_column", "tgt_col", "to_column"],
    "target_type": ["target_type", "tgt_type", "target_data_type", "tgt_data_type"],
    "nullable": ["nullable", "null", "is_nullable", "allow_null"],
    "pk": ["pk", "primary_key", "is_pk", "is_primary_key"],
    "fk_table": ["fk_table", "ref_table", "references_table", "fk_ref_table"],
    "fk_column": ["fk_column", "ref_column", "references_column", "fk_ref_column"],
    "transformation": ["transformation", "transform", "rule", "mapping_rule"],
}


def mapping_to_schema(df: DataFrame, side: str = "target") -> DataFrame:
    """Rows of a source-to-target mapping as a column table with key references."""
    named = {c.strip().lower(): c for c in df.columns}

    def value(field: str) -> Column:
        hit = next((named[h] for h in HEADERS[field] if h in named), None)
        return F.trim(F.col(f"`{hit}`").cast("string")) if hit else F.lit(None).cast("string")

    yes = ("y", "yes", "true", "1")
    raw = F.coalesce(F.nullif(value(f"{side}_type"), F.lit("")), F.lit("varchar"))
    null_text = F.lower(F.coalesce(value("nullable"), F.lit("")))
    out = df.select(
        value(f"{side}_table").alias("table_name"),
        value(f"{side}_column").alias("column_name"),
        F.lower(F.trim(F.substring_index(raw, "(", 1))).alias("data_type"),
        F.regexp_extract(raw, r"\((\d+)", 1).try_cast("int").alias("max_len"),
        null_text.isin(*yes, "").alias("nullable"),
        F.lower(F.coalesce(value("pk"), F.lit(""))).isin(*yes).alias("is_primary_key"),
        F.nullif(value("fk_table"), F.lit("")).alias("fk_table"),
        F.nullif(value("fk_column"), F.lit("")).alias("fk_column"),
    )
    return out.filter("coalesce(table_name, '') <> '' and coalesce(column_name, '') <> ''")


_NAME = r"""[\w."`\[\]]+"""
# text in parentheses, two levels deep; possessive, so that long lists need no deep recursion
_INSIDE = r"(?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+"
_DEEP = r"\((?:[^()]++|\([^()]*+\))*+\)"
# what stands between the commas of a body, without the space before it; empty if it is space only
_ITEM = rf"\s*+([^\s,()][^,()]*+(?:{_DEEP}[^,()]*+)*+|(?:{_DEEP}[^,()]*+)++)|\s++"
_TYPE = r"double\s+precision|character\s+varying|\w+"
_MARKS = r"""["`\[\]]"""
# a name and a type with its size, neither of them a word that says more; single spaces
_PLAIN = r"(?i)^(?!(?:UNIQUE|IDENTITY|DEFAULT|REFERENCES|NOT) )\w+ (?!(?:UNIQUE|IDENTITY)\b)\w++(?<!SERIAL)(?: ?\((?: ?[\d,])*+ ?\))?\z"
#: Bytes of a text up to which the keys of its tables are looked up among those of the text itself.
OWN_BYTES = 1 << 16


def ddl_inventory(files: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """Columns declared by the CREATE TABLE statements of many DDL texts, one file per row: type, length, precision, scale, default,
    and the keys that the column, the table or an ALTER TABLE .. ADD statement gives.

    A statement finds the keys of its table in its own text. Only what files of several rows, and long texts, say of keys is
    shuffled and joined: such a text is read twice, any other once. No column is shuffled.
    """
    # the outer forms of explode compute their array once, the others also for the test that it has rows
    read = _statements(files, text, file, OWN_BYTES)
    named = read.select(file, "said", F.explode_outer("made").alias("s")).filter("s is not null")
    keyed = named.select(file, F.col("s.table_name").alias("table_name"), F.when(F.col(file).isNotNull(), _own_keys(F.col("said"), F.col("s.table_name"))).alias("keys"), F.col("s.items").alias("items"))
    many = files.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length(text)).alias("bytes")).filter((F.col(file).isNotNull()) & ((F.col("n") > 1) | (F.col("bytes") > OWN_BYTES))).select(file)
    if not many.isEmpty():
        many = stored(many, "ddl-files")
        keys = stored(_table_keys(_statements(files.join(many, file, "left_semi"), text, file), file), "ddl-keys").withColumnsRenamed({file: "__file", "table_name": "__table", "keys": "__keys"})
        joined = keyed.join(keys, (F.col(file) == F.col("__file")) & (F.col("table_name") == F.col("__table")), "left")
        keyed = joined.select(file, "table_name", F.coalesce("__keys", "keys").alias("keys"), "items")

    cols = keyed.select(file, "table_name", "keys", F.posexplode_outer("items").alias("position", "item")).filter((F.col("item") != "") & ~_constraint(F.col("item")))
    cols = cols.withColumn("more", ~F.col("item").rlike(_PLAIN)).withColumn("item", F.when(F.col("more"), _spaced(F.col("item"))).otherwise(F.col("item")))
    item = lambda pattern, group=1: F.nullif(F.regexp_extract("item", pattern, group), F.lit(""))
    more = lambda value, other=None: F.when(F.col("more"), value).otherwise(F.lit(other))
    has = lambda pattern: F.col("more") & F.col("item").rlike(pattern)
    size = rf"(?i)^\S+ (?:{_TYPE}) ?\( ?(\d+)(?: ?, ?(\d+))?"
    refs = rf"(?i)REFERENCES ({_NAME}) ?\( ?({_NAME})"
    # the words of a plain column, found without patterns
    word, last = F.substring_index("item", " ", 1), F.substring_index(F.substring_index("item", " ", 2), " ", -1)
    digits = F.substring_index(F.trim(F.substring_index(F.substring_index("item", "(", -1), ")", 1)), " ", 1)
    sizes = F.col("more") | F.contains("item", F.lit(","))
    out = cols.select(
        file, "table_name", "position", "keys", F.when(F.col("more"), _bare(F.regexp_extract("item", r"^(\S+)", 1))).otherwise(word).alias("column_name"),
        F.lower(F.when(F.col("more"), F.regexp_extract("item", rf"(?i)^\S+ ({_TYPE})", 1)).otherwise(F.substring_index(last, "(", 1))).alias("raw_type"),
        F.when(sizes, item(size)).when(F.contains("item", F.lit("(")), digits).try_cast("int").alias("max_len"), F.when(sizes, item(size, 2)).try_cast("int").alias("__scale"),
        more(item(r"(?i)\bDEFAULT ('(?:[^']++|'')*+'|[\w.+-]+(?:\([^()]*\))?|\([^()]*\))")).alias("default_value"),
        # SQL Server identities and the serial types of PostgreSQL number their rows: never NULL
        (~has(r"(?i)\bNOT NULL\b|\bPRIMARY KEY\b") & ~has(r"(?i)\bIDENTITY\b|^\S+ \w*SERIAL\b")).alias("nullable"), has(r"(?i)\bPRIMARY KEY\b").alias("__pk"),
        has(r"(?i)\bUNIQUE\b").alias("__unique"), more(_bare(item(refs))).alias("fk_table"), more(_bare(item(refs, 2))).alias("fk_column"),
        F.when(F.col("more"), F.regexp_extract_all(F.regexp_extract("item", r"(?i)(?:\bIN|\bENUM) ?\(([^()]*)\)", 1), F.lit(r"'([^']*)'"), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("check_values"),
    )
    out = out.withColumn("__key", F.try_element_at("keys", F.col("column_name")))
    exact = F.col("raw_type").isin("number", "numeric", "decimal", "dec")
    key = F.col("__pk") | F.coalesce("__key.pk", F.lit(False))
    out = out.select(
        file, "table_name", "column_name", "position", "raw_type", "max_len", F.when(exact, F.col("max_len")).alias("num_precision"), F.when(exact, F.col("__scale")).alias("num_scale"), "default_value",
        (F.col("nullable") & ~key).alias("nullable"), F.coalesce("fk_table", "__key.fk.t").alias("fk_table"), F.coalesce("fk_column", "__key.fk.c").alias("fk_column"), "check_values",
        key.alias("is_primary_key"), (F.col("__unique") | F.coalesce("__key.is_unique", F.lit(False))).alias("is_unique"),
    )
    return out.withColumn("data_type", _canonical(F.col("raw_type")))


def _constraint(item: Column) -> Column:
    # most items are columns, which their first letter tells
    return F.substring(item, 1, 1).isin(*"CPFUIKcpfuik") & item.rlike(r"(?i)^(CONSTRAINT|PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|INDEX|KEY)\b")


def _spaced(item: Column) -> Column:
    return F.trim(F.regexp_replace(item, r"\s+", " "))


def _statements(files: DataFrame, text: str, file: str, most: int | None = None) -> DataFrame:
    """(file, made, said): the CREATE TABLE statements of a text as structs of name and items, and what its constraints, those of ALTER TABLE
    with them, say of columns; nothing of the latter for texts of more than ``most`` bytes."""
    without = lambda x, mark, pattern: F.when(F.contains(x, F.lit(mark)), F.regexp_replace(x, pattern, " ")).otherwise(x)
    head = rf"(?is)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})\s*"

    def statement(s: Column) -> Column:
        # a head is of ASCII letters and has no parenthesis: the body begins after the first one, and the last letter closes it
        start = F.instr(s, "(")
        body = F.substr(s.cast("binary"), start + 1, F.octet_length(s) - start - 1).cast("string")
        return F.struct(_bare(F.regexp_extract(F.substring_index(s, "(", 1), head, 1)).alias("table_name"), F.regexp_extract_all(body, F.lit(_ITEM), F.lit(1)).alias("items"))

    # ALTER TABLE name ADD <constraint>: the same constraint texts as in a table's body
    alter = rf"(?is)ALTER(?<=\bALTER)\s+TABLE\s+(?:ONLY\s+)?({_NAME})\s+(?:WITH\s+(?:NO)?CHECK\s+)?ADD\s+([^;]*+)"
    rule = lambda table, item: F.struct(table.alias("table_name"), item.alias("item"))
    altered = F.transform(F.regexp_extract_all("__t", F.lit(alter), F.lit(0)), lambda s: rule(_bare(F.regexp_extract(s, alter, 1)), _spaced(F.regexp_extract(s, alter, 2))))
    inside = F.flatten(F.transform("made", lambda s: F.transform(F.filter(s["items"], _constraint), lambda x: rule(s["table_name"], _spaced(x)))))
    said = F.flatten(F.transform(F.concat(inside, altered), _said))
    texts = files.select(file, without(F.col(text), "--", r"--[^\n]*").alias("__t"), *([] if most is None else [(F.octet_length(text) <= most).alias("__own")]))
    made = texts.withColumn("__t", without(F.col("__t"), "/*", r"(?s)/\*.*?\*/")).withColumn("made", F.transform(F.regexp_extract_all("__t", F.lit(rf"{head}\({_INSIDE}\)"), F.lit(0)), statement))
    return made.select(file, "made", (said if most is None else F.when(F.col("__own"), said)).alias("said"))


def _said(rule: Column) -> Column:
    """What the constraint text of a table says of its columns, a struct for each."""
    none, item = F.lit(None).cast("string"), rule["item"]

    def entry(name: Column, mark: str, k: Column = none, t: Column = none, c: Column = none) -> Column:
        return F.struct(rule["table_name"].alias("table_name"), name.alias("column_name"), F.lit(mark == "pk").alias("pk"), F.lit(mark == "is_unique").alias("is_unique"), k.alias("k"), t.alias("t"), c.alias("c"))

    def listed(pattern: str, mark: str) -> Column:
        names = F.transform(F.split(F.regexp_extract(item, pattern, 1), ","), lambda x: F.trim(_bare(x)))
        return F.transform(F.filter(names, lambda x: x != ""), lambda x: entry(x, mark))

    fk = rf"(?i)FOREIGN KEY ?\( ?({_NAME}) ?\) ?REFERENCES ({_NAME}) ?\( ?({_NAME})"
    part = lambda k, n: _bare(F.regexp_extract(k, fk, n))
    fks = F.transform(F.regexp_extract_all(item, F.lit(fk), F.lit(0)), lambda k: entry(part(k, 1), "", k, part(k, 2), part(k, 3)))
    pks = listed(r"(?i)PRIMARY KEY(?: CLUSTERED| NONCLUSTERED)? ?\(([^)]*)\)", "pk")
    uniques = listed(r"(?i)^(?:CONSTRAINT \S+ )?UNIQUE(?: KEY)? ?\(([^),]*)\)", "is_unique")
    return F.concat(pks, uniques, fks)


def _own_keys(said: Column, table: Column) -> Column:
    """What is said of one table, as a map from column name to (pk, is_unique, fk)."""
    # a lambda does not see columns made by other lambdas' nesting, so the entries of the table are filtered once, into an array of one
    mine = F.filter(said, lambda e: e["table_name"] == table)

    def keys(own: Column) -> Column:
        def key(name: Column) -> Column:
            of = F.filter(own, lambda e: e["column_name"] == name)
            fk = F.array_min(F.transform(F.filter(of, lambda e: e["k"].isNotNull()), lambda e: F.struct(e["k"].alias("k"), e["t"].alias("t"), e["c"].alias("c"))))
            fk = F.when(fk.isNotNull(), F.struct(fk["t"].alias("t"), fk["c"].alias("c")))
            return F.struct(name.alias("column_name"), F.struct(F.exists(of, lambda e: e["pk"]).alias("pk"), F.exists(of, lambda e: e["is_unique"]).alias("is_unique"), fk.alias("fk")))

        return F.map_from_entries(F.transform(F.array_distinct(F.transform(own, lambda e: e["column_name"])), key))

    return F.get(F.transform(F.array(mine), keys), F.lit(0))


def _table_keys(read: DataFrame, file: str) -> DataFrame:
    """(file, table_name, keys): what the constraint texts of a table say of its columns, over all rows of a file, as a map from column name to (pk, is_unique, fk)."""
    said = read.select(file, F.explode_outer("said").alias("e")).filter("e is not null").select(file, "e.*")
    one = said.groupBy(file, "table_name", "column_name").agg(F.max("pk").alias("pk"), F.max("is_unique").alias("is_unique"), F.min_by(F.struct("t", "c"), "k").alias("fk"))
    return one.groupBy(file, "table_name").agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("pk", "is_unique", "fk")))).alias("keys"))


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, _MARKS, "")


def read_ddl(spark: SparkSession, path: str) -> DataFrame:
    """DDL files as whole texts with their names."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def to_table_spec(name: str, profile: DataFrame, keys: list[tuple] = (), fks: list[ForeignKey] = ()) -> TableSpec:
    """A specification on the driver from a profile (one small row per column)."""
    columns, rows = [], 0
    for r in profile.orderBy("position").collect():
        stats = {k: v for k, v in r.asDict(recursive=True).items() if k not in ("position", "column_name", "data_type")}
        rows = r["row_count"]
        columns.append(ColumnSpec(r["column_name"], r["data_type"], r["null_ratio"] > 0, r["column_name"] in keys, stats))
    return TableSpec(name, columns, rows, list(fks))


def with_orphan_ratios(spec: TableSpec, tables: dict[str, DataFrame]) -> TableSpec:
    """Measure the orphan ratio of each foreign key."""
    for fk in spec.foreign_keys:
        row = orphan_ratio(tables[spec.name], tables[fk.references_table], fk.column, fk.references_column).first()
        fk.orphan_ratio = row["orphan_ratio"]
    return spec


def blueprint_of(blueprint_id: str, specs: list[TableSpec], source: str = "") -> Blueprint:
    return Blueprint(blueprint_id, specs, source)
