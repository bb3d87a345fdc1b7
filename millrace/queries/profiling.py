"""Catalogue, profiles, blueprints, drift and keys."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans import blueprint as B
from millrace.plans import profile as P
from millrace.queries.aggregating import union_sql
from millrace.queries.base import Registry
from millrace.runtime import load, scratch_path

R = Registry()

ALL = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3,
    "benchmark": 2, "labels": 3, "conversations": 4,
}


def _tables(spark, d, names):
    return {t: load(spark, d, t) for t in names}


@R.add(
    "crawl_catalog",
    "\nUNION ALL\n".join(f"SELECT 'catalog' AS source, '{t}' AS table_name, {n}::BIGINT AS n_columns, count(*) AS row_count FROM {t}" for t, n in ALL.items())
    + "\nUNION ALL SELECT 'failed', 'broken', NULL, NULL",
)
def crawl_catalog(spark, d):
    """All given tables as a database of the session, with a view whose table is gone."""
    db = f"crawl_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {db}")
    for t in ALL:
        spark.catalog.createTable(f"{db}.{t}", path=f"{d}/{t}.parquet", source="parquet")
    spark.catalog.createTable(f"{db}.gone", path=f"{d}/region.parquet", source="parquet")
    spark.sql(f"CREATE VIEW {db}.broken AS SELECT * FROM {db}.gone")
    spark.sql(f"DROP TABLE {db}.gone")
    found, failed = B.crawl(spark, [db, "information_schema"])
    lost = spark.createDataFrame([("failed", t, None, None) for t in failed], "source string, table_name string, n_columns bigint, row_count bigint")
    return found.unionByName(lost).withColumn("table_name", F.element_at(F.split("table_name", r"\."), -1))


CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@R.add(
    "profile_table",
    union_sql(
        """SELECT '{c}' AS column_name, count(*) AS row_count, (count(*) - count({c})) / count(*)::DOUBLE AS null_ratio, count(DISTINCT {c}) AS distinct_count,
        round(avg(TRY_CAST({c}::VARCHAR AS DOUBLE)), 4) AS mean, CASE WHEN '{c}' IN ('c_name', 'c_mktsegment') THEN max(length({c}::VARCHAR)) END::INT AS max_length,
        (SELECT {c}::VARCHAR FROM customer GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1) AS top_value,
        round((SELECT count(*) FROM customer GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) / count(*)::DOUBLE, 8) AS top_frequency FROM customer""",
        CUST,
    ),
)
def profile_table(spark, d):
    out = P.profile(load(spark, d, "customer"), exact=True)
    top = F.col("top_values")[0]
    return out.select(
        "column_name", "row_count", "null_ratio", "distinct_count", F.round("mean", 4).alias("mean"), "max_length",
        top["value"].alias("top_value"), F.round(top["frequency"], 8).alias("top_frequency"),
    )


def _profiles(spark, d, names):
    parts = [P.profile(load(spark, d, t), k=5).withColumn("table_name", F.lit(t)) for t in names]
    return reduce(DataFrame.unionByName, parts)


# foreign keys of the given tables as rows, one per constraint
def _fk_rows(spark, d):
    tables = _tables(spark, d, ("nation", "customer"))
    kept = [
        df.agg(F.count(F.lit(1)).alias("n")).select(*[F.lit(v).alias(k) for k, v in row.items()])
        for df, row in (
            (tables["customer"], {"table_name": "customer", "column_name": "c_nationkey", "references_table": "nation", "references_column": "n_nationkey"}),
            (tables["nation"], {"table_name": "nation", "column_name": "n_regionkey", "references_table": "region", "references_column": "r_regionkey"}),
        )
    ]
    return kept[0].unionByName(kept[1])


@R.add(
    "assemble_blueprint",
    """SELECT 'bp-1' AS blueprint_id, name, rows AS row_count, cols AS n_columns, first_column, 3::BIGINT AS table_count, 2 AS n_relationships
    FROM (SELECT 'customer' AS name, 5 AS cols, 'c_custkey' AS first_column, (SELECT count(*) FROM customer) AS rows
      UNION ALL SELECT 'nation', 3, 'n_nationkey', (SELECT count(*) FROM nation) UNION ALL SELECT 'orders', 6, 'o_orderkey', (SELECT count(*) FROM orders))""",
)
def assemble_blueprint(spark, d):
    doc = B.assemble(_profiles(spark, d, ("customer", "nation", "orders")), B.relationships(_fk_rows(spark, d)), "bp-1", "files")
    tables = F.from_json("tables_json", "array<struct<name string, row_count bigint, columns array<struct<name string>>>>")
    n = F.size(F.from_json("relationships_json", "array<struct<from_table string>>"))
    out = doc.select("blueprint_id", "table_count", n.alias("n_relationships"), F.explode(tables).alias("t"))
    return out.select(
        "blueprint_id", "t.name", "t.row_count", F.size("t.columns").alias("n_columns"), F.col("t.columns")[0]["name"].alias("first_column"),
        "table_count", "n_relationships",
    )


@R.add("blueprint_store", "SELECT 'bp-1' AS blueprint_id, 2 AS version, 2::BIGINT AS table_count, 3 AS saved")
def blueprint_store(spark, d):
    path = scratch_path(spark, "blueprints")
    rel = B.relationships(_fk_rows(spark, d))
    B.save(B.assemble(_profiles(spark, d, ("nation",)), rel, "bp-1", "files"), path, 1)
    B.save(B.assemble(_profiles(spark, d, ("nation", "customer")), rel, "bp-1", "files"), path, 2)
    B.save(B.assemble(_profiles(spark, d, ("region",)), rel, "bp-2", "files"), path, 1)
    saved = B.summaries(spark, path).agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    return B.load(spark, path, "bp-1").select("blueprint_id", "version", "table_count", saved.alias("saved"))


@R.add(
    "blueprint_join",
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT count(*) FROM {t}) AS row_count, {n}::BIGINT AS n_columns"
        for t, n, cols in (("customer", 5, CUST), ("nation", 3, ["n_nationkey", "n_name", "n_regionkey"])) for c in cols
    ),
)
def blueprint_join(spark, d):
    names = ("customer", "nation", "orders")
    meta = B.crawl_tables(_tables(spark, d, names), "files").filter("table_name <> 'orders'").drop("source", "row_count")
    return meta.join(_profiles(spark, d, names[:2]), "table_name", "left").select("table_name", "column_name", "row_count", "n_columns")


# a catalogue that grows with the data: one table per customer, columns and types from that customer's orders
def _column_list(orders, when):
    kind = F.when(F.col("o_totalprice") > 250000, "double").otherwise("decimal")
    cols = orders.filter(when).select(
        F.concat(F.lit("t"), "o_custkey").alias("table_name"), F.concat(F.lit("c"), F.col("o_orderkey") % 5).alias("column_name"), kind.alias("data_type")
    )
    return cols.groupBy("table_name", "column_name").agg(F.max("data_type").alias("data_type"))


DRIFT_SQL = """WITH l AS (SELECT 't' || o_custkey AS t, 'c' || (o_orderkey % 5) AS c, o_orderdate < TIMESTAMP '1996-01-01' AS old, CASE WHEN o_totalprice > 250000 THEN 'double' ELSE 'decimal' END AS k FROM orders),
  a AS (SELECT t, c, max(k) AS k FROM l WHERE old GROUP BY t, c), b AS (SELECT t, c, max(k) AS k FROM l WHERE NOT old GROUP BY t, c),
  j AS (SELECT coalesce(a.t, b.t) AS t, coalesce(a.c, b.c) AS c, a.k AS ka, b.k AS kb FROM a FULL JOIN b ON a.t = b.t AND a.c = b.c)
SELECT t AS table_name, NULL AS column_name, CASE WHEN bool_and(ka IS NULL) THEN 'table_added' ELSE 'table_removed' END AS change, NULL AS old_type, NULL AS new_type FROM j GROUP BY t HAVING bool_and(ka IS NULL) OR bool_and(kb IS NULL)
UNION ALL SELECT t, c, CASE WHEN ka IS NULL THEN 'column_added' WHEN kb IS NULL THEN 'column_removed' ELSE 'type_changed' END, ka, kb FROM j
WHERE (ka IS DISTINCT FROM kb) AND t IN (SELECT t FROM a) AND t IN (SELECT t FROM b)"""


@R.add("schema_drift", DRIFT_SQL)
def schema_drift(spark, d):
    orders = load(spark, d, "orders")
    old, new = "o_orderdate < timestamp_ntz '1996-01-01'", "o_orderdate >= timestamp_ntz '1996-01-01'"
    return B.drift(_column_list(orders, old), _column_list(orders, new))


@R.add(
    "statistic_drift",
    """SELECT 'value' AS column_name, round(avg(value) FILTER (event_type <> 'purchase'), 4) AS old_mean, round(avg(value) * 2, 4) AS new_mean FROM events""",
)
def statistic_drift(spark, d):
    events = load(spark, d, "events").select("user_id", "value", "event_type")
    before = P.statistics(events.filter("event_type <> 'purchase'"), ["user_id", "value"], accuracy=0)
    after = P.statistics(events.withColumn("value", F.col("value") * 2), ["user_id", "value"], accuracy=0)
    out = B.statistic_drift(before, after)
    return out.select("column_name", F.round("old_mean", 4).alias("old_mean"), F.round("new_mean", 4).alias("new_mean"))


KEYED = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
}
PK_SQL = "\nUNION ALL\n".join(
    f"SELECT 'primary_key' AS kind, '{t}' AS table_name, '{c}' AS column_name, NULL AS references_table, NULL AS references_column FROM {t} HAVING count(DISTINCT {c}) = count(*)"
    for t, cols in KEYED.items() for c in cols
)
_PKS = [("nation", "n_nationkey"), ("nation", "n_name"), ("customer", "c_custkey"), ("customer", "c_name"), ("orders", "o_orderkey")]
_TEXT = {"n_name", "c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority"}
FK_SQL = "\nUNION ALL\n".join(
    f"SELECT 'foreign_key', '{t}', '{c}', '{pt}', '{pc}' FROM {t} HAVING bool_and({c} IN (SELECT {pc} FROM {pt}))"
    for t, cols in KEYED.items() for c in cols for pt, pc in _PKS if pt != t and ((c in _TEXT) == (pc in _TEXT))
)


@R.add("key_inference", f"{PK_SQL}\nUNION ALL\n{FK_SQL}")
def key_inference(spark, d):
    return B.infer_keys(_tables(spark, d, KEYED))


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_NUMBERS = _LINE[:4]
COMPOSITE_SQL = "\nUNION ALL\n".join(
    [f"SELECT 'primary_key' AS kind, 'orders' AS table_name, '{c}' AS column_name, NULL AS references_table, NULL AS references_column FROM orders HAVING count(DISTINCT {c}) = count(*)" for c in ("o_orderkey", "o_custkey", "o_orderdate")]
    + [f"SELECT 'primary_key', 'lineitem', '{a},{b}', NULL, NULL FROM lineitem HAVING count(DISTINCT ({a}, {b})) = count(*)" for k, a in enumerate(_LINE) for b in _LINE[k + 1 :]]
    + [f"SELECT 'foreign_key', 'lineitem', '{c}', 'orders', 'o_orderkey' FROM lineitem HAVING bool_and({c} IN (SELECT o_orderkey FROM orders))" for c in _LINE_NUMBERS]
)


@R.add("composite_key_inference", COMPOSITE_SQL)
def composite_key_inference(spark, d):
    return B.infer_keys(_tables(spark, d, ("orders", "lineitem")), composite=2)


KINDS = ["int", "bigint", "varchar(30)", "decimal(8,2)", "date", "boolean", "timestamp", "double", "uuid"]


@R.add(
    "default_stats",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END AS null_ratio,
    CASE k WHEN 0 THEN CASE WHEN pk THEN 1000 ELSE 500 END WHEN 1 THEN 1000 WHEN 2 THEN 500 WHEN 3 THEN 800 WHEN 4 THEN 1000 WHEN 5 THEN 2 WHEN 6 THEN 1000 WHEN 7 THEN 800 ELSE 500 END::BIGINT AS distinct_count,
    CASE WHEN k IN (0, 1) THEN 1.0::DOUBLE WHEN k IN (3, 7) THEN 0.0::DOUBLE END AS min_number,
    CASE WHEN k IN (0, 1) AND pk THEN 1000.0::DOUBLE WHEN k = 0 THEN 1000.0::DOUBLE WHEN k = 1 THEN 100000.0::DOUBLE WHEN k = 3 THEN 100000.0::DOUBLE WHEN k = 7 THEN 10000.0::DOUBLE END AS max_number,
    CASE k WHEN 2 THEN 3 WHEN 8 THEN 5 END::INT AS min_length, CASE k WHEN 2 THEN 30 WHEN 8 THEN 20 END::INT AS max_length,
    CASE WHEN k IN (4, 6) THEN '2020-01-01' END AS min_date, CASE WHEN k = 5 THEN 0.5::DOUBLE END AS true_ratio
    FROM (SELECT o_orderkey, o_orderstatus, o_orderkey % 9 AS k, o_custkey % 2 = 0 AS pk FROM orders)""",
)
def default_stats(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    cols = load(spark, d, "orders").select(
        "o_orderkey", kind.alias("data_type"), (F.col("o_orderstatus") != "F").alias("nullable"), (F.col("o_custkey") % 2 == 0).alias("is_primary_key"),
        F.lit(30).alias("max_len"), F.lit(8).alias("num_precision"), F.lit(2).alias("num_scale"),
    )
    out = B.default_stats(cols, 1000)
    return out.select("o_orderkey", "null_ratio", "distinct_count", "min_number", "max_number", "min_length", "max_length", "min_date", "true_ratio")


TYPE_CASES = {"NUMBER(10,2)": "decimal", "VARCHAR2(50)": "varchar", "jsonb": "text", "bigserial": "bigint", "double precision": "double", "int": "int", "Geometry": "geometry"}


@R.add(
    "type_normalize",
    f"""SELECT o_orderkey, {list(TYPE_CASES)}[o_orderkey % 7 + 1] AS raw_type, {list(TYPE_CASES.values())}[o_orderkey % 7 + 1] AS canonical_type FROM orders""",
)
def type_normalize(spark, d):
    raw = F.element_at(F.array(*[F.lit(k) for k in TYPE_CASES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return B.normalize_types(load(spark, d, "orders").select("o_orderkey", raw.alias("raw_type")), "raw_type")


NAME_CASES = {"created_at": "timestamp", "row_count": "int", "unit_price": "decimal", "is_open": "boolean", "label": "varchar", "hit_rate": "decimal"}


@R.add(
    "column_type_guess",
    f"""SELECT o_orderkey, {list(NAME_CASES)}[o_orderkey % 6 + 1] || '_' || o_custkey AS column_name, {list(NAME_CASES.values())}[o_orderkey % 6 + 1] AS data_type FROM orders""",
)
def column_type_guess(spark, d):
    name = F.element_at(F.array(*[F.lit(k) for k in NAME_CASES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return B.guess_types(load(spark, d, "orders").select("o_orderkey", F.concat_ws("_", name, "o_custkey").alias("column_name")), "column_name")


@R.add(
    "mapping_to_blueprint",
    """SELECT 'T_' || n_name AS table_name, 'c' || c_custkey AS column_name, CASE WHEN c_custkey % 2 = 0 THEN 'varchar' ELSE 'number' END AS data_type,
    CASE WHEN c_custkey % 2 = 0 THEN 40 ELSE 12 END::INT AS max_len, c_custkey % 3 <> 0 AS nullable, c_custkey % 50 = 0 AS is_primary_key,
    CASE WHEN c_custkey % 7 = 0 THEN 'T_X' END AS fk_table, CASE WHEN c_custkey % 7 = 0 THEN 'id' END AS fk_column
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def mapping_to_blueprint(spark, d):
    rows = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    mapping = rows.select(
        F.col("c_name").alias("src_col"), F.concat(F.lit("T_"), "n_name").alias("Tgt_Table"), F.concat(F.lit("c"), k).alias("target_column"),
        F.when(k % 2 == 0, "VARCHAR(40)").otherwise("NUMBER (12)").alias("tgt_data_type"), F.when(k % 3 == 0, "N").otherwise("Y").alias("nullable"),
        F.when(k % 50 == 0, "yes").alias("is_pk"), F.when(k % 7 == 0, "T_X").alias("ref_table"), F.when(k % 7 == 0, "id").alias("ref_column"),
    )
    return B.mapping_to_schema(mapping)


@R.add(
    "ddl_inventory",
    """WITH t AS (
      SELECT * FROM (VALUES (0, 'id', 'decimal', 10, 10, 2, NULL, false, true), (1, 'label', 'varchar', 50, NULL, NULL, '''n/a''', false, false), (2, 'nation_id', 'int', NULL, NULL, NULL, '7', true, false),
        (3, 'state', 'char', 8, NULL, NULL, NULL, true, false)) AS v(position, column_name, data_type, max_len, num_precision, num_scale, default_value, nullable, is_primary_key)
      UNION ALL SELECT 3 + i, 'wide_' || i, 'decimal', 12, 12, NULL, NULL, true, false FROM range(1, 501) r(i))
    SELECT c_custkey::VARCHAR AS file, 'app.t' || c_custkey AS table_name, position::INT AS position, column_name, data_type, max_len::INT AS max_len, num_precision::INT AS num_precision,
    num_scale::INT AS num_scale, default_value, nullable, is_primary_key, false AS is_unique, CASE WHEN position = 2 THEN 'nation' END AS fk_table, CASE WHEN position = 2 THEN 'id' END AS fk_column,
    CASE WHEN position = 3 THEN 'A,' || c_mktsegment ELSE '' END AS accepted FROM customer, t""",
)
def ddl_inventory(spark, d):
    # a text is long and its row short: as many tasks as the session has shuffle partitions, whatever the bytes of the table
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    wide = F.lit("".join(f",\n  wide_{i} DECIMAL(12)" for i in range(1, 501)))
    text = F.concat(
        F.lit("-- script\nCREATE TABLE app.t"), "c_custkey", F.lit(" (\n  id NUMBER(10,2), -- key\n  label VARCHAR2(50) DEFAULT 'n/a' NOT NULL,\n  nation_id INT DEFAULT 7,\n  state CHAR(8) CHECK (state IN ('A', '"),
        "c_mktsegment", F.lit("'))"), wide, F.lit(",\n  CONSTRAINT pk PRIMARY KEY (id)\n);\nCREATE INDEX i ON t (label);\nALTER TABLE app.t"), "c_custkey",
        F.lit(" ADD CONSTRAINT fk FOREIGN KEY (nation_id) REFERENCES nation (id);"),
    )
    out = B.ddl_inventory(c.select(F.col("c_custkey").cast("string").alias("file"), text.alias("value")))
    return out.withColumn("accepted", F.array_join("check_values", ",")).drop("check_values", "raw_type")


@R.add(
    "relationship_edges",
    "SELECT 'customer' AS from_table, 'o' || o_orderstatus AS to_table, 'one_to_many' AS relationship_type, 'k' || o_custkey AS from_column, 'c' || o_orderkey AS to_column FROM orders",
)
def relationship_edges(spark, d):
    fks = load(spark, d, "orders").select(
        F.concat(F.lit("o"), "o_orderstatus").alias("table_name"), F.concat(F.lit("c"), "o_orderkey").alias("column_name"),
        F.lit("customer").alias("references_table"), F.concat(F.lit("k"), "o_custkey").alias("references_column"),
    )
    return B.relationships(fks)
