"""Synthetic columns and tables after statistics of the given tables, as many rows as the table they imitate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import hashrand as H
from millrace.plans import blueprint as B
from millrace.plans import generate as G
from millrace.plans import profile as P
from millrace.queries.base import Registry
from millrace.runtime import load
from millrace.spec import Blueprint, ColumnSpec, ForeignKey, TableSpec

R = Registry()

SEED = 11


def u_sql(column: str, table: str = "t", key: str = "id") -> str:
    return f"(('0x' || substr(md5('{SEED}|{table}|{column}|' || {key}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def _poly_sql(coefs, x: str) -> str:
    out = f"{coefs[0]!r}::DOUBLE"
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def ppf_sql(u: str) -> str:
    """Standard normal quantile in SQL; ``u`` is a column."""
    p = f"greatest({u}, {2.0**-52!r}::DOUBLE)"
    q = f"({p} - 0.5::DOUBLE)"
    centre = f"{_poly_sql(H.PPF_A, f'({q}*{q})')} * {q} / ({_poly_sql(H.PPF_B, f'({q}*{q})')} * ({q}*{q}) + 1)"

    def tail(t: str) -> str:
        return f"{_poly_sql(H.PPF_C, t)} / ({_poly_sql(H.PPF_D, t)} * {t} + 1)"

    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"CASE WHEN {p} < {H.PPF_LOW} THEN {tail(lo)} WHEN {p} > 1 - {H.PPF_LOW} THEN -({tail(hi)}) ELSE {centre} END"


def ids_sql(table: str) -> str:
    return f"range((SELECT count(*) FROM {table})) AS r(id)"


def _count(df: DataFrame) -> int:
    return df.count()


def _u(column: str, table: str = "t"):
    return H.uniform(SEED, table, column, F.col("id"))


def _moments(df: DataFrame, col: str) -> dict:
    """Range and rounded moments, the same numbers the check query computes."""
    row = df.agg(
        F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"), F.round(F.avg(col), 4).alias("mean"),
        F.round(F.stddev_samp(col), 4).alias("stddev"),
    ).first()
    return row.asDict()


def moments_sql(table: str, col: str) -> str:
    return f"(SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi, round(avg({col}), 4) AS mean, round(stddev_samp({col}), 4) AS sd FROM {table}) AS m"


@R.add(
    "gen_integer",
    f"""SELECT id, round(greatest(lo, least(hi, mean + sd * ({ppf_sql('u')}))))::BIGINT AS normal, lo::BIGINT + floor(u * (hi - lo + 1))::BIGINT AS uniform
    FROM (SELECT id, {u_sql('q')} AS u FROM {ids_sql('lineitem')}), {moments_sql('lineitem', 'l_partkey')}""",
)
def gen_integer(spark, d):
    line = load(spark, d, "lineitem")
    m = _moments(line, "l_partkey")
    return spark.range(_count(line)).select("id", G.gen_integer(_u("q"), m).alias("normal"), G.gen_uniform_integer(_u("q"), m["min"], m["max"]).alias("uniform"))


@R.add(
    "gen_float",
    f"""SELECT id, round(greatest(lo, least(hi, mean + sd * ({ppf_sql('u')}))), 4) AS value
    FROM (SELECT id, {u_sql('price')} AS u FROM {ids_sql('orders')}), {moments_sql('orders', 'o_totalprice')}""",
)
def gen_float(spark, d):
    orders = load(spark, d, "orders")
    return spark.range(_count(orders)).select("id", G.gen_float(_u("price"), _moments(orders, "o_totalprice")).alias("value"))


def categories_sql(table: str, col: str) -> str:
    return f"""(SELECT {col} AS v, coalesce(sum(n) OVER (ORDER BY n DESC, {col} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS c0,
    sum(n) OVER (ORDER BY n DESC, {col})::DOUBLE AS c1, (sum(n) OVER ())::DOUBLE AS total FROM (SELECT {col}, count(*) AS n FROM {table} GROUP BY {col})) AS c"""


@R.add("gen_categorical", f"SELECT id, v AS value FROM (SELECT id, {u_sql('prio')} AS u FROM {ids_sql('orders')}) JOIN {categories_sql('orders', 'o_orderpriority')} ON u * total >= c0 AND u * total < c1")
def gen_categorical(spark, d):
    orders = load(spark, d, "orders")
    tops = [{"value": r["value"], "frequency": r["n"]} for r in P.top_values(orders, 20, ["o_orderpriority"]).orderBy("rank").collect()]
    return spark.range(_count(orders)).select("id", G.gen_categorical(_u("prio"), tops).alias("value"))


def letter_sql(column: str, i: int, alphabet: str) -> str:
    byte = f"('0x' || substr(md5('{SEED}|t|{column}#{i // 16}|' || id), {2 * (i % 16) + 1}, 2))::INT"
    return f"substr('{alphabet}', floor({byte} * {len(alphabet)} / 256.0::DOUBLE)::INT + 1, 1)"


UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
PLATE = [UPPER, UPPER, DIGITS, DIGITS, DIGITS, "-", DIGITS, DIGITS]


@R.add("gen_pattern", f"SELECT id, {' || '.join(letter_sql('plate', i, a) for i, a in enumerate(PLATE))} AS value FROM {ids_sql('customer')}")
def gen_pattern(spark, d):
    n = _count(load(spark, d, "customer"))
    return spark.range(n).select("id", G.gen_pattern(SEED, "t", "plate", F.col("id"), r"^[A-Z]{2}\d{3}-\d{2}(x\d)?$").alias("value"))


@R.add(
    "gen_string",
    f"""SELECT id, substr({' || '.join(letter_sql('name', i, G.ALPHANUMERIC) for i in range(18))}, 1, lo + floor({u_sql('name#len')} * (hi - lo + 1))::INT) AS value
    FROM {ids_sql('customer')}, (SELECT 4 AS lo, max(length(c_name)) AS hi FROM customer)""",
)
def gen_string(spark, d):
    customer = load(spark, d, "customer")
    longest = P.statistics(customer, ["c_name"], accuracy=0, distinct=False).first()["max_length"]
    return spark.range(_count(customer)).select("id", G.gen_string(SEED, "t", "name", F.col("id"), 4, longest).alias("value"))


DAYS_SQL = "(SELECT min(o_orderdate)::DATE AS first, datediff('day', min(o_orderdate), max(o_orderdate)) + 1 AS days FROM orders) AS s"


def _span(df: DataFrame) -> tuple[str, str]:
    row = df.agg(F.min("o_orderdate").cast("string").alias("lo"), F.max("o_orderdate").cast("string").alias("hi")).first()
    return row["lo"], row["hi"]


@R.add("gen_date", f"SELECT id, (first + floor({u_sql('day')} * days)::INT)::DATE AS value FROM {ids_sql('orders')}, {DAYS_SQL}")
def gen_date(spark, d):
    orders = load(spark, d, "orders")
    return spark.range(_count(orders)).select("id", G.gen_date(_u("day"), *_span(orders)).alias("value"))


@R.add(
    "gen_timestamp",
    f"SELECT id, (first + floor({u_sql('day')} * days)::INT)::TIMESTAMP + to_seconds(floor({u_sql('day#s')} * 86400)::BIGINT) AS value FROM {ids_sql('orders')}, {DAYS_SQL}",
)
def gen_timestamp(spark, d):
    orders = load(spark, d, "orders")
    value = G.gen_timestamp(_u("day"), _u("day#s"), *_span(orders)).cast("timestamp_ntz")
    return spark.range(_count(orders)).select("id", value.alias("value"))


@R.add("gen_boolean", f"SELECT id, {u_sql('flag')} < (SELECT round(avg((o_orderstatus = 'F')::INT), 6) FROM orders) AS value FROM {ids_sql('orders')}")
def gen_boolean(spark, d):
    orders = load(spark, d, "orders")
    share = orders.agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("p")).first()["p"]
    return spark.range(_count(orders)).select("id", G.gen_boolean(_u("flag"), share).alias("value"))


@R.add(
    "inject_nulls",
    "SELECT n AS rows, n - floor(n * (1 - 0.05::DOUBLE))::BIGINT AS nulls, n - (n - floor(n * (1 - 0.05::DOUBLE))::BIGINT) AS kept FROM (SELECT count(*) AS n FROM lineitem)",
)
def inject_nulls(spark, d):
    n = _count(load(spark, d, "lineitem"))
    made = spark.range(n).select(G.with_nulls(F.col("id"), F.col("id"), n, 0.05, 12345).alias("v"))
    return made.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_distinct("v").alias("kept"))


@R.add(
    "gen_primary_key",
    "SELECT o_orderkey - (SELECT min(o_orderkey) FROM orders) AS id, o_orderkey AS number, o_orderkey::VARCHAR AS text FROM orders",
)
def gen_primary_key(spark, d):
    orders = load(spark, d, "orders")
    first = orders.agg(F.min("o_orderkey").alias("m")).first()["m"]
    return spark.range(_count(orders)).select("id", G.gen_key(F.col("id"), "bigint", first).alias("number"), G.gen_key(F.col("id"), "varchar", first).alias("text"))


FK_SQL = f"""CASE WHEN {u_sql('o_custkey#orphan', 'orders')} < orphan THEN first + floor({u_sql('o_custkey', 'orders')} * parents)::BIGINT + parents
  ELSE first + floor({u_sql('o_custkey', 'orders')} * parents)::BIGINT END"""


def _parent(spark, d) -> tuple[TableSpec, int]:
    customer = load(spark, d, "customer")
    row = customer.agg(F.min("c_custkey").alias("lo"), F.count(F.lit(1)).alias("n")).first()
    key = ColumnSpec("c_custkey", "bigint", False, True, {"min": row["lo"]})
    return TableSpec("customer", [key], row["n"]), row["n"]


@R.add(
    "gen_foreign_key",
    f"""SELECT id, {FK_SQL} AS fk FROM {ids_sql('orders')}, (SELECT min(c_custkey) AS first, count(*) AS parents, 0.02::DOUBLE AS orphan FROM customer)""",
)
def gen_foreign_key(spark, d):
    parent, n = _parent(spark, d)
    fk = ForeignKey("o_custkey", "customer", "c_custkey", 0.02)
    rows = _count(load(spark, d, "orders"))
    return spark.range(rows).select("id", G.fk_value(fk, "orders", F.col("id"), parent, n, SEED).alias("fk"))


def _order_spec(spark, d) -> tuple[TableSpec, Blueprint]:
    orders = load(spark, d, "orders")
    parent, _ = _parent(spark, d)
    lo, hi = _span(orders)
    tops = [{"value": r["value"], "frequency": r["n"]} for r in P.top_values(orders, 20, ["o_orderstatus"]).orderBy("rank").collect()]
    total = sum(t["frequency"] for t in tops)
    status = {"top_values": [{"value": t["value"], "frequency": t["frequency"] / total} for t in tops], "distinct_count": len(tops)}
    cols = [
        ColumnSpec("o_orderkey", "bigint", False, True, {"min": orders.agg(F.min("o_orderkey").alias("m")).first()["m"]}),
        ColumnSpec("o_custkey", "bigint"),
        ColumnSpec("o_totalprice", "double", stats=_moments(orders, "o_totalprice")),
        ColumnSpec("o_orderdate", "date", stats={"min_value": lo, "max_value": hi}),
        ColumnSpec("o_orderstatus", "string", stats=status),
    ]
    spec = TableSpec("orders", cols, orders.count(), [ForeignKey("o_custkey", "customer", "c_custkey", 0.02)])
    return spec, Blueprint("bp", [spec, parent], "files")


@R.add(
    "generate_table",
    f"""SELECT okey + id AS o_orderkey, {FK_SQL} AS o_custkey,
    round(greatest(lo, least(hi, mean + sd * ({ppf_sql('up')}))), 4) AS o_totalprice, (s.first + floor({u_sql('o_orderdate', 'orders')} * days)::INT)::DATE AS o_orderdate
    FROM (SELECT id, {u_sql('o_totalprice', 'orders')} AS up FROM range((SELECT count(*) * 2 FROM orders)) AS r(id)), {moments_sql('orders', 'o_totalprice')}, {DAYS_SQL},
    (SELECT min(c_custkey) AS first, count(*) * 2 AS parents, 0.02::DOUBLE AS orphan FROM customer) AS p, (SELECT min(o_orderkey) AS okey FROM orders)""".replace("THEN first +", "THEN p.first +").replace("ELSE first +", "ELSE p.first +"),
)
def generate_table(spark, d):
    spec, bp = _order_spec(spark, d)
    return G.generate(spark, spec, 2.0, SEED, bp, cap=None).drop("o_orderstatus")


@R.add(
    "generate_schema",
    """SELECT 'customer' AS table_name, count(*) // 2 AS rows, 0::BIGINT AS orphans FROM customer UNION ALL SELECT 'orders', count(*) // 2, 0 FROM orders""",
)
def generate_schema(spark, d):
    spec, bp = _order_spec(spark, d)
    spec.foreign_keys[0].orphan_ratio = 0.0
    made = G.generate_all(spark, bp, 0.5, SEED, cap=None)
    keys = made["customer"].select(F.col("c_custkey").alias("o_custkey"))
    lost = made["orders"].join(keys, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows", (lost if n == "orders" else F.lit(0).cast("bigint")).alias("orphans"))
        for n, df in made.items()
    ]
    return rows[0].unionByName(rows[1])


@R.add(
    "generation_order",
    "SELECT 0 AS position, 'region' AS table_name, 0.0::DOUBLE AS orphan_ratio UNION ALL SELECT 1, 'nation', 0.0 UNION ALL SELECT 2, 'customer', 0.0 UNION ALL SELECT 3, 'orders', 0.0",
)
def generation_order(spark, d):
    chain = {"orders": ("o_custkey", "customer", "c_custkey"), "customer": ("c_nationkey", "nation", "n_nationkey"), "nation": ("n_regionkey", "region", "r_regionkey"), "region": None}
    tables = {t: load(spark, d, t) for t in chain}
    specs = [B.with_orphan_ratios(TableSpec(t, [], 0, [ForeignKey(*fk)] if fk else []), tables) for t, fk in chain.items()]
    bp = Blueprint("bp", specs)
    rows = [(i, n, max([fk.orphan_ratio for fk in bp.table(n).foreign_keys], default=0.0)) for i, n in enumerate(G.generation_order(bp))]
    return spark.createDataFrame(rows, "position int, table_name string, orphan_ratio double")


QUANTILE_SQL = """(SELECT min(v) AS v0, max(v) FILTER (r = ceil(0.25 * n)) AS v1, max(v) FILTER (r = ceil(0.5 * n)) AS v2, max(v) FILTER (r = ceil(0.75 * n)) AS v3,
  max(v) FILTER (r = ceil(0.95 * n)) AS v4, max(v) FILTER (r = ceil(0.99 * n)) AS v5, max(v) AS v6
  FROM (SELECT value AS v, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events)) AS q"""


@R.add(
    "bootstrap_rows",
    f"""SELECT id, round(CASE WHEN u < 0.25 THEN v0 + u * ((v1 - v0) / 0.25::DOUBLE) WHEN u < 0.5 THEN v1 + (u - 0.25::DOUBLE) * ((v2 - v1) / (0.5::DOUBLE - 0.25::DOUBLE))
    WHEN u < 0.75 THEN v2 + (u - 0.5::DOUBLE) * ((v3 - v2) / (0.75::DOUBLE - 0.5::DOUBLE)) WHEN u < 0.95 THEN v3 + (u - 0.75::DOUBLE) * ((v4 - v3) / (0.95::DOUBLE - 0.75::DOUBLE))
    WHEN u < 0.99 THEN v4 + (u - 0.95::DOUBLE) * ((v5 - v4) / (0.99::DOUBLE - 0.95::DOUBLE)) ELSE v5 + (u - 0.99::DOUBLE) * ((v6 - v5) / (1::DOUBLE - 0.99::DOUBLE)) END, 4) AS value
    FROM (SELECT id, {u_sql('boot')} AS u FROM {ids_sql('events')}), {QUANTILE_SQL}""",
)
def bootstrap_rows(spark, d):
    events = load(spark, d, "events")
    stats = {f"p{round(r['probability'] * 100)}": r["value"] for r in P.exact_percentiles(events, ["value"]).collect()}
    stats.update(events.agg(F.min("value").alias("min"), F.max("value").alias("max")).first().asDict())
    return spark.range(_count(events)).select("id", G.gen_quantile(_u("boot"), G.quantile_points(stats)).alias("value"))
