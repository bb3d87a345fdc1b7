"""Inputs on which rows, columns or values could get lost."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregate as A
from millrace.operators import graph as GR
from millrace.operators import text as X
from millrace.operators import windows as W
from millrace.plans import blueprint as B
from millrace.plans import generate as G
from millrace.plans import profile as P
from millrace.plans import quality as Q
from millrace.plans import validate as V
from millrace.queries.base import Registry
from millrace.runtime import load, scratch_path, storage_root
from millrace.sources import changes as C
from millrace.sources import files
from millrace.spec import ColumnSpec, TableSpec


def test_iterate_does_not_stop_unfinished(spark):
    start = spark.createDataFrame([(130,)], "v int")
    step = lambda df: df.selectExpr("v - 1 AS v").filter("v > 0")
    with pytest.raises(GR.NotConverged):
        GR.iterate(start, step, max_rounds=8)
    assert GR.iterate(start.selectExpr("v - 122 AS v"), step, max_rounds=8).count() == 8


def test_rolling_keeps_rows_without_a_time(spark):
    rows = spark.range(100).selectExpr("id", "id % 3 AS k", "CASE WHEN id % 4 > 0 THEN timestamp_seconds(id * 60) END AS ts", "id * 1.0D AS v")
    out = W.rolling(rows, ["k"], "ts", 600, {"n": F.count(F.lit(1))})
    assert out.count() == 100
    assert {r.n for r in out.filter("ts is null and k = 0").collect()} == {rows.filter("ts is null and k = 0").count()}


def test_nested_columns_are_profiled(spark, sf):
    got = {r.column_name: r for r in P.profile(load(spark, sf, "embeddings")).collect()}
    assert set(got) == {"vec_id", "embedding", "label"} and got["embedding"].non_null_count == 500 and got["embedding"].top_values is None
    maps = spark.createDataFrame([({"a": 1}, None)], "m map<string,int>, b binary")
    assert {r.column_name: r.null_ratio for r in P.profile(maps, exact=True).collect()} == {"m": 0.0, "b": 1.0}


def test_the_whole_domain_is_generated(spark):
    source = spark.range(1000).selectExpr("concat('v', least(id % 400, 24)) AS c")
    spec = B.to_table_spec("t", P.profile(source, domain=G.CATEGORICAL_LIMIT))
    made = {r.c for r in G.generate(spark, spec, 20.0).distinct().collect()}
    assert made == {f"v{k}" for k in range(25)}


def test_long_texts_are_generated_with_a_small_plan(spark):
    spec = TableSpec("t", [ColumnSpec("c", "string", False, False, {"min_length": 15_000, "max_length": 20_000})], 50)
    made = G.generate(spark, spec)
    assert len(made._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    sizes = [len(r.c) for r in made.collect()]
    assert len(sizes) == 50 and min(sizes) >= 15_000 and max(sizes) <= 20_000


def test_rows_beyond_a_limit_are_an_error(spark):
    spec = TableSpec("t", [ColumnSpec("c", "int", False, False, {})], 20_000_000)
    assert G.rows_of(spec, 1.0) == 20_000_000
    with pytest.raises(G.TooManyRows):
        G.generate(spark, spec, cap=10_000_000)


def test_upsert_takes_one_update_for_a_key(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "k int, v string, s int")
    assert {(r.k, r.v) for r in C.upsert(target, updates, ["k"], ["s"]).collect()} == {(1, "y"), (2, "b"), (3, "z")}
    with pytest.raises(Exception, match="several updates"):
        C.upsert(target, updates.drop("s"), ["k"]).collect()


def test_values_with_backslashes_and_quotes(spark):
    rows = spark.createDataFrame([("x\\",), ("o'k",), ("other",)], "c string")
    rule = Q.in_set("c", ["x\\", "o'k"])
    assert rows.filter(F.expr(rule.expression)).count() == 2
    assert A.string_agg(rows.withColumn("g", F.lit(1)), ["g"], "c", "\\").first()["joined"].count("\\") == 3


def test_mixed_folders_are_an_error(spark):
    path = scratch_path(spark, "mixed")
    spark.range(3).write.parquet(path)
    assert files.detect_format(spark, path) == "parquet"
    spark.range(3).write.mode("append").json(path)
    with pytest.raises(files.MixedFormats):
        files.detect_format(spark, path)


def test_unmeasured_quality_counts_as_one(spark):
    dims = spark.createDataFrame([("t", None, None, None, None)], "table_name string, schema_score double, fidelity_score double, violations long, layers_ok boolean")
    assert V.score_tables(dims).first()["overall_score"] == 1.0


def test_wide_ddl(spark):
    body = ",\n".join(f"  c{k} DECIMAL(10, {k % 5}) DEFAULT {k}" for k in range(800))
    ddl = f"CREATE TABLE IF NOT EXISTS [dbo].[wide] (\n  id INT IDENTITY(1,1),\n{body},\n  role ENUM('a','b') UNIQUE);\nALTER TABLE [dbo].[wide] ADD CONSTRAINT p PRIMARY KEY (id);\nALTER TABLE dbo.wide WITH CHECK ADD FOREIGN KEY (c7) REFERENCES other(id)"
    got = {r.column_name: r for r in B.ddl_inventory(spark.createDataFrame([("f", ddl)], "file string, value string")).collect()}
    assert len(got) == 802 and got["id"].is_primary_key and not got["id"].nullable and got["role"].is_unique and got["role"].check_values == ["a", "b"]
    assert (got["c7"].fk_table, got["c7"].fk_column, got["c7"].num_precision, got["c7"].num_scale, got["c7"].default_value) == ("other", "id", 10, 2, "7")


def test_ddl_columns_are_not_shuffled(spark, capsys):
    rows = [("f", "CREATE TABLE t (id INT, b INT, not null, unique INT, x BIGSERIAL, y INT IDENTITY, z INT NOT NULL, \n , v  DECIMAL ( 9 , 2 ));"), ("f", "ALTER TABLE t ADD PRIMARY KEY (id); ALTER TABLE t ADD UNIQUE (b);"),
            ("f", "CREATE TABLE t (id INT REFERENCES own (o), c INT, FOREIGN KEY (c) REFERENCES p (q))"), ("g", "CREATE TABLE t (id INT, b INT)"),
            (None, "CREATE TABLE t (id INT, PRIMARY KEY (id))"), ("h", None), ("i", "ALTER TABLE t ADD FOREIGN KEY (b) REFERENCES s (a)")]
    out = B.ddl_inventory(spark.createDataFrame(rows, "file string, value string"))
    out.explain()
    plan = capsys.readouterr().out
    # one join, of statements with the keys of their tables, before any column stands in a row of its own
    assert plan.count("Join") == 1 and plan.index("Generate posexplode") < plan.index("Join")
    got = {(r.file, r.column_name, r.position): (r.data_type, r.nullable, r.is_primary_key, r.is_unique, r.fk_table, r.fk_column) for r in out.collect()}
    assert got == {
        ("f", "id", 0): ("int", False, True, False, got["f", "id", 0][4], got["f", "id", 0][5]), ("f", "b", 1): ("int", True, False, True, None, None), ("f", "not", 2): ("null", False, False, False, None, None),
        ("f", "x", 4): (got["f", "x", 4][0], False, False, False, None, None), ("f", "y", 5): ("int", False, False, False, None, None), ("f", "z", 6): ("int", False, False, False, None, None),
        ("f", "v", 8): ("decimal", True, False, False, None, None), ("f", "c", 1): ("int", True, False, False, "p", "q"), ("g", "id", 0): ("int", True, False, False, None, None),
        ("g", "b", 1): ("int", True, False, False, None, None), (None, "id", 0): ("int", True, False, False, None, None),
    }


def test_ddl_keys_of_a_text_are_found_in_it(spark, capsys, monkeypatch):
    one = "CREATE TABLE t (\n  id INT ,\n  a\tDECIMAL( 9,\n 2 ) DEFAULT 1,, \n,  b INT,\n PRIMARY  KEY (id), UNIQUE (a)\n);\nALTER TABLE t ADD FOREIGN KEY (b) REFERENCES z (k); ALTER TABLE t ADD FOREIGN KEY (b) REFERENCES p (q);"
    key = {"id": ("int", None, None, True, False, None), "a": ("decimal", 9, 2, False, True, None), "b": ("int", None, None, False, False, "p")}
    want = {("t", c, at, *key[c]) for c, at in (("id", 0), ("a", 1), ("b", 3))}
    # further tables in the text: a column of the same name with no key, a table made twice
    more = one + "CREATE TABLE u (id INT); CREATE TABLE t (b INT, UNIQUE (b))"
    key["b"] = ("int", None, None, False, True, "p")
    both = {("t", c, at, *key[c]) for c, at in (("id", 0), ("a", 1), ("b", 3), ("b", 0))} | {("u", "id", 0, "int", None, None, False, False, None)}
    row = lambda r: (r.table_name, r.column_name, r.position, r.data_type, r.max_len, r.num_scale, r.is_primary_key, r.is_unique, r.fk_table)
    for most in (1 << 16, 1):  # a text may be long
        monkeypatch.setattr(B, "OWN_BYTES", most)
        out = B.ddl_inventory(spark.createDataFrame([("f", one), ("g", more)], "file string, value string"))
        out.explain()
        # texts of their own are neither shuffled nor joined
        assert capsys.readouterr().out.count("Join") == (most == 1)
        rows = out.collect()
        assert {row(r) for r in rows if r.file == "f"} == want and {row(r) for r in rows if r.file == "g"} == both and len(rows) == 8


STATEMENTS = [
    ("INSERT OVERWRITE TABLE x SELECT extract(year FROM d) y, count(*) FROM t, u z JOIN (SELECT q.k FROM deep q WHERE s = 'FROM nowhere') w ON t.a = w.k -- FROM c", {("x", "write"), ("t", "read"), ("u", "read"), ("deep", "read")}, {"y", "k"}),
    ("WITH a AS (SELECT 1 one FROM base), b(c) AS (SELECT x FROM a) SELECT b.c, coalesce(a, b) AS c2, d + e, d * e f FROM b, series(1, 2) g", {("base", "read")}, {"one", "x", "c", "c2", "f"}),
    ("MERGE INTO tgt t USING src s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = s.a", {("tgt", "write"), ("src", "read")}, set()),
    ('DELETE FROM old WHERE k = 1; UPDATE `db`."Cur" SET a = 1 FROM other', {("old", "write"), ("db.Cur", "write"), ("other", "read")}, set()),
    ("CREATE TABLE IF NOT EXISTS made AS SELECT DISTINCT m, n FROM ${src} FOR UPDATE", {("made", "write"), ("${src}", "read")}, {"m", "n"}),
    ("", set(), set()),
    (None, set(), set()),
]


def test_lineage_and_columns_of_statements(spark):
    df = spark.createDataFrame([(k, s) for k, (s, _, _) in enumerate(STATEMENTS)], "id int, sql string")
    tables, columns = X.sql_lineage(df, "id", "sql").collect(), X.sql_columns(df, "id", "sql").collect()
    for k, (_, want, names) in enumerate(STATEMENTS):
        assert {(r.table_name, r.role) for r in tables if r.id == k} == want
        assert {r.column_name for r in columns if r.id == k} == names


def test_links_in_every_form(spark):
    html = """<a href="x">1</a><A class=k HREF='y z'>2</A><a data-href="no" href = bare>3</a><a\nhref=u/v?w=1>4</a><p href="no">"""
    assert X.html_fields(spark.createDataFrame([(html,)], "h string"), "h").first()["links"] == ["x", "y z", "bare", "u/v?w=1"]


def test_no_local_scratch_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        storage_root(Session())
    Context.master = "local[4]"
    assert storage_root(Session()) == storage_root(Session())


def test_registry_keeps_check_sql():
    r = Registry()
    r.add("a", " SELECT 1 ")(lambda s, d: None)
    assert r.sql == {"a": "SELECT 1"}


@pytest.mark.parametrize("buckets", [8, 1024])
def test_frequent_values_without_all_counts(spark, monkeypatch, buckets):
    """Skewed, even, unique, constant, empty and signed-zero columns: the same rows as from the counts of all values."""
    monkeypatch.setattr(P, "BUCKETS", buckets)
    df = spark.range(6000).selectExpr(
        "id AS unique_", "CAST(pow(2, id % 13) * 10 AS INT) + id % 7 AS mixed", "CAST(sqrt(id) AS INT) AS steps", "id % 400 AS even",
        "'x' AS one", "CAST(NULL AS STRING) AS none", "IF(id % 3 = 0, 0D, IF(id % 3 = 1, -0D, CAST(id AS DOUBLE))) AS zeros",
        "IF(id % 5 = 0, NULL, repeat(char(97 + CAST(id % 40 AS INT)), CAST(250 + id % 11 AS INT))) AS long_", "id % 2 = 0 AS flag",
        "date_add(DATE '2024-01-01', CAST(id % 90 AS INT)) AS day", "CAST(id % 33 AS DECIMAL(8, 2)) AS amount",
    )
    rows = lambda x: sorted(map(tuple, x.select("column_name", "rank", "value", "is_long", "n").collect()))
    for k in (1, 7):
        assert rows(P.frequent(df, df.columns, k)) == rows(P.top_of(P.value_counts(df), k))
    assert P.frequent(df.limit(0), df.columns, 3).count() == 0
