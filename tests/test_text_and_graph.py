"""Text operators, attribute functions, graphs, sources and streams on small fixtures."""

import itertools
import os
import random
import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import attr as fn
from millrace.functions.attr import attr
from millrace.functions.grok import expand
from millrace.operators import graph as G
from millrace.operators import joins as J
from millrace.operators import similar
from millrace.operators import text as X
from millrace.operators import windows as W
from millrace.plans.quality import Rule
from millrace.runtime import storage_root
from millrace.sources import files, jdbc, kafka
from millrace.spec import TableSpec
from millrace.streaming import streams as S


def value(spark, text, a):
    return spark.createDataFrame([(text,)], "x string").select(a.col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "a", "want"),
    [
        ("hello", lambda: attr("x").substring(1, 3), "el"),
        ("a.b.c", lambda: attr("x").replace(".", "-"), "a-b-c"),
        ("a1b2", lambda: attr("x").replace_first(r"\d", "#"), "a#b2"),
        ("ab12cd", lambda: attr("x").replace_first(r"(\d)(\d)", "$2$1"), "ab21cd"),
        ("a-b-c", lambda: attr("x").substring_after("-"), "b-c"),
        ("a-b-c", lambda: attr("x").substring_after_last("-"), "c"),
        ("a-b-c", lambda: attr("x").substring_before_last("-"), "a-b"),
        ("abc", lambda: attr("x").substring_after("-"), ""),
        ("abc", lambda: attr("x").substring_before("-"), "abc"),
        ("abc", lambda: attr("x").index_of("z"), -1),
        ("abcdef", lambda: attr("x").pad_left(3, "0"), "abcdef"),
        ("7", lambda: attr("x").pad_left(3, "0"), "007"),
        ("x", lambda: attr("x").to_number(), 0.0),
        ("-7", lambda: attr("x").divide(2), -4),
        ("a,b", lambda: attr("x").get_delimited_field(3), ""),
        ("a b&c", lambda: attr("x").url_encode(), "a%20b%26c"),
        ("a%20b+c", lambda: attr("x").url_decode(), "a b+c"),
        ('say "hi"\n', lambda: attr("x").escape_json(), 'say \\"hi\\"\\n'),
        (None, lambda: attr("x").is_empty(), True),
        (None, lambda: attr("x").equals("a"), False),
        ("12", lambda: fn.math("value * 2 + 1", "x"), 25.0),
    ],
)
def test_attribute_functions(spark, text, a, want):
    assert value(spark, text, a()) == want


def test_config_names_are_not_columns():
    assert fn.is_column_name("filename") and not fn.is_column_name("db.password")
    assert [fn.variable_context(n) for n in ("kafka.topic", "sink.path", "API_KEY", "uuid")] == ["config", "config", "secret", "column"]


def test_grok_expansion():
    regex, fields = expand("%{IP:client} %{WORD:verb} %{GREEDYDATA:rest}")
    assert fields == ["client", "verb", "rest"] and "?<" not in regex


def test_cef_escapes_and_hl7_repeats(spark):
    cef = spark.createDataFrame([(r"CEF:0|a\|b|p|1|9|n|5|k=v x=1 2 y=z",), ("no",)], "t string")
    rows = X.parse_cef(cef, "t").collect()
    assert rows[0]["cef_vendor"] == "a|b" and rows[0]["cef_extension"] == {"k": "v", "x": "1 2", "y": "z"} and rows[1]["cef_vendor"] is None
    hl7 = spark.createDataFrame([("ZA1|1\nZA1|2\nOBX|1|NM|GLU||9",)], "t string")
    assert X.parse_hl7(hl7, "t").first()["hl7"] == {"ZA1": "2", "obx_GLU": "9"}


def test_weblog(spark):
    line = '10.0.0.1 - bob [10/Oct/2023:13:55:36 +0000] "GET /a.html HTTP/1.1" 200 - "http://r/" "Mozilla/5.0 (X11)"'
    row = X.parse_weblog(spark.createDataFrame([(line,)], "t string"), "t").first()
    assert (row["client"], row["user"], row["method"], row["request"], row["status"], row["size"]) == ("10.0.0.1", "bob", "GET", "/a.html", 200, None)
    assert row["time"] == datetime(2023, 10, 10, 13, 55, 36)


def test_html_element(spark):
    page = spark.createDataFrame([('<body><p class="x y">one <b>two</b></p><p id="q">three</p></body>',)], "h string")
    for selector, want in {"p.y": "one two", "p#q": "three", ".x": "one two", "p": "one two", "table": None}.items():
        assert X.html_element(page, "h", selector).first()["_html_result"] == want


def test_ip_ranges(spark):
    ips = spark.createDataFrame([("10.0.0.5",), ("10.0.0.5",), ("10.1.2.3",), ("11.0.0.1",), ("bad",), ("255.255.255.255",)], "ip string")
    ips = ips.withColumn("a", J.ipv4_to_long(F.col("ip")))
    base = 10 * 2**24
    ranges = spark.createDataFrame([(base, base + 200000, "x"), (base + 200001, base + 200005, "y"), (11 * 2**24 + 1, 11 * 2**24 + 1, "z")], "lo long, hi long, c string")
    got = sorted((r["ip"], r["c"]) for r in J.range_enrich(ips, ranges, "a", "lo", "hi", ["c"]).collect())
    assert got == sorted([("10.0.0.5", "x"), ("10.0.0.5", "x"), ("10.1.2.3", "x"), ("11.0.0.1", "z"), ("bad", None), ("255.255.255.255", None)])


def test_lookup_rejects_repeated_keys(spark):
    df, dim = spark.range(3), spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(Exception, match="lookup key is not unique"):
        J.lookup(df, dim, ["id"], ["v"]).collect()
    assert J.lookup(df, dim, ["id"], ["v"], check_unique=False).count() == 4


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def hops(df):
    return {r["node"]: r["hops"] for r in df.collect()}


def test_paths(spark):
    diamond = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y"))
    assert hops(G.shortest_hops(diamond, "a")) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert G.closure(diamond).count() == 4 + 2 + 2 + 1 + 1
    with pytest.raises(G.NotConverged):
        G.closure(diamond, max_rounds=1)


def test_cycles_and_levels(spark):
    e = edges(spark, ("s", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "t"), ("p", "q"), ("z", "z"))
    assert {(r["node"], r["component"]) for r in G.cycles(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    nodes = spark.createDataFrame([(x,) for x in "sabctpqi"], "id string")
    levels = {r["id"]: r["level"] for r in G.levels(nodes, e).collect()}
    assert levels == {"s": 0, "p": 0, "i": 0, "q": 1, "a": None, "b": None, "c": None, "t": None}


def test_no_cycle_gives_no_rows(spark):
    assert G.cycles(edges(spark, ("a", "b"), ("b", "c"))).isEmpty()


def test_barrier(spark):
    nodes = spark.createDataFrame([("s", "Listen"), ("a", "Work"), ("m", "Merge"), ("b", "Work"), ("c", "Work")], "id string, type string")
    e = edges(spark, ("s", "a"), ("a", "m"), ("m", "b"), ("a", "c"))
    out = G.propagate(nodes, e, F.col("type") == "Listen", F.col("type") == "Merge")
    assert {r["id"] for r in out.collect()} == {"s", "a", "c"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\nbad,y\n3\n")
    good, bad = files.read_permissive(spark, str(tmp_path / "a.csv"), "id int, name string")
    assert good.count() == 1 and bad.select("_corrupt_record").count() == 2
    (tmp_path / "noext").write_text('{"a": 1}\n')
    assert files.detect_format(spark, str(tmp_path / "noext")) == "json"
    (tmp_path / "x.xml").write_text("<r><e><id>1</id></e><e><id>2</id></e></r>")
    assert files.read_any(spark, str(tmp_path / "x.xml"), "id int", rowTag="e").count() == 2
    assert files.list_files(spark, str(tmp_path), "*.csv").first()["name"] == "a.csv"


def test_jdbc_options_and_kafka_options():
    assert jdbc.driver_for("jdbc:postgresql://h/db") == "org.postgresql.Driver" and jdbc.driver_for("my pool") is None
    opts = kafka.kafka_options("h:1", "t", "g", sasl={"security.protocol": "SASL_SSL"})
    assert opts["maxOffsetsPerTrigger"] == "10000" and opts["kafka.security.protocol"] == "SASL_SSL" and opts["subscribe"] == "t"


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    feed, sink, ckpt = (str(tmp_path / n) for n in ("feed", "sink", "ckpt"))
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(feed)
        S.run_available_now(S.stream_files(spark, feed, "id long"), sink, ckpt)
    assert spark.read.parquet(sink).count() == 30


def test_changes_arriving_in_several_batches(spark, tmp_path):
    feed, sink, ckpt = (str(tmp_path / n) for n in ("feed", "sink", "ckpt"))
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    schema = "k int, v string, op string, seq int"
    for batch in ([(1, "x", "update", 5), (2, None, "delete", 6)], [(1, "old", "update", 4), (2, "again", "insert", 7), (3, None, "delete", 8)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(feed)
        S.apply_changes_stream(S.stream_files(spark, feed, spark.createDataFrame([], schema).schema), ["k"], ["seq"], sink, ckpt)
    got = {(r["k"], r["v"]) for r in S.current_table(target, sink, ["k"], ["seq"], "op").collect()}
    assert got == {(1, "x"), (2, "again")}


def test_stream_windows_drop_late_rows(spark, tmp_path):
    feed = str(tmp_path / "feed")
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")
    schema = spark.createDataFrame([], "ts timestamp, v double").schema
    batches = [["2024-01-01 00:01", "2024-01-01 01:30"], ["2024-01-01 00:02", "2024-01-01 03:00"], ["2024-01-01 09:00"]]
    for batch in batches:
        spark.createDataFrame([(datetime.fromisoformat(t), 1.0) for t in batch], schema).coalesce(1).write.mode("append").parquet(feed)
        out = W.tumbling(S.stream_files(spark, feed, schema), "ts", "1 hour", {"n": F.count(F.lit(1))}, watermark="10 minutes")
        S.run_available_now(out, sink, ckpt)
    assert {r["window_start"].hour: r["n"] for r in spark.read.parquet(sink).collect()} == {0: 1, 1: 1, 3: 1}


def test_dedup_on_a_stream(spark, tmp_path):
    feed, sink, ckpt = (str(tmp_path / n) for n in ("feed", "sink", "ckpt"))
    schema = spark.createDataFrame([], "ts timestamp, k int").schema
    for _ in range(2):
        spark.createDataFrame([(datetime(2024, 1, 1, 0, m), m % 3) for m in range(6)], schema).write.mode("append").parquet(feed)
        S.run_available_now(S.dedup_stream(S.stream_files(spark, feed, schema), ["k"], "ts", "1 hour"), sink, ckpt)
    assert spark.read.parquet(sink).count() == 3


def test_gate_holds_until_signals_arrive(spark, tmp_path):
    feed, signals, sink, ckpt = (str(tmp_path / n) for n in ("feed", "signals", "sink", "ckpt"))
    row = spark.createDataFrame([(1, "go")], "id int, key string")
    sig = spark.createDataFrame([("go",)], "name string")
    row.write.parquet(feed)
    sig.write.parquet(signals)
    for step in range(2):
        S.gate_stream(S.stream_files(spark, feed, row.schema), signals, "key", "name", 2, sink, ckpt)
        out = spark.read.schema("id int, key string").parquet(sink).count()
        assert out == (0 if step == 0 else 2)
        sig.write.mode("append").parquet(signals)
        row.write.mode("append").parquet(feed)


@pytest.mark.parametrize("consume", [False, True])
def test_gate_with_late_repeated_and_expired(spark, tmp_path, monkeypatch, consume):
    """Against a plain replay of the batches, with folds and failed batches on the way."""
    monkeypatch.setattr(S, "FOLD_EVERY", 2)
    feed, signals, sink, ckpt = (str(tmp_path / n) for n in ("feed", "signals", "sink", "ckpt"))
    row, sig = (spark.createDataFrame([], t).schema for t in ("id int, k string, t timestamp", "name string"))
    at = lambda d: datetime(2024, 1, d)
    batches = [
        ([(1, "a", at(1)), (2, "b", at(1)), (3, None, at(1)), (4, "c", None)], ["a", None]),
        ([(5, "a", at(2))], ["a", "a", "z"]),
        ([(6, "a", at(6)), (7, "d", at(1)), (8, "c", at(2))], []),
        ([(9, "d", at(6))], ["b", "b", "c", "a"]),
        ([(10, "b", at(7)), (11, "z", at(7))], ["c", "z", "d", "d", "d", "d"]),
        ([(12, "d", at(7)), (13, "e", at(3)), (14, "c", at(20))], ["d"]),
        ([(15, "e", at(20))], ["e", "e"]),
    ]
    held, counts, bound, out, gone = [], Counter(), None, [], []
    for rows, names in batches:
        old = counts.copy()
        counts.update(n for n in names if n is not None)
        level = lambda c, k: c[k] // 2 if consume else int(c[k] >= 2)
        over = lambda t: bound is not None and t is not None and (bound - t).days >= 3  # noqa: E731, B023
        here = [(*r, level(old, r[1]) if consume else 0) for r in rows]
        gone += [r[0] for r in held + here if over(r[2])]
        live = [r for r in held + here if not over(r[2])]
        out += [r[0] for r in live if level(counts, r[1]) > r[3]]
        held = [r for r in live if level(counts, r[1]) <= r[3]]
        bound = max([r[2] for r in rows if r[2]] + ([bound] if bound else []))
    folder = S.batch_folder
    for step, (rows, names) in enumerate(batches):
        spark.createDataFrame(rows, row).coalesce(1).write.mode("append").parquet(feed)
        spark.createDataFrame([(n,) for n in names], sig).coalesce(1).write.mode("append").parquet(signals)
        run = lambda: S.gate_stream(S.stream_files(spark, feed, row), signals, "k", "name", 2, sink, ckpt, consume, "t", "3 days")
        if step in (3, 5):

            def lost(path, batch_id):
                if path.endswith("-seen") and batch_id == step:  # noqa: B023
                    raise OSError("lost")
                return folder(path, batch_id)

            monkeypatch.setattr(S, "batch_folder", lost)
            with pytest.raises(Exception, match="lost"):
                run()
            monkeypatch.setattr(S, "batch_folder", folder)
        run()
    ids = lambda path: sorted(r["id"] for r in spark.read.parquet(path).collect())
    assert ids(sink) == sorted(out) and ids(f"{sink}-expired") == sorted(gone)
    assert out and gone and (tmp_path / "sink-waiting-fold").exists()


def test_throttle_over_batches_with_expiry(spark, tmp_path):
    feed, sink, ckpt = (str(tmp_path / n) for n in ("feed", "sink", "ckpt"))
    schema = spark.createDataFrame([], "id int, k string, ts timestamp").schema
    at = lambda d, h: datetime(2024, 1, d, h)
    batches = [
        [(1, "a", at(1, 1)), (2, "a", at(1, 2)), (3, "a", at(1, 3)), (4, None, at(1, 4)), (5, "b", None)],
        [(6, "a", at(1, 5)), (7, "b", at(1, 6)), (8, None, at(1, 7)), (9, None, at(1, 8)), (10, "a", at(3, 1))],
        [(11, "b", at(1, 9)), (12, "a", at(3, 2)), (13, "a", at(3, 3)), (14, "b", at(2, 23))],
        [],
        [(15, "a", at(3, 4)), (16, "b", at(2, 1)), (17, "b", at(2, 2)), (18, "c", at(9, 1))],
        [(19, "a", at(3, 5)), (20, "c", at(9, 2)), (21, "c", at(9, 3))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        S.throttled(S.stream_files(spark, feed, schema), ["k"], "ts", "1 day", 2, ["ts", "id"], sink, ckpt, "1 day")
    went = {r["id"] for r in spark.read.parquet(sink).collect()}
    late = {r["id"] for r in spark.read.parquet(f"{sink}-late").collect()}
    # the greatest time is 3 January, 1 h, after two batches: the first day ended before 2 January, 1 h
    assert went == {1, 2, 4, 7, 8, 10, 12, 14, 16, 18, 20} and late == {11, 19}
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "sink-used").iterdir() if p.name.startswith("batch_id="))
    state = spark.read.parquet(f"{sink}-used/batch_id={last}")
    assert [(r["k"], r["__n"]) for r in state.collect()] == [("c", 2)]


def test_change_log_folds(spark, tmp_path, monkeypatch):
    feed, sink, ckpt = (str(tmp_path / n) for n in ("feed", "sink", "ckpt"))
    schema = spark.createDataFrame([], "k int, v string, op string, seq int").schema
    target = spark.createDataFrame([(1, "old"), (2, "old"), (9, "old")], "k int, v string")
    batches = [[(1, "a", "update", 5), (2, None, "delete", 7)], [(1, "b", "update", 4), (3, "c", "insert", 1)], [(2, "late", "update", 6), (3, "d", "update", 2)], [(4, "e", "insert", 1)], [(3, None, "delete", 3)]]
    want = [{(1, "a"), (9, "old")}, {(1, "a"), (9, "old"), (3, "c")}, {(1, "a"), (9, "old"), (3, "d")}, {(1, "a"), (9, "old"), (3, "d"), (4, "e")}, {(1, "a"), (9, "old"), (4, "e")}]
    table = lambda: {(r["k"], r["v"]) for r in S.current_table(target, sink, ["k"], ["seq"], "op").collect()}
    switch = S._switch
    for step, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        S.apply_changes_stream(S.stream_files(spark, feed, schema), ["k"], ["seq"], sink, ckpt)
        assert table() == want[step]
        if step in (2, 4):  # written, but never switched to

            def lost(*_):
                raise OSError("lost")

            monkeypatch.setattr(S, "_switch", lost)
            with pytest.raises(OSError):
                S.fold_changes(spark, sink, ["k"], ["seq"])
            assert table() == want[step]
            monkeypatch.setattr(S, "_switch", switch)
        S.fold_changes(spark, sink, ["k"], ["seq"])
        S.fold_changes(spark, sink, ["k"], ["seq"])
        assert table() == want[step]
    read = S.stored_changes(spark, sink).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("/")[-2] for r in read} == {"version=4", "batch_id=4"}


def test_unique_rules_hold_over_the_whole_stream(spark, tmp_path, monkeypatch):
    feed, root, ckpt = (str(tmp_path / n) for n in ("feed", "root", "ckpt"))
    schema = spark.createDataFrame([], "id int, k int, m string, v int").schema
    batches = [
        [(1, 1, "a", 1), (2, 1, "b", 1), (3, 2, "c", -1), (4, None, "d", 1)],
        [(5, 2, "a", 1), (6, 2, "e", 1), (7, None, "f", 1), (8, 1, "g", 1), (9, 9, "h", 1), (10, 9, "h", 1)],
        [],
        [(11, 9, "i", 1), (12, 3, "h", 1), (13, 4, "j", 1), (14, 4, "j", -1)],
        [(15, 3, "k", 1), (16, 3, "l", 1), (17, 5, "m", 1), (18, 4, "n", 1)],
    ]
    rules = [Rule("m_once", action="warn", keys=("m",)), Rule("k_once", action="drop", keys=("k",)), Rule("positive", "v > 0", "drop")]
    silver, held, keys, warned = set(), {}, set(), set()
    for n, k, m, v in (r for b in batches for r in b):
        names = [] if v > 0 else ["positive"]
        if v > 0:
            names += ["m_once"] * (m in warned) + ["k_once"] * (k in keys)
            silver |= set() if k in keys else {n}
            warned.add(m)
            keys.add(k)
        if names:
            held[n] = names
    monkeypatch.setattr(S, "FOLD_EVERY", 2)
    folder = S.batch_folder
    for step, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        run = lambda: S.stream_layers(S.stream_files(spark, feed, schema), TableSpec("t", []), rules, root, "feed", ckpt, ["id"])
        if step in (1, 3):  # fails after silver and keys are written, and runs again

            def lost(sink, batch_id):
                if sink.endswith("gold"):
                    raise OSError("lost")
                return folder(sink, batch_id)

            monkeypatch.setattr(S, "batch_folder", lost)
            with pytest.raises(Exception, match="lost"):
                run()
            monkeypatch.setattr(S, "batch_folder", folder)
        run()
    gold = [r["id"] for r in spark.read.parquet(f"{root}/gold").collect()]
    got = {r["id"]: r["_failed_rules"] for r in spark.read.parquet(f"{root}/quarantine").collect()}
    assert sorted(gold) == sorted(silver) and got == held
    assert (tmp_path / "root" / "keys" / "k_once-fold").exists()


def _plain_parts(n, pairs):
    """Node -> smallest node of its cyclic part, and node -> level, by following all paths."""
    after = {v: {b for a, b in pairs if a == v and b != v} for v in range(n)}
    reach = {v: set(after[v]) for v in range(n)}
    for _ in range(n):
        for v in range(n):
            reach[v] |= {x for w in reach[v] for x in after[w]}
    parts = {v: min(w for w in reach[v] if v in reach[w]) for v in range(n) if v in reach[v]}
    level = {}
    before = {v: {a for a, b in pairs if b == v} for v in range(n)}
    while ready := [v for v in range(n) if v not in level and before[v] <= set(level)]:
        level.update({v: max((level[p] + 1 for p in before[v]), default=0) for v in ready})
    return parts, {v: level.get(v) for v in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_cycles_and_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(12, 26)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n + seed)]
    pairs = [(min(p), max(p)) for p in pairs] if seed == 1 else pairs + [(k, k + 1) for k in range(n - 1)] if seed == 2 else pairs
    pairs += [(k, (k + 1) % 7) for k in range(7)] if seed == 3 else []
    e = spark.createDataFrame([*pairs, (None, 1), (1, None)], "src long, dst long")
    parts, level = _plain_parts(n, pairs)
    assert {r["node"]: r["component"] for r in G.cycles(e).collect()} == parts
    assert {r["id"]: r["level"] for r in G.levels(spark.range(n), e).collect()} == level


def test_long_rings_and_chains_take_few_rounds(spark, monkeypatch):
    n, written = 500, []
    keep = G.stored
    monkeypatch.setattr(G, "stored", lambda df, label: written.append(label) or keep(df, label))
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = ring.select((F.col("src") + n).alias("src"), (F.col("src") + n + 1).alias("dst"))
    got = G.cycles(ring.unionByName(tail)).collect()
    assert len(got) == n and {r["component"] for r in got} == {0}
    assert written.count("graph-taken") <= 40
    written.clear()
    out = G.levels(spark.range(n), ring.filter("dst > 0"))
    assert out.filter("level = id").count() == n and written.count("graph-taken") <= 40


def _plain_groups(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = re.sub(r"[^\w]|_", " ", (t or "").lower()).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i, s in sets.items() if s}
    for a, b in itertools.combinations(group, 2):
        if group[a] != group[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            lo, hi = sorted((group[a], group[b]))
            group = {i: lo if g == hi else g for i, g in group.items()}
    sizes = Counter(group.values())
    return {i: (g, sizes[g], len(sets[i] & sets[g]) / len(sets[i] | sets[g])) for i, g in group.items() if sizes[g] > 1}


def test_similar_texts_are_grouped(spark):
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(5000)
    base = [[word() for _ in range(80)] for _ in range(12)]
    rows = [(k, " ".join(base[k % 12])) for k in range(12)]
    for k in range(60):  # some words changed, some cut, other case and punctuation
        w = list(base[k % 12])
        for _ in range(k % 4):
            w[rng.randrange(80)] = word()
        rows.append((100 + k, ", ".join(w[: 80 - k % 9]).upper() + "!"))
    shared = base[0][:30]  # a passage of many texts that are not similar
    rows += [(200 + k, " ".join(shared + [word() for _ in range(50)])) for k in range(40)]
    rows += [(300 + k, "Copy of one text, in a third of all rows.") for k in range(60)]
    rows += [(400, None), (401, ""), (402, " .,;"), (403, "few words"), (404, "Few, words"), (405, "other"), (406, "one two three four five"), (407, "日本語 テキスト")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = similar.near_groups(df, "id", "text").collect()
    want = _plain_groups(rows)
    assert len(got) == len(want) and {r["id"]: (r["group_id"], r["copies"], r["similarity"]) for r in got} == want
    one = " ".join(base[3]).replace(base[3][40], "changed")
    pair = spark.createDataFrame([(1, " ".join(base[3])), (2, one)], "id long, text string")
    assert {r["id"]: r["group_id"] for r in similar.near_groups(pair, "id", "text").collect()} == {1: 1, 2: 1}
    assert similar.near_groups(df.limit(0), "id", "text").isEmpty()


def test_shingles_are_kept_only_of_texts_that_meet(spark, monkeypatch):
    monkeypatch.setattr(similar, "SENT_NODES", 0)
    rng = random.Random(3)
    rows = [(k, " ".join("w%d" % rng.randrange(10**6) for _ in range(40))) for k in range(80)]
    rows += [(100, rows[5][1] + " end"), (101, "start " + rows[5][1]), (102, rows[7][1]), (103, None), (104, " ... ")]
    folder = storage_root(spark) + "/millrace"
    old = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = similar.near_groups(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert {r["id"]: (r["group_id"], r["copies"], r["similarity"]) for r in got} == _plain_groups(rows)
    made = [spark.read.parquet(f"{folder}/{x}") for x in set(os.listdir(folder)) - old if x.startswith("similar-")]
    coded = [t.count() for t in made if "codes" in t.columns]
    assert coded and max(coded) <= 3


def test_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_CODES", 40)
    rng = random.Random(4)
    sets = {k: set(range(100 * (k % 4), 100 * (k % 4) + 20)) - {100 * (k % 4) + rng.randrange(20)} for k in range(1, 25)}
    nodes = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "node long, codes array<long>")
    part = {k: 1 if k % 4 == 1 else k for k in sets}  # the parts known so far: one of the first node, and others of one node
    open_ = [(b, k, part[k], len(sets[k]), 1, 1) for b in (7, 8) for k in sets] + [(9, k, part[k], len(sets[k]), 2, 2) for k in (2, 3, 6)]
    got = similar._block_links(spark.createDataFrame(open_, "band long, node long, part long, n int, lead long, own long"), nodes, 0.8).collect()
    alike = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and part[a] != part[b]}
    assert {tuple(sorted(r)) for r in got} == alike and len(got) == len(alike)


def test_connected_parts(spark):
    chain = [((k * 7919) % 1009, ((k + 1) * 7919) % 1009) for k in range(300)]
    e = spark.createDataFrame([*chain, (2000, 2001), (2001, 2000), (3000, 3000), (None, 1)], "src long, dst long")
    got = {r["node"]: r["label"] for r in G.connected(e).collect()}
    nodes = {x for p in chain for x in p}
    assert got == {**{x: min(nodes) for x in nodes}, 2000: 2000, 2001: 2000}
    assert G.connected(e.limit(0)).isEmpty()


def test_a_long_search_reads_few_tables(spark, capsys):
    chain = spark.range(12).selectExpr("id AS src", "id + 1 AS dst")
    out = G.closure(chain)
    assert out.count() == 78 and out.agg(F.max("hops")).first()[0] == 12
    out.explain()
    assert 0 < capsys.readouterr().out.count("Scan ") <= G.ROUNDS_KEPT
