"""Filter audit, near-duplicate vectors and conversation repair against plain versions, and on unusual rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from test_texts import ODD

from millrace.llm import audit, neardup, repair
from millrace.runtime import load

# filter audit


def plain_audit(docs, labels):
    """Every order, document by document."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1} - {None}
    bad = {i for i, _, x in labels if x == 1} - {None}
    fails = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((lang or "", i, {k for k, v in f.items() if v}))
    out = {}
    removed_by = Counter()
    for part in {p for p, _, _ in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, f) for p, i, f in fails if p == part]
            gone = []
            for step, name in enumerate(order, 1):
                here = [(i, f) for i, f in left if name in f]
                row = [len(left) - len(here), len(here), sum(name in f for _, f in gone), sum(f == {name} for p, _, f in fails if p == part), sum(i in good for i, _ in here), sum(i in bad for i, _ in here)]
                out[part, "".join(order), step] = row
                removed_by[part, name] += len(here)
                gone += here
                left = [(i, f) for i, f in left if name not in f]
    return {k: [*v, removed_by[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in df.collect()}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_audit_equals_the_sql(spark, folder):
    ok, note = compare(audit.op11(spark, load(spark, folder, "documents"), load(spark, folder, "labels")), connect(folder), audit.SQL)
    assert ok and "TYPES" not in note, note


def audit_rows():
    rng = random.Random(4)
    rows = [(i, t, ["en", None, "de"][k % 3]) for k, (i, t) in enumerate(ODD)]
    rows += [(100 + k, "same text of many documents " * (k % 4), "en") for k in range(60)]
    rows += [(None, "same text of many documents ", "fr"), (300, "A#B", "en"), (300, "A#B", "en"), (301, "A#B", "fr"), (302, " ".join(str(k) for k in range(120)), "")]
    rows += [(400 + k, " ".join(rng.choice(["Word", "w", "x%", "LOUD", "tail"]) + str(rng.randrange(200)) for _ in range(rng.randrange(90, 130))), "de") for k in range(40)]
    return rows


@pytest.mark.parametrize("parts,most", [(1, audit.MOST), (7, 1 << 16)])
def test_audit_of_unusual_rows_in_any_partitions(spark, monkeypatch, parts, most):
    monkeypatch.setattr(audit, "MOST", most)
    rows = audit_rows()
    labels = [(5, 1, 0), (5, 1, 1), (300, None, 1), (None, 1, 1), (101, 0, 1), (102, 1, None), (9999, 1, 1)]
    docs = spark.createDataFrame([(t, i, g, 1, "x", 2, "k") for i, t, g in rows], "text string, doc_id long, lang string, mask int, part string, n int, key string").repartition(parts)
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert audited(audit.op11(spark, docs, marks)) == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.op11(spark, docs, labels).count() == 0
    some = spark.createDataFrame([(1, None, None)], docs.schema)
    got = audited(audit.op11(spark, some, labels))
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and got["", "ABCDE", 2] == [0] * 7


def test_a_full_sketch_decides_nothing(spark, monkeypatch):
    """With far too few counters nearly all texts may be repeated, and the result is the same."""
    rows = [(k, f"text number {k % 900}", "en") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    want = Counter(k >= 900 for k in range(1500))
    for least, most in ((1 << 16, 1 << 27), (audit.BLOCK, audit.BLOCK)):
        monkeypatch.setattr(audit, "LEAST", least)
        monkeypatch.setattr(audit, "MOST", most)
        assert Counter(bool(r.mask & 16) for r in audit.masks(docs).collect()) == want
    monkeypatch.setattr(audit, "probes", lambda digests, counters: np.zeros((len(digests), 1), np.int64))
    sketch = audit.merged_sketch(docs.select(F.col("text").alias("_t")), 1 << 16)
    assert audit.repeated(sketch, np.zeros((3, 1), np.int64)).all() and not audit.repeated(sketch, np.ones((1, 1), np.int64)).any()


def test_sketches_count_every_text_once_a_row(spark):
    counters = 1 << 18
    texts = [f"t{k % 700}" for k in range(1000)]
    df = spark.createDataFrame([(t,) for t in texts], "_t string").repartition(9)
    sketch = audit.merged_sketch(df, counters)
    n = Counter(texts)
    maybe = audit.repeated(sketch, audit.probes([audit.text_digest(t) for t in n], counters))
    assert all(m for t, m in zip(n, maybe) if n[t] > 1) and sum(m for t, m in zip(n, maybe) if n[t] == 1) < 20


# near-duplicate vectors


def plain_links(rows, threshold=0.9):
    ok = [k for k, (_, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in {len(rows[k][1]) for k in ok}:
        own = [k for k in ok if len(rows[k][1]) == d]
        x = np.array([rows[k][1] for k in own], dtype=np.float64)
        x = x / np.abs(x).max(1)[:, None]
        x = x / np.linalg.norm(x, axis=1)[:, None]
        for a, b in np.argwhere(np.triu(x @ x.T >= threshold, 1)):
            links[own[a]] += 1
            links[own[b]] += 1
            parent[max(root(own[a]), root(own[b]))] = min(root(own[a]), root(own[b]))
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return Counter((i, links[k], min(least[root(k)], default=None), i == min(least[root(k)], default=None)) for k, (i, _) in enumerate(rows))


def linked(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_classes_of_the_given_vectors(spark, folder):
    table = load(spark, folder, "embeddings")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    assert linked(neardup.op12(spark, table)) == plain_links(rows)


def close_rows(d=24, seed=2):
    """Vectors whose cosines gather around the threshold, chains, copies, and a large group of near copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, d))
    rows = []
    for k in range(600):
        b = base[k % 12]
        rows.append((k, (b + rng.normal(size=d) * np.linalg.norm(b) / np.sqrt(d) * rng.uniform(0.25, 0.5)) * rng.uniform(0.01, 100)))
    hot = rng.normal(size=d)
    rows += [(1000 + k, hot + rng.normal(size=d) * 0.01) for k in range(400)]
    rows += [(2000 + k, hot * (1 + k)) for k in range(20)] + [(2100 + k, -base[0]) for k in range(5)]
    return [(i, [float(x) for x in v]) for i, v in rows]


@pytest.mark.parametrize("groups,tile,parts", [(8, 1024, 3), (3, 64, 1), (1, 16, 9)])
def test_classes_around_the_threshold(spark, monkeypatch, groups, tile, parts):
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = close_rows()
    table = spark.createDataFrame([(v, 1, i, "x") for i, v in rows], "embedding array<double>, a int, vec_id long, label string").repartition(parts)
    assert linked(neardup.near_duplicates(table, groups=groups)) == plain_links(rows)


def test_unusual_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [-1.0, -2.0]), (9, [1e300, 2e300]), (10, [1e-300, 2e-300]), (None, [1.0, 2.1]), (None, [5.0, -1.0]), (11, [1.0, 2.0, 0.0]), (12, [1.0, 2.0, 0.01]), (13, [1.0])]
    table = spark.createDataFrame([(i, v, 1, "b", 2) for i, v in rows], "vec_id long, embedding array<double>, label int, base string, n int")
    got, want = linked(neardup.near_duplicates(table)), plain_links([(i, v) for i, v in rows])
    keyed = lambda c: Counter((i, n, m) for (i, n, m, _), k in c.items() for _ in range(k))
    assert keyed(got) == keyed(want)
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_bounds_hold_and_decide_most_pairs():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(20, 48)), 30, axis=0) + rng.normal(size=(600, 48)) * rng.uniform(0.05, 0.5, size=(600, 1))
    a = neardup.Tile(np.arange(600), x)
    real = a.unit @ a.unit.T
    close = neardup.product(a, a) * a.scale[:, None] * a.scale
    bound = a.lost[:, None] * a.length + a.lost[None, :]
    assert (np.abs(close - real) <= bound + neardup.SLACK).all() and bound.max() < 0.05
    i, j, again = neardup.links(a, a)
    assert set(zip(i.tolist(), j.tolist())) == {tuple(p) for p in np.argwhere(np.triu(real >= 0.9, 1)).tolist()}
    assert 0 < again < 600 * 599 / 2 / 5
    wide = neardup.Tile(np.arange(40), rng.normal(size=(40, 3000)))
    assert (neardup.product(wide, wide) == wide.codes.astype(np.int64) @ wide.codes.astype(np.int64).T).all()


def test_far_tiles_are_not_multiplied():
    rng = np.random.default_rng(0)
    a, b = (neardup.Tile(np.arange(50), c + rng.normal(size=(50, 8)) * 0.01) for c in (np.eye(8)[0], np.eye(8)[1]))
    assert neardup.apart(a, b) and not neardup.apart(a, a)


# conversation repair


def plain_repairs(kinds, costs, most=2):
    """All edits of a short conversation: the least (cost, audit)."""
    found = []
    fills = [f for k in range(most + 1) for f in itertools.product("ua", repeat=k)]

    def walk(at, cost, audit, said):
        for fill in fills:
            c, a, s = cost + costs.insert * len(fill), audit + "I" * len(fill), said + "".join(fill)
            if at == len(kinds):
                if re.fullmatch("(s?(ua)+)?", s):
                    found.append((c, a))
                continue
            initial, state = kinds[at]
            walk(at + 1, c + costs.delete, a + "D", s)
            if state != "gone":
                extra = costs.truncated if state == "cut" else 0
                if initial:
                    walk(at + 1, c + extra, a + "K", s + initial)
                for to in "ua":
                    walk(at + 1, c + extra + costs.rerole, a + "R", s + to)

    walk(0, 0, "", "")
    return min(found)


def test_cells_are_the_cheapest_edits():
    kinds = [repair.Kind(i, s) for i in ("s", "u", "a", "x", "") for s in ("fine", "cut", "gone")]
    rng = random.Random(1)
    for costs in (repair.Costs(), repair.Costs(3, 7, 1, 2), repair.Costs(1, 1, 1, 1), repair.Costs(4, 9, 2, 5)):
        for n in (0, 1, 2, 3):
            for _ in range(12 if n else 1):
                some = [rng.choice(kinds) for _ in range(n)]
                assert repair.best(repair.span_cell(some, costs))[:2] == plain_repairs(some, costs), (some, costs)


def test_any_split_gives_the_same_cell():
    rng = random.Random(2)
    for costs in (repair.Costs(), repair.Costs(2, 3, 1, 1)):
        some = [repair.Kind(rng.choice("suaax"), rng.choice(["fine", "fine", "cut", "gone"])) for _ in range(23)]
        whole = repair.span_cell(some, costs)
        assert all(repair.joined(repair.span_cell(some[:k], costs), repair.span_cell(some[k:], costs)) == whole for k in range(24))
        cells = [repair.span_cell(some[k : k + 4], costs) for k in range(0, 23, 4)]
        cost, audit, states = repair.choose(cells)
        assert (cost, audit) == repair.best(whole)[:2]
        assert "".join(c[s][1] for c, s in zip(cells, states)) == audit and all(a[1] == b[0] for a, b in zip(states, states[1:]))


def linear_repair(kinds, costs=repair.Costs()):
    """The same minimum by one pass over the states, without spans."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def closed(best):
        for _ in range(6):
            for (p, c), q in step.items():
                if c != "s" and p in best and (q not in best or (best[p][0] + costs.insert, best[p][1] + "I") < best[q]):
                    best[q] = (best[p][0] + costs.insert, best[p][1] + "I")
        return best

    best = closed({"": (0, "")})
    for initial, state in kinds:
        new = {}
        extra = costs.truncated if state == "cut" else 0
        for p, (cost, audit) in best.items():
            options = [(p, costs.delete, "D")]
            if state != "gone":
                options += [(q, extra, "K") for (s, c), q in step.items() if s == p and c == initial]
                options += [(q, extra + costs.rerole, "R") for (s, c), q in step.items() if s == p and c != "s"]
            for q, c, e in options:
                new[q] = min(new.get(q, (1 << 60, "")), (cost + c, audit + e))
        best = closed(new)
    return min(best[q] for q in ("", "a") if q in best)


def plain_report(rows):
    """conv -> report, from (conv, turn, role, text) rows."""
    out, after = {}, defaultdict(list)
    text = lambda x: " " if x is None else str(x)
    for conv, turn, role, said in rows:
        after[conv]
        role, said = text(role), text(said)
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        said = "" if kind == 1 else re.sub("[.!?]", "", said) if kind == 2 else said
        after[conv] += [(turn, "user" if kind == 4 else role, said)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        count, kinds, seen = Counter(), [], set()
        for _, role, said in own:
            ends = re.findall(r"[^\x20\x09-\x0D]", said)
            state = "blank" if not ends else "duplicate" if (role, said) in seen else "fine" if ends[-1] in ".!?" else "cut"
            seen.add((role, said))
            count[state] += 1
            kinds.append((role[:1], "gone" if state in ("blank", "duplicate") else state))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = linear_repair(kinds)
        said, state = [], ""
        at = iter(own)
        for e in audit:
            _, role, words = (None, None, "") if e == "I" else next(at)
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if state == "u" else "user"
            state = role[:1]
            said.append(f"{role}:{words}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in said))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["cut"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def talks():
    rng = random.Random(3)
    says = ["", " \t", "Yes.", "No", "Why?", "Well!\n", "And then, ", None, "日本。", "é."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "ursa"]), rng.choice(says)) for c in range(40) for t in range(rng.randrange(1, 14))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"Line {t} stays.") for t in range(120)] + [(101, t, "user", "The same.") for t in range(50)]
    rows += [(102, 1, "user", "One turn.")] * 30 + [(102, None, "assistant", "No turn.")] * 3 + [(None, t, "user", f"x{t}.") for t in (1, 2, 9, None, 40)]
    rows += [(None, None, None, None), (103, 7, "system", "word " * 4000 + ".")]
    return rows


@pytest.mark.parametrize("long_rows,long_bytes,parts", [(repair.LONG_ROWS, repair.LONG_BYTES, 2), (5, 1 << 18, 6), (3, 40, 1)])
def test_reports_of_unusual_conversations(spark, long_rows, long_bytes, parts):
    rows = talks()
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, n int, conv string, no int").repartition(parts)
    pieces = repair.chunks(repair.damaged(table), long_rows, long_bytes)
    got = repair.reports(pieces).collect()
    want = plain_report(rows)
    assert len(got) == len(want) and {r.conv: tuple(r[1:]) for r in got} == want
    said = defaultdict(list)
    for r in repair.repaired(pieces).collect():
        said[r.conv].append((r.at, f"{r.role}:{r.text}"))
    for conv, report in want.items():
        assert [k for k, _ in sorted(said[conv])] == list(range(len(said[conv])))
        assert hashlib.sha256("\n".join(x for _, x in sorted(said[conv])).encode()).hexdigest() == report[-1]


def test_reports_of_the_given_conversations(spark):
    table = load(spark, "/root/testdata/sf0.01", "conversations")
    got = repair.op13(spark, table).collect()
    assert {r.conv_id: tuple(r[1:]) for r in got} == plain_report([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert repair.op13(spark, table.limit(0)).count() == 0


def test_an_insertion_must_cost():
    with pytest.raises(ValueError):
        repair.span_cell([repair.Kind("u", "fine")], repair.Costs(insert=0))

