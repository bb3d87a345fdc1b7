"""Shards, nearest neighbours, archives and the pipeline against plain versions, and on unusual rows."""

import gzip
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from test_texts import LONG, ODD, check_packing, docs_of, plain_classes, same_rows

import corpus_pipeline
from millrace.llm import ann, jaccard, quality, sharding, toxicity, warc
from millrace.llm.common import fold
from millrace.llm.queries import R
from millrace.runtime import load, scratch_path


def test_registered_keys():
    keys = list(R.queries)
    assert sorted(int(k[2:].split("_")[0]) for k in keys) == list(range(1, 14)) and set(R.sql) <= set(keys)


# shards


@pytest.mark.parametrize("limit", [sharding.LIMIT, 100_000, 3_000])
def test_shards_equal_the_sql(spark, limit):
    folder = "/root/testdata/sf0.01"
    ok, note = compare(sharding.assign(load(spark, folder, "documents"), limit), connect(folder), sharding.SQL.replace(str(sharding.LIMIT), str(limit)))
    assert ok, note


def test_every_shard_fits(spark):
    rows = ODD + [(5, "repeated row " * 20)] * 400 + [(i, "t" * (i % 50)) for i in range(100, 600)]
    got = sharding.assign(docs_of(spark, rows).repartition(5), 4_000).cache()
    same_rows(got, rows)
    sizes, count, bits = defaultdict(int), Counter(), {}
    for r in got.collect():
        sizes[r.shard, r.page] += r.n_bytes
        count[r.shard, r.page] += 1
        assert bits.setdefault(r.doc_id, r.shard) == r.shard and len(r.shard) == r.depth
    assert all(size <= 4_000 or count[k] == 1 for k, size in sizes.items())
    prefixes = sorted(set(bits.values()))
    assert not any(b.startswith(a) for a, b in zip(prefixes, prefixes[1:]))
    assert sharding.assign(docs_of(spark, []), 10).count() == 0


def test_written_shards_hold_all_rows(spark):
    docs = docs_of(spark, ODD).withColumn("shard", F.lit("own"))
    path = scratch_path(spark, "shards")
    sharding.write(docs, path, 10_000)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == Counter((i, t, "own") for i, t in ODD)


def test_written_pages_of_a_hot_id_fit(spark):
    rows = [(5, f"{k} repeated row " * 20) for k in range(300)] + [(6, "same row " * 30)] * 200 + [(None, "no id " * 30)] * 100 + [(i, "t" * (i % 50)) for i in range(100, 400)]
    path = scratch_path(spark, "shards")
    sharding.write(docs_of(spark, rows).repartition(5), path, 4_000)
    back = spark.read.option("basePath", path).parquet(path).withColumn("file", F.input_file_name()).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    sizes, files = Counter(), defaultdict(set)
    for r in back:
        place = r.file.rsplit("/", 1)[0]
        sizes[place] += len(r.text.encode())
        files[place].add(r.file)
    assert max(sizes.values()) <= 4_000 and all(len(f) == 1 for f in files.values())


# nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.1, 7) for i, v in rows], "vec_id long, embedding array<float>, label string, score double, rank int")


def exact(rows, k=20):
    ok = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in [i for i in ok if i % 20 == 0]:
        out[q] = sorted((-float((ok[q] * v).sum()), i) for i, v in ok.items() if i != q)[:k]
    return out


def test_neighbours_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 5)]) for k in range(150)] + [(k, [1.0, 2.0, 0.0, 0.0, 1.0]) for k in range(150, 220)]
    bad = [(300, None), (320, [0.0] * 5), (340, [1.0, None, 1.0, 1.0, 1.0]), (360, [float("nan")] * 5), (380, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5), (400, [1.0, 2.0])]
    rows = [(i, v) for i, v in rows if any(v)]
    got = ann.op9(spark, vectors(spark, rows + bad + rows[:3]))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(found[r.query_id]) + 1
        found[r.query_id].append((-r.score, r.vec_id))
    want = exact(rows)
    assert set(found) == set(want)
    for q in want:
        assert found[q] == sorted(found[q])
    hits = sum(len({s for s, _ in found[q]} & {s for s, _ in want[q]}) / len({s for s, _ in want[q]}) for q in want) / len(want)
    assert hits > 0.9


def test_few_vectors(spark):
    assert ann.op9(spark, vectors(spark, [])).count() == 0
    assert ann.op9(spark, vectors(spark, [(20, [1.0, 0.0])])).count() == 0
    got = ann.op9(spark, vectors(spark, [(20, [1.0, 0.0]), (3, [0.5, 1.0]), (1, [0.5, 9.0])])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 1, 0.5), (20, 2, 3, 0.5)]


def test_doubles_keep_their_precision(spark):
    near = [(k, [1.0 + k * 1e-12, 0.0]) for k in range(1, 30)]
    table = spark.createDataFrame([(100, [1.0, 0.0])] + near, "vec_id long, embedding array<double>")
    got = ann.op9(spark, table).where("query_id = 100").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(k, 1.0 + k * 1e-12) for k in range(29, 9, -1)]


def test_queries_of_small_lists_still_get_all_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_CENTROID", 4)
    monkeypatch.setattr(ann, "RECALL", 0.0)
    monkeypatch.setattr(ann, "FIRST_LISTS", 1)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * 40
    rows = [(k, (centres[k % 30] + rng.normal(size=16) * 0.01).tolist()) for k in range(240)]
    found = Counter(r.query_id for r in ann.op9(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert found == {k: 20 for k in range(0, 240, 20)}


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 64)
    monkeypatch.setattr(ann, "QUERIES", 8)
    table = load(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, found = exact(rows), defaultdict(dict)
    for r in ann.op9(spark, table).collect():
        found[r.query_id][r.vec_id] = r.score
    hit = [len(set(found[q]) & {i for _, i in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hit) > 0.9 and all(len(found[q]) == 20 for q in want)
    assert all(abs(found[q][i] + s) < 1e-12 for q in want for s, i in want[q] if i in found[q])


# archives


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 5, "none") for i, u, h in rows], "page_id long, url string, html string, digest string, payload_bytes int, record_type string")


def test_archives(spark):
    body, other = "<p>größer</p>\r\n\r\nWARC/1.1\r\n" * 50, LONG
    rows = [(1, "http://a/ b\r\nX: y", body), (2, None, body), (9, "u", body), (None, "u", body), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", other), (8, "u", other), (8, "u", other), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "x" * 1000), (13, "u", "x" * 1000)]
    got = warc.op10(spark, pages_of(spark, rows)).collect()
    largest = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = largest.get(h) if h and len(raw) >= 1000 and i != largest.get(h) else None
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.op10(spark, pages_of(spark, [])).count() == 0


def crawled(k, body):
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_archives_with_a_member_for_each_record(spark, tmp_path):
    bodies = [b"", b"a", b"x\r\n\r\nWARC/1.1\r\n" * 90_000, "größer".encode() * 500] + [str(k).encode() * k for k in range(300)]
    records = [crawled(k, b) for k, b in enumerate(bodies)]
    one = gzip.compress(b"".join(records[:3]))
    many = b"".join(gzip.compress(r) for r in records[3:])
    cut = gzip.compress(b"".join(records[:40])[:700]) + gzip.compress(b"".join(records[:40])[700:])
    for name, data in (("one", one), ("many", many + b"\0" * 512), ("empty", b""), ("nothing", gzip.compress(b""))):
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    seen = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in seen) == list(range(len(bodies)))
    assert all(bytes(r.payload) == bodies[r.id] and r.payload_digest == r.digest for r in seen)
    assert [r[4] for r in warc.parse(warc.inflated(cut, 64))] == bodies[:40]
    assert [r[4] for r in warc.parse(warc.inflated(many, 100))] == bodies[3:]
    for broken in (one[:-20], many + b"x", gzip.compress(records[3][:-2]), gzip.compress(b"HTTP/1.1 200\r\n\r\n"), gzip.compress(b"WARC/1.1\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.parse(warc.inflated(broken)))


def test_a_shared_digest_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(k, "u", LONG) for k in range(1, 300)] + [(None, "u", LONG), (None, "u", LONG), (5, "u", LONG), (5, "u", LONG + "y"), (400, "u", LONG + "y"), (401, "u", "s"), (402, "u", "s"), (403, "u", None)]
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op10(spark, pages_of(spark, rows)).collect())
    n = len(LONG.encode())
    want = Counter((i, n, "response" if i == 299 else "revisit", None if i == 299 else 299) for i, _, h in rows if h == LONG)
    want += Counter([(5, n + 1, "revisit", 400), (400, n + 1, "response", None), (401, 1, "response", None), (402, 1, "response", None), (403, 0, "response", None)])
    assert n >= 1000 and got == want


def test_archive_payloads_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = load(spark, "/root/testdata/sf0.001", "pages")
    pages = pages.unionByName(pages.where("page_id % 7 = 0").withColumn("page_id", F.col("page_id") + 1000))
    path = scratch_path(spark, "warc")
    warc.write(warc.resolve(warc.headers(pages)), path, records=7)
    bodies = {r.page_id: r.html.encode() for r in pages.collect()}
    seen = warc.read(spark, path).collect()
    assert len(seen) == len(bodies)
    for r in seen:
        if r.record_type == "response":
            assert bytes(r.payload) == bodies[r.id]
        else:
            assert r.payload is None and bodies[r.refers_to] == bodies[r.id] and r.refers_to > r.id


# pipeline


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = load(spark, folder, "documents")
    labels = load(spark, folder, "labels")
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    assert list(kept) == ["toxicity", "quality", "jaccard", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            docs = docs.cache()
        rows = {r.doc_id for r in docs.collect()}
        if name == "toxicity":
            score = {r.doc_id: r.score for r in toxicity.score(before, toxicity.fit(before, labels, lambda c: fold(c, 3) != 1)).collect()}
            assert rows == {i for i, s in score.items() if s < 0.7}
        elif name == "quality":
            score = {r.doc_id: r.score for r in quality.score(before, quality.fit(before, labels, lambda c: fold(c, 4) != 2)).collect()}
            assert rows == {i for i, s in score.items() if s >= 0.7}
        elif name == "jaccard":
            plain = plain_classes([(r.doc_id, r.text) for r in before.collect()])
            assert rows == {i for i, _, c in plain if c == i}
        else:
            assert rows == {r.doc_id for r in before.collect()}
            check_packing(docs.collect())
    again = {(r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, folder).collect()}
    assert again == {(r.doc_id, r.piece, r.length) for r in docs.collect()}


def test_pipeline_takes_any_rows(spark):
    folder = "/root/testdata/sf0.001"
    for rows in (ODD, []):
        docs = docs_of(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder).cache()
            docs.count()
    assert jaccard.keep_one(docs_of(spark, ODD)).columns == docs_of(spark, ODD).columns
