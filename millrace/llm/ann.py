"""Approximate nearest neighbours with balanced posting lists (in the manner of SPANN, Chen et al. 2021).

Inner products become distances by one more component (the norm that a vector lacks to the largest one). Centroids of balanced
clusters are fitted on a bounded sample; every vector goes to the list of its nearest centroid and, when it lies near a
boundary, to others too. A small graph over the centroids, held in memory, finds the nearest lists of a vector. A query opens
the lists whose centroid is at most ``ratio`` times as far as the nearest one; the ratio is chosen on the sample so that the
measured recall there reaches a target. Lists longer than ``LIST`` are cut, and the queries of a list are dealt in blocks, so
a task's memory is bounded whatever the largest cluster holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, quoted, written

#: Bounds of the fitting sample: vectors, and numbers in all.
SAMPLE = 20_000
SAMPLE_VALUES = 4_000_000
#: Sample vectors for one centroid, and the largest number of centroids.
PER_CENTROID = 80
CENTROIDS = 1024
LIST = 4_096
QUERIES = 1_024
#: Boundary replication: distance ratio, and lists of one vector at most.
BOUNDARY = 1.02
REPLICAS = 3
RECALL = 0.96
FIRST_LISTS = 3


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    entry: np.ndarray
    largest: float
    ratio: float

    def distances(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids found by the graph, nearest first, and their distances. Best-first with ``beam`` kept candidates."""
        c = self.centroids
        n, k = len(x), len(c)
        beam = min(beam, k)
        norm, own = (c**2).sum(1), (x**2).sum(1)
        d = np.full((n, k), np.inf)
        opened = np.zeros((n, k), dtype=bool)
        d[:, self.entry] = own[:, None] - 2 * x @ c[self.entry].T + norm[self.entry]
        rows = np.arange(n)
        while len(rows):
            sub = np.where(opened[rows], np.inf, d[rows])
            best = sub.argmin(1)
            reach = np.partition(d[rows], beam - 1, axis=1)[:, beam - 1]
            go = sub[np.arange(len(rows)), best] <= reach
            go &= np.isfinite(sub[np.arange(len(rows)), best])
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            opened[rows, best] = True
            near = self.graph[best]
            found = own[rows, None] - 2 * np.einsum("ij,ikj->ik", x[rows], c[near]) + norm[near]
            d[rows[:, None], near] = found
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        return order, np.sqrt(np.maximum(0, np.take_along_axis(d, order, 1)))

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists of stored vectors: the nearest, and those about as near unless a chosen list is nearer to them than the vector."""
        order, d = self.distances(x, 16)
        out = []
        for o, r in zip(order, d):
            chosen = [o[0]]
            for c, far in zip(o[1:], r[1:]):
                if len(chosen) >= REPLICAS or far > BOUNDARY * r[0] or not np.isfinite(far):
                    break
                if all(((self.centroids[c] - self.centroids[b]) ** 2).sum() >= far * far * 0.25 for b in chosen):
                    chosen.append(c)
            out.append(np.array(chosen, dtype=np.int32))
        return out

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists that a query opens, nearest first: at least ``FIRST_LISTS``, then by the distance ratio."""
        order, d = self.distances(x, len(self.centroids))
        opens = (d <= self.ratio * d[:, :1]) & np.isfinite(d)
        opens[:, :FIRST_LISTS] = np.isfinite(d[:, :FIRST_LISTS])
        return [o[m].astype(np.int32) for o, m in zip(order, opens)]


def widened(x: np.ndarray, largest: float) -> np.ndarray:
    """Stored vectors with the component that brings them all to the largest norm."""
    lack = np.sqrt(np.maximum(0, largest**2 - (x**2).sum(1)))
    return np.hstack([x, lack[:, None]])


def _halves(x: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    a = x[((x - x[rng.integers(len(x))]) ** 2).sum(1).argmax()]
    b = x[((x - a) ** 2).sum(1).argmax()]
    for _ in range(6):
        order = np.argsort(x @ (b - a), kind="stable")
        half = len(x) // 2
        a, b = x[order[:half]].mean(0), x[order[half:]].mean(0)
    return order[:half], order[half:]


def build(sample: np.ndarray, largest: float, seed: int = 5) -> Index:
    """Balanced clusters by repeated halving, two rounds of means, the graph, and the ratio that reaches ``RECALL`` on the sample."""
    rng = np.random.default_rng(seed)
    x = widened(sample, largest)
    wanted, leaves = min(CENTROIDS, max(1, len(x) // PER_CENTROID)), [np.arange(len(x))]
    while 2 * len(leaves) <= wanted:
        leaves = [leaf[h] for leaf in leaves for h in _halves(x[leaf], rng)]
    c = np.stack([x[leaf].mean(0) for leaf in leaves])
    for _ in range(2):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(1, size)[:, None], c)
    between = ((c[:, None, :] - c[None]) ** 2).sum(2) if len(c) <= 256 else (c**2).sum(1)[:, None] - 2 * c @ c.T + (c**2).sum(1)
    degree = min(len(c), 24)
    graph = np.argsort(between, axis=1, kind="stable")[:, :degree].copy()
    if degree > 8:  # some long links, and a ring, so that every centroid can be reached
        graph[:, -6:-1] = rng.integers(0, len(c), (len(c), 5))
        graph[:, -1] = (np.arange(len(c)) + 1) % len(c)
    index = Index(c, graph, rng.permutation(len(c))[: min(len(c), 16)], largest, 1.0)
    index.ratio = _ratio(index, sample, rng)
    return index


def _ratio(index: Index, sample: np.ndarray, rng, k: int = 20) -> float:
    """The smallest distance ratio, in steps of 0.02, that finds ``RECALL`` of the sample's own nearest neighbours."""
    if len(index.centroids) == 1 or len(sample) <= k + 1:
        return np.inf
    member = np.zeros((len(sample), len(index.centroids)), dtype=bool)
    for i, lists in enumerate(index.lists(widened(sample, index.largest))):
        member[i, lists] = True
    ask = rng.permutation(len(sample))[:256]
    s = sample[ask] @ sample.T
    s[np.arange(len(ask)), ask] = -np.inf
    best = np.argpartition(-s, k, axis=1)[:, :k]
    order, d = index.distances(np.hstack([sample[ask], np.zeros((len(ask), 1))]), len(index.centroids))
    far = np.full((len(ask), len(index.centroids)), np.inf)
    np.put_along_axis(far, order, d, 1)
    needs = np.where(member[best], far[:, None, :], np.inf).min(2) / d[:, :1]
    return float(np.ceil(np.quantile(needs, RECALL) * 50) / 50)


def clean(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(_id, _v): vectors that take part, in their own precision (float stays float, any other number is a double). NULL ids,
    NULL or zero vectors, vectors with NULL or non-finite components, and vectors whose length is not the most frequent one (the
    longest among equals; no inner product with the others is defined) take none."""
    own = table.schema[table.columns.index(vec_col)].dataType.simpleString()
    v = F.col(quoted(vec_col)).cast(own if own == "array<float>" else "array<double>")
    rows = picked(table, id_col, vec_col).select(F.col(quoted(id_col)).cast("long").alias("_id"), v.alias("_v")).where("_id is not null and _v is not null")
    bad = F.exists("_v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    rows = rows.where(~bad & F.exists("_v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("_v") == (sizes[0].n if sizes else 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def fit(rows: DataFrame) -> Index | None:
    """The index, from at most ``SAMPLE`` vectors and ``SAMPLE_VALUES`` numbers, taken in the order of a hash of the id."""
    top = rows.select(F.max(F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("m"), F.max(F.size("_v")).alias("d")).first()
    if top.m is None:
        return None
    limit = max(1, min(SAMPLE, SAMPLE_VALUES // top.d))
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(limit).select("_v").toArrow()
    return build(_matrix(sample.column("_v")), float(top.m))


def _assigned(rows: DataFrame, index, queries: bool) -> DataFrame:
    """(_id, _v, _lists) of every row."""

    def run(batches):
        own = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column("_v"))
                found = own.probes(np.hstack([x, np.zeros((len(x), 1))])) if queries else own.lists(widened(x, own.largest))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_v"), pa.array([f.tolist() for f in found], pa.list_(pa.int32()))], ["_id", "_v", "_lists"])

    return rows.mapInArrow(run, f"_id long, _v {rows.schema['_v'].dataType.simpleString()}, _lists array<int>")


def _opened(asked: DataFrame, stored: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """(query_id, vec_id, score): for each (query, list cut) the ``k`` best vectors not under the query's bar.

    ``asked`` has (_id, _v, _list, _bar). Queries of a list are dealt in blocks, its vectors in cuts: each block meets each cut once.
    """
    load = {r._list: r.n for r in asked.groupBy("_list").agg(F.count("*").alias("n")).collect()}  # a row for each centroid at most
    cuts = F.create_map(*[F.lit(x) for p in sizes.items() for x in (p[0], -(-p[1] // LIST))])
    blocks = F.create_map(*[F.lit(x) for p in load.items() for x in (p[0], -(-p[1] // QUERIES))]) if load else F.create_map(F.lit(-1), F.lit(1))
    at = F.col("_list")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    left = asked.withColumn("_block", F.pmod(F.xxhash64("_id"), blocks[at]).cast("int")).withColumn("_cut", F.explode(upto(cuts[at])))
    right = stored.withColumn("_cut", F.pmod(F.xxhash64("_id"), cuts[at]).cast("int")).withColumn("_block", F.explode(upto(F.try_element_at(blocks, at))))

    def meet(key, a, b):
        q, v = _matrix(a.column("_v")), _matrix(b.column("_v"))
        qid, vid, bar = a.column("_id").to_numpy(), b.column("_id").to_numpy(), a.column("_bar").to_numpy()
        out = ([], [], [])
        if len(q) and len(v):
            near = q @ v.T
            for i in range(len(q)):
                s = np.where(vid == qid[i], -np.inf, near[i])
                floor = bar[i] - 1e-9
                if len(s) > k:
                    floor = max(floor, np.partition(s, len(s) - k)[len(s) - k] - 1e-9)
                at = np.flatnonzero((s >= floor) & np.isfinite(s))
                exact = (v[at] * q[i]).sum(1)
                best = np.lexsort((vid[at], -exact))[:k]
                out[0].append(np.full(len(best), qid[i]))
                out[1].append(vid[at][best])
                out[2].append(exact[best])
        joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)), "score": pa.array(joined[2].astype(np.float64))})

    keys = ["_list", "_cut", "_block"]
    return left.select("_id", "_v", "_bar", *keys).groupBy(*keys).cogroup(right.select("_id", "_v", *keys).groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query, from all ``rows`` but those with the query's id.

    Both have (_id, _v) as ``clean`` gives them. Rows that repeat an id and a vector count once. The nearest lists are opened
    first; they give each query a bar (its k-th score so far), and the other lists return only what reaches the bar. A query whose
    lists hold fewer than ``k`` others opens all lists.
    """
    spark = rows.sparkSession
    model = fit(rows)
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if model is None:
        return empty
    index = spark.sparkContext.broadcast(model)  # at most CENTROIDS centroids
    stored = written(_assigned(rows, index, False).select("_id", "_v", F.explode("_lists").alias("_list")), "ann-lists")
    sizes = {r._list: r.n for r in stored.groupBy("_list").agg(F.count("*").alias("n")).collect()}  # a row for each centroid at most
    queried = written(_assigned(queries, index, True), "ann-queries")
    asked = queried.select("_id", "_v", F.posexplode("_lists").alias("_pos", "_list")).where(F.col("_list").isin(list(sizes)))
    nearest = asked.where(F.col("_pos") < FIRST_LISTS).withColumn("_bar", F.lit(float("-inf")))
    first = written(_best(_opened(nearest, stored, sizes, k), k), "ann-first")
    bars = first.where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("_bar"))
    rest = asked.where(F.col("_pos") >= FIRST_LISTS).join(bars, "_id", "left").withColumn("_bar", F.coalesce("_bar", F.lit(float("-inf"))))
    found = written(_best(first.drop("rank").unionByName(_opened(rest, stored, sizes, k)), k), "ann-found")
    short = queried.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("_id")).distinct(), "_id", "left_anti")
    if not short.isEmpty():
        everywhere = short.select("_id", "_v", F.explode(F.array(*[F.lit(c) for c in sorted(sizes)])).alias("_list"), F.lit(float("-inf")).alias("_bar"))
        found = _best(found.drop("rank").unionByName(_opened(everywhere, stored, sizes, k)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9(spark, table: DataFrame) -> DataFrame:
    rows = clean(table)
    return search(rows, rows.where("_id % 20 = 0"))
