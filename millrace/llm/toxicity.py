"""Toxicity: multiple-instance learning with noisy-or over sentences, trained from document labels.

A word has the features "whole word" and "starts with" (4 to 7 letters). Sentence s is toxic with probability
1 - exp(-r(s)), r(s) the sum of the non-negative weights of the features of its words; a document is toxic if one of its
sentences is: P = 1 - prod(1 - p(s)). In the weights the negative log likelihood of the labels is convex, and a document
without evidence scores 0 however long it is. The sentences with the largest p(s) are the offending ones.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, id_type, map_slices, per_worker, picked, quoted, slices, texts_of, written
from .quality import label_sample

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
THRESHOLD = 0.7
STARTS = (4, 5, 6, 7)
#: Bounds of the training sample: documents, and (document, feature) entries. Labelled rows are taken in the order of a hash of the id,
#: toxic and clean ones in turn while there are both.
SAMPLE_DOCS = 8000
SAMPLE_ENTRIES = 6_000_000
#: Bound of the word cache of a task.
CACHE = 150_000


def features(word: str) -> list[str]:
    """Features of a lower-cased word."""
    return ["=" + word] + [word[:k] for k in STARTS if len(word) >= k]


def sentence_counts(text: str) -> dict[str, int]:
    """Feature -> number of sentences of the text that hold it."""
    out: dict[str, int] = {}
    for s in SENTENCE.findall(text.lower()):
        for f in {f for w in set(WORD.findall(s)) for f in features(w)}:
            out[f] = out.get(f, 0) + 1
    return out


def train(doc: np.ndarray, feat: np.ndarray, times: np.ndarray, y: np.ndarray, n_feat: int, rounds: int = 400, price: float = 0.02, leak: float = 0.002) -> np.ndarray:
    """Non-negative weights: projected Adam on the noisy-or likelihood with a price on the sum of weights."""
    w = np.full(n_feat, 0.1)
    m, v = np.zeros(n_feat), np.zeros(n_feat)
    for k in range(1, rounds + 1):
        rate = np.bincount(doc, w[feat] * times, minlength=len(y))
        live = np.exp(-np.minimum(rate, 50)) * (1 - leak)
        slope = (1 - y) - y * live / np.maximum(1 - live, 1e-9)
        g = np.bincount(feat, slope[doc] * times, minlength=n_feat) + price
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = np.maximum(0, w - 0.1 * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8))
    return w


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_entries: int = SAMPLE_ENTRIES) -> dict[str, float]:
    """Feature weights, learned from at most ``sample_docs`` labelled documents for which ``keep(id column)`` holds.

    The executors count features; those seen in fewer than two toxic sample documents, or in no larger share of the toxic than
    of the clean ones, are dropped there by one aggregation. At most ``sample_entries`` (document, feature) counts come to the
    driver: a document that would pass the bound is left out whole. Empty if there is nothing to learn from.
    """
    sides = [label_sample(labels, label, id_col, keep, sample_docs, having) for having in ("_y > 0", "_y <= 0")]
    turn = F.row_number().over(Window.partitionBy(F.col("_y") > 0).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id"))  # 2 * sample_docs rows at most
    ids = sides[0].unionByName(sides[1]).withColumn("_k", turn).orderBy("_k", F.desc("_y")).limit(sample_docs).drop("_k")
    rows = picked(docs, id_col, text_col).toDF("_id", "_t").join(F.broadcast(ids), "_id").select("_id", "_y", "_t")

    def make():
        per_worker("toxicity counts")

        def counted(part):
            keys, ys, names, times = [], [], [], []
            for key, y, text in zip(part.column("_id").cast(pa.string()).to_pylist(), part.column("_y").to_pylist(), texts_of(part, "_t")):
                c = sentence_counts(text) or {"": 0}
                keys += [key] * len(c)
                ys += [y] * len(c)
                names += c.keys()
                times += c.values()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ys, pa.float64()), pa.array(names, pa.string()), pa.array(times, pa.int32())], ["id", "y", "f", "n"])

        return counted

    found = written(map_slices(rows, "_t", "id string, y double, f string, n int", make), "toxicity-counts")
    bags = found.groupBy("id").agg(F.max("y").alias("y"))
    sums = found.groupBy("f").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("yes"), F.sum(F.when(F.col("y") > 0, 0).otherwise(1)).alias("no"))
    of = bags.agg(F.count_if(F.col("y") > 0).alias("yes"), F.count_if(F.col("y") <= 0).alias("no")).first()
    useful = sums.where(F.expr(f"f != '' and yes >= 2 and (no = 0 or yes * {of.no}L > no * {of.yes}L)"))
    entries = written(found.join(useful.select("f"), "f", "left_semi").groupBy("id", "f").agg(F.max("n").alias("n")), "toxicity-entries")
    sizes = bags.join(entries.groupBy("id").agg(F.count("*").alias("c")), "id", "left").select("id", "y", F.coalesce("c", F.lit(0)).alias("c"))
    taken, y, room = [], [], sample_entries
    for r in sizes.orderBy(F.xxhash64("id"), "id").limit(sample_docs).collect():
        if r.c <= room:
            room -= r.c
            taken.append((r.id, len(taken)))
            y.append(r.y)
    if room == sample_entries:
        return {}
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, "id string, k int"))
    got = entries.join(chosen, "id").select("k", "f", "n").toArrow()
    f = got.column("f").combine_chunks().dictionary_encode()
    names, at = np.unique(f.dictionary.to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    key, times = got.column("k").to_numpy().astype(np.int64) * len(names) + at[f.indices.to_numpy()], got.column("n").to_numpy().astype(np.float32)
    del got, f, at  # the driver holds the counts once
    pa.default_memory_pool().release_unused()
    by = np.argsort(key, kind="stable")
    key, times = key[by], times[by]
    del by
    doc, feat = (key // len(names)).astype(np.int32), (key % len(names)).astype(np.int32)
    del key
    w = train(doc, feat, times, np.array(y), len(names))
    return {str(f): float(x) for f, x in zip(names, w) if x > 1e-3}


class Rates(dict):
    """Word -> rate under the weights; forgets everything when ``CACHE`` words are held."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        rate = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) >= CACHE:
            self.clear()
        self[word] = rate
        return rate


def sentences(text: str, rates: Rates) -> list[tuple[int, int, float]]:
    """(start, end, probability) of the sentences with evidence, in code points of the text, in order.

    Offsets are those of the text itself: each sentence is lower-cased on its own.
    """
    out = []
    for m in SENTENCE.finditer(text):
        r = sum(rates[w] for w in set(WORD.findall(m[0].lower())))
        if r > 0:
            out.append((m.start(), m.end(), 1 - float(np.exp(-r))))
    return out


def judged(text: str, rates: Rates) -> tuple[float, tuple[int, int, float], int]:
    """Document score, its worst sentence (first among equals), and how many sentences have evidence."""
    if not any(map(rates.__getitem__, WORD.findall(text.lower()))):
        return 0.0, (-1, -1, 0.0), 0
    found = sentences(text, rates)
    if not found:
        return 0.0, (-1, -1, 0.0), 0
    clean = float(np.prod([1 - p for _, _, p in found]))
    return 1 - clean, max(found, key=lambda s: (s[2], -s[0])), len(found)


def score(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_offending, worst_start, worst_end, worst_score) for every row.

    NULL and empty texts, and texts without a word, score 0 and have worst_start and worst_end -1. Repeated rows stay
    repeated. Columns other than id and text are not looked at.
    """
    name = uuid.uuid4().hex
    schema = f"{quoted(id_col)} {id_type(docs, id_col)}, score double, n_offending int, worst_start int, worst_end int, worst_score double"

    def make():
        rates = per_worker(f"rates {name}", lambda: Rates(weights))

        def scored(part):
            got = [judged(t, rates) for t in texts_of(part, text_col)]
            return pa.RecordBatch.from_arrays([part.column(id_col), pa.array([g[0] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[1][0] for g in got], pa.int32()), pa.array([g[1][1] for g in got], pa.int32()), pa.array([g[1][2] for g in got], pa.float64())], [id_col, "score", "n_offending", "worst_start", "worst_end", "worst_score"])

        return scored

    return map_slices(picked(docs, id_col, text_col), text_col, schema, make)


def keep_rows(docs: DataFrame, weights: dict[str, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score stays under the threshold."""
    name = uuid.uuid4().hex

    def run(batches):
        rates = per_worker(f"rates {name}", lambda: Rates(weights))
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array([judged(t, rates)[0] < threshold for t in texts_of(part, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights = fit(docs, labels, lambda c: fold(c, 3) != 1)
    out = score(docs, weights)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end", "worst_score")
