"""Quality classifier: gated-attention multiple-instance learning over passages (Ilse et al. 2018), trained in numpy.

Every document is a bag of passages of ``PASSAGE`` bytes of its whole text. A passage becomes a vector of byte-class pair
frequencies, hashed byte-trigram frequencies and two spread measures; an encoder layer maps it to ``HIDDEN`` values, a
gated attention weighs the passages of the document, and the weighted sum gives the score. Only document labels are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, fold, id_type, map_slices, per_worker, picked, quoted, slices, texts_of, written

PASSAGE = 512
HIDDEN = 24
ATTENTION = 12
BUCKETS = 96
#: Hash values of byte trigrams; ten share a bucket.
TRIGRAMS = BUCKETS * 10
THRESHOLD = 0.7
#: Bounds of the training sample: documents, passages in all, and the share of the passages that one document may take.
#: Labelled rows are taken in the order of a hash of the id.
SAMPLE_DOCS = 3000
SAMPLE_PASSAGES = 40_000
SAMPLE_SHARE = 16


def _classes() -> np.ndarray:
    """Byte -> one of 14 classes."""
    c = np.full(256, 13, dtype=np.int64)
    c[128:192], c[192:] = 11, 12
    for k, chars in enumerate([b" ", b"\n\r", b"\t\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:", b"!?", b"'\"()-", b"#$%&*@|\\/<>{}[]~^_+="]):
        c[list(chars)] = k
    return c


CLASSES = _classes()
N_CLASS = 14
WIDTH = N_CLASS * N_CLASS + BUCKETS + 2


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and for every text its number of passages (1 with zeros for an empty text)."""
    data, starts = byte_view(texts)
    sizes = np.diff(starts)
    count = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    out = np.zeros((n, WIDTH), dtype=np.float32)
    if data.size:
        owner = np.repeat(np.arange(len(texts)), sizes)
        at = (first[owner] + (np.arange(data.size) - starts[owner]) // PASSAGE).astype(np.int64)
        cls = CLASSES[data]
        same = at[1:] == at[:-1]
        pairs = (at[:-1] * (N_CLASS * N_CLASS) + cls[:-1] * N_CLASS + cls[1:])[same]
        out[:, : N_CLASS * N_CLASS] = np.bincount(pairs, minlength=n * N_CLASS * N_CLASS).reshape(n, -1)
        if data.size > 2:
            wide = data.astype(np.uint32)
            gram = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)
            keep = at[2:] == at[:-2]
            fine = (at[:-2] * TRIGRAMS + (gram % TRIGRAMS).astype(np.int64))[keep]
            fine = np.bincount(fine, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
            total = np.maximum(1, fine.sum(1))
            out[:, N_CLASS * N_CLASS : WIDTH - 2] = fine.reshape(n, BUCKETS, -1).sum(2) / total[:, None]
            out[:, WIDTH - 2] = (fine > 0).sum(1) / np.minimum(total, TRIGRAMS)
            out[:, WIDTH - 1] = fine.max(1) / total
        total = np.maximum(1, out[:, : N_CLASS * N_CLASS].sum(1))
        out[:, : N_CLASS * N_CLASS] /= total[:, None]
    return out, count


def forward(p: dict, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, dict]:
    """Document probabilities, and what the gradient needs."""
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    owner = np.repeat(np.arange(len(count)), count)
    h = np.tanh(((x - p["mean"]) / p["std"]) @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[owner])
    a = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    return y, {"h": h, "t": t, "s": s, "a": a, "z": z, "owner": owner, "first": first}


def _fixed(x: np.ndarray, bits: int, limit: float) -> np.ndarray:
    """Multiples of 2**-bits within +-limit, as doubles: sums of their products have no rounding, whatever their order."""
    return np.clip(np.rint(x.astype(np.float64) * 2.0**bits), -limit * 2.0**bits, limit * 2.0**bits) * 2.0**-bits


def judged(p: dict, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document probabilities and, for each document, its passage of the largest attention weight (the first among equals).

    The same network as ``forward``, with every factor of a sum rounded to so few bits that the sum is exact in a double. So a
    score depends on the text alone, not on what else is in the batch. (For documents of up to 2**18 passages.)
    """
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    owner = np.repeat(np.arange(len(count)), count)
    weight = lambda name: _fixed(p[name], 16, 16)
    h = np.tanh(_fixed((x.astype(np.float64) - p["mean"]) / p["std"], 12, 1024) @ weight("W") + weight("b"))
    fine = _fixed(h, 20, 1)
    e = _fixed(np.tanh(fine @ weight("V")) / (1 + np.exp(-(fine @ weight("U")))), 20, 1) @ weight("w")
    a = _fixed(np.exp(e - np.maximum.reduceat(e, first)[owner]), 20, 1)
    z = np.add.reduceat(a[:, None] * _fixed(h, 14, 1), first, axis=0) / np.add.reduceat(a, first)[:, None]
    y = 1 / (1 + np.exp(-np.clip(_fixed(z, 20, 1) @ weight("c") + weight("d"), -30, 30)))
    best = np.lexsort((np.arange(len(e)), -e, owner))[first]
    return y, best - first


def train(x: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = 30, seed: int = 11) -> dict:
    """Adam on the cross entropy of the document labels; ``y`` may lie between 0 and 1 where labels of a document differ."""
    rng = np.random.default_rng(seed)
    p = {"mean": x.mean(0), "std": x.std(0) + 1e-3, "W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION), "c": np.zeros(HIDDEN), "d": np.array(np.log((y.mean() + 0.01) / (1.01 - y.mean())))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    learned = [k for k in p if k not in ("mean", "std")]
    m, v = ({k: np.zeros_like(p[k]) for k in learned} for _ in range(2))
    starts, step = np.concatenate([[0], np.cumsum(count)]), 0
    for epoch in range(epochs):
        order = rng.permutation(len(count))
        for k in range(0, len(order), 64):
            docs = order[k : k + 64]
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in docs])
            n, xb = count[docs], x[rows]
            out, c = forward(p, xb, n)
            err = ((out - y[docs]) / len(docs)).astype(np.float32)
            dz = err[:, None] * p["c"]
            own = c["owner"]
            da = (dz[own] * c["h"]).sum(1)
            de = c["a"] * (da - np.add.reduceat(c["a"] * da, c["first"])[own])
            dt, ds = de[:, None] * p["w"] * c["s"] * (1 - c["t"] ** 2), de[:, None] * p["w"] * c["t"] * c["s"] * (1 - c["s"])
            dh = c["a"][:, None] * dz[own] + dt @ p["V"].T + ds @ p["U"].T
            du = dh * (1 - c["h"] ** 2)
            g = {"c": c["z"].T @ err, "d": err.sum(), "w": (c["t"] * c["s"]).T @ de, "V": c["h"].T @ dt, "U": c["h"].T @ ds, "W": ((xb - p["mean"]) / p["std"]).T @ du, "b": du.sum(0)}
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for name in learned:
                grad = g[name] + 1e-4 * p[name]
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad * grad
                p[name] = (p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def label_sample(labels: DataFrame, label: str, id_col: str, keep, limit: int, having: str = "true") -> DataFrame:
    """At most ``limit`` labelled ids of the training fold ``having`` such a label (_y), in the order of a hash of the id: (id, label).

    Labels of a repeated id are averaged; NULL ids and NULL labels are left out. The result is bounded by ``limit`` rows.
    """
    one = picked(labels, id_col, label).toDF("_id", "_y").withColumn("_y", F.col("_y").cast("double")).where("_id is not null and _y is not null")
    one = one.where(keep("_id")).groupBy("_id").agg(F.avg("_y").alias("_y")).where(having)
    return one.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> dict | None:
    """The model, from at most ``sample_docs`` labelled documents for which ``keep(id column)`` holds.

    Labels of absent documents take no place in the sample. Passage vectors are made on the executors; documents of more than one
    ``SAMPLE_SHARE``-th of ``sample_passages`` are passed over. The driver gets at most ``sample_docs`` bags and takes them in the same hash
    order, passing over those that no longer fit into ``sample_passages``. None if there is no labelled document.
    """
    there = picked(docs, id_col).toDF("_there").where(F.col("_there").isNotNull())
    known = picked(labels, id_col, label).toDF(id_col, label)
    known = known.join(there, F.col(quoted(id_col)) == F.col("_there"), "left_semi")
    ids = label_sample(known, label, id_col, keep, sample_docs)
    rows = picked(docs, id_col, text_col).toDF("_id", "_t").join(F.broadcast(ids), "_id")
    rows = rows.where(F.octet_length(F.coalesce("_t", F.lit(""))) <= sample_passages // SAMPLE_SHARE * PASSAGE).select("_id", "_y", "_t")

    def make():
        per_worker("quality")

        def bags(part):
            x, count = passages(texts_of(part, "_t"))
            first = np.concatenate([[0], np.cumsum(count)])
            return pa.RecordBatch.from_arrays([part.column("_id").cast(pa.string()), part.column("_y"), pa.array([x[first[i] : first[i + 1]].astype(np.float16).tobytes() for i in range(len(count))], pa.binary())], ["id", "y", "bag"])

        return bags

    found = written(map_slices(rows, "_t", "id string, y double, bag binary", make), "quality-bags")
    total, x, y = 0, [], []
    for r in found.orderBy(F.xxhash64("id"), "id", "bag").limit(sample_docs).collect():
        bag = np.frombuffer(r.bag, dtype=np.float16).astype(np.float32).reshape(-1, WIDTH)
        if total + len(bag) > sample_passages:
            continue
        total += len(bag)
        x.append(bag)
        y.append(r.y)
    if not x:
        return None
    return train(np.concatenate(x), np.array([len(b) for b in x]), np.array(y))


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_passages, top_passage): probability of label 1 and the passage of the largest attention weight, for every row.

    NULL and empty texts are one passage of zeros and get that passage's score. Without a model the score is 0.5. Repeated
    rows stay repeated and equal texts score alike. Columns other than id and text are not looked at.
    """
    schema = f"{quoted(id_col)} {id_type(docs, id_col)}, score double, n_passages int, top_passage int"

    def make():
        per_worker("quality")

        def scored(part):
            x, count = passages(texts_of(part, text_col))
            if model is None:
                y, top = np.full(len(count), 0.5), np.zeros(len(count), dtype=np.int32)
            else:
                y, top = judged(model, x, count)
            return pa.RecordBatch.from_arrays([part.column(id_col), pa.array(y.astype(np.float64)), pa.array(count.astype(np.int32)), pa.array(top.astype(np.int32))], [id_col, "score", "n_passages", "top_passage"])

        return scored

    return map_slices(picked(docs, id_col, text_col), text_col, schema, make)


def keep_rows(docs: DataFrame, model: dict | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches the threshold (all rows without a model)."""
    if model is None:
        return docs

    def run(batches):
        per_worker("quality")
        for batch in batches:
            for part in slices(batch, text_col):
                y, _ = judged(model, *passages(texts_of(part, text_col)))
                yield part.filter(pa.array(y >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, lambda c: fold(c, 4) != 2)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "top_passage")
