"""Language-model scores: a log-bilinear neural model (vLBL, Mnih and Kavukcuoglu 2013) trained with noise-contrastive estimation.

Tokens are counted over the whole training fold. The most frequent words are outputs of the network, all others fall into
classes by a hash of their last bytes; the network predicts word or class from the ``ORDER`` outputs before it, and a word
within its class has the probability (c + 1) / Z of its exact corpus count (one unit of Z is kept for unseen words), so every
text has a normalised probability. Training reads every token of the fold once. The tokens are dealt at random into shards of
about ``SHARD`` tokens, whatever files or partitions the texts come in, and ``ROUND_SHARDS`` shards make a round: each shard runs
stochastic gradient steps from the common parameters, which are then averaged, with their step sizes, weighted by tokens. The
number of rounds follows the number of tokens, so a larger corpus takes proportionally more steps one after another.

Scoring looks counts up locally for the ``LOCAL`` most frequent words (a fixed number, broadcast); every other word of every
text goes through a join with the table of all counts. The exponential of a sum is a product, so the normalisers of all contexts
after one output are one matrix product.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, id_type, per_worker, picked, quoted, slices, written

ORDER = 2
DIM = 32
WORDS = 3968
CLASSES = 128
OUT = WORDS + CLASSES
LOCAL = 200_000
NOISE = 24
BATCH = 1024
#: Tokens of a shard, shards of a round, and tokens of the longest stored piece of a text.
SHARD = 1 << 20
ROUND_SHARDS = 12
PIECE = 1 << 16
#: Distinct words that a task counts before it passes the counts on.
HELD = 300_000
#: Texts of one step of a task, in bytes.
PART = 4 << 20


def tokenised(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts (lower-cased A-Z, between the six ASCII white-space characters), the word at each place, and
    each text's number of words; the end tokens are not among them. NULL reads as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
        flat = flat.filter(pa.array(full))
    found = flat.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes


def _crc_table() -> np.ndarray:
    """The step table of the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_TABLE = _crc_table()


def classes_of(words: pa.Array) -> np.ndarray:
    """crc32 of the last three bytes of each word (fewer, if it has fewer) modulo ``CLASSES``."""
    words = pa.concat_arrays([words.cast(pa.large_string())])  # offsets from 0
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, dtype=np.uint32)
    for back in (3, 2, 1):
        at = ends[1:] - back
        own = at >= ends[:-1]
        byte = data[np.where(own, at, 0)] if len(data) else np.zeros(len(words), dtype=np.uint8)
        crc = np.where(own, _TABLE[(crc ^ byte) & 0xFF] ^ (crc >> np.uint32(8)), crc)
    return ((crc ^ np.uint32(0xFFFFFFFF)) % CLASSES).astype(np.int64)


def counts(train: DataFrame, text_col: str) -> DataFrame:
    """(token, c) over all texts; the end token is the empty string. Each task adds up before the shuffle."""

    def run(batches):
        held: dict[str, int] = {}

        def out():
            table = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])
            held.clear()
            return [table.slice(k, 20_000) for k in range(0, table.num_rows, 20_000)]

        get = held.get
        for batch in batches:
            for part in slices(batch, text_col, PART):
                words, at, _ = tokenised(part.column(text_col))
                held[""] = get("", 0) + part.num_rows
                for w, n in zip(words.to_numpy(zero_copy_only=False).tolist(), np.bincount(at, minlength=len(words)).tolist()):
                    held[w] = get(w, 0) + n
                if len(held) >= HELD:
                    yield from out()
        yield from out()

    return picked(train, text_col).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


class Vocabulary:
    """What a task needs to turn words into outputs: the local words with their counts, and the classes' totals."""

    def __init__(self, local: list[tuple[str, int]], totals: np.ndarray):
        self.n = len(local)
        self.words = pa.array([t for t, _ in local], pa.string())
        self.logc = np.append(np.log10(np.array([c for _, c in local], dtype=np.float64) + 1), 0.0)
        self.out = np.append(np.where(np.arange(self.n) < WORDS, np.arange(self.n), WORDS + classes_of(self.words)), 0)
        self.logz = np.log10(totals)

    def place(self, words: pa.Array) -> np.ndarray:
        """Index of local words; ``n + 1 + class`` for the others."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rare = np.flatnonzero(at < 0)
        at[rare] = self.n + 1 + classes_of(words.take(pa.array(rare)))
        return at

    def outputs(self, place: np.ndarray) -> np.ndarray:
        return np.where(place > self.n, WORDS + place - self.n - 1, self.out[np.minimum(place, self.n)])

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Places of all tokens of the texts, one text after another, each closed by its end token; the texts' first positions;
        the distinct words (the end token last) and the word at each position."""
        words, at, sizes = tokenised(column)
        words = pa.concat_arrays([words, pa.array([""], words.type)])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        word = np.full(starts[-1], len(words) - 1, dtype=np.int64)
        word[np.arange(len(at)) + np.repeat(np.arange(len(sizes)), sizes)] = at
        return self.place(words)[word], starts[:-1], words, word


def contexts(out: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two outputs before each position (``OUT`` before a text's first); ``starts`` are the texts' first positions."""
    one, two = np.empty_like(out), np.empty_like(out)
    one[1:], two[2:] = out[:-1], out[:-2]
    one[starts] = OUT
    two[starts] = OUT
    second = starts + 1
    two[second[second < len(out)]] = OUT
    return one, two


def start(unigram: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"R": rng.normal(0, 0.1, (OUT + 1, DIM)), "Q": rng.normal(0, 0.1, (OUT, DIM)), "c": np.ones((ORDER, DIM)), "b": np.log(unigram)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices, and the sum of the value rows of each."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """NCE steps (Adagrad): each token against ``NOISE`` outputs drawn from the unigram distribution, shared by the batch."""

    def __init__(self, p: dict, unigram: np.ndarray, seed: int, seen: dict | None = None):
        self.p = {k: v.copy() for k, v in p.items()}
        self.seen = {k: v.copy() for k, v in seen.items()} if seen else {k: np.full_like(v, 1e-3) for k, v in p.items()}
        self.cum, self.logn = np.cumsum(unigram), np.log(unigram * NOISE).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray, rate: float = 0.2) -> None:
        p, m = self.p, len(w)
        r1, r2 = p["R"][one], p["R"][two]
        q = p["c"][0] * r1 + p["c"][1] * r2
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE) * self.cum[-1]), OUT - 1)
        qw = p["Q"][w]
        good = (q * qw).sum(1) + p["b"][w] - self.logn[w]
        bad = q @ p["Q"][noise].T + (p["b"] - self.logn)[noise]
        eg = -1 / (1 + np.exp(np.clip(good, -30, 30)))
        eb = 1 / (1 + np.exp(-np.clip(bad, -30, 30)))
        dq = eg[:, None] * qw + eb @ p["Q"][noise]
        some = np.concatenate([w, noise])
        self.move("Q", *_summed(some, np.concatenate([eg[:, None] * q, eb.T @ q])), m, rate)
        self.move("R", *_summed(np.concatenate([one, two]), np.concatenate([dq * p["c"][0], dq * p["c"][1]])), m, rate)
        self.move("b", slice(None), np.bincount(some, np.concatenate([eg, eb.sum(0)]), minlength=OUT), m, rate)
        self.move("c", slice(None), np.stack([(dq * r1).sum(0), (dq * r2).sum(0)]), m, rate)
        self.tokens += m


    def move(self, name: str, rows, slope: np.ndarray, m: int, rate: float) -> None:
        slope = slope.astype(np.float32) / m
        seen = self.seen[name][rows] + slope * slope
        self.seen[name][rows] = seen
        self.p[name][rows] -= rate * slope / np.sqrt(seen)


def pieces(out: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The texts' outputs as little-endian 16-bit numbers, in pieces of at most ``PIECE``, each after its two context outputs."""
    one, two = contexts(out, starts)
    sizes = np.diff(np.append(starts, len(out)))
    parts = -(-sizes // PIECE)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(starts, parts) + nth * PIECE
    length = np.minimum(np.repeat(sizes, parts) - nth * PIECE, PIECE)
    ends = np.cumsum(length + 2)
    first = ends - length - 2
    data = np.empty(ends[-1], dtype="<u2")
    data[np.arange(len(out)) + 2 * np.repeat(np.arange(1, len(begin) + 1), length)] = out
    data[first], data[first + 1] = two[begin], one[begin]
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(data)])


def dealt(docs: DataFrame, vocabulary, text_col: str, shards: int, rounds: int) -> DataFrame:
    """(shard, at, outs, round): all pieces of all texts, stored, each in a shard drawn at random; ``at`` orders a shard's pieces."""

    def run(batches):
        v, task = vocabulary.value, TaskContext.get().partitionId()
        rng, row = np.random.default_rng(task), task << 33
        for batch in batches:
            for part in slices(batch, text_col, PART):
                place, starts, _, _ = v.read(part.column(text_col))
                outs = pieces(v.outputs(place), starts)
                shard = rng.integers(0, shards, len(outs))
                yield pa.RecordBatch.from_arrays([pa.array(shard // rounds, pa.int32()), pa.array(np.arange(row, row + len(outs))), outs, pa.array(shard % rounds, pa.int32())], ["shard", "at", "outs", "round"])
                row += len(outs)

    found = picked(docs, text_col).mapInArrow(run, "shard int, at long, outs binary, round int")
    return written(found.repartition("round", "shard"), "lm-shards", "round")


def train(docs: DataFrame, vocabulary, unigram: np.ndarray, text_col: str, tokens: int) -> dict[str, np.ndarray]:
    """Parameters after every one of the ``tokens`` tokens was trained on. One row for each shard of a round comes to the driver."""
    p, seen = start(unigram), None
    if not tokens:
        return p
    shards = -(-tokens // SHARD)
    rounds = -(-shards // ROUND_SHARDS)
    stored = dealt(docs, vocabulary, text_col, shards, rounds)
    names = list(p)

    def steps(sent, k):
        def run(key, table):
            t = Trainer(sent.value[0], unigram, ROUND_SHARDS * k + key[0].as_py(), sent.value[1])
            rows = [np.frombuffer(x, dtype="<u2").astype(np.int64) for x in table.sort_by("at").column("outs").to_pylist()]
            kept = [np.concatenate(x) for x in zip(*((r[2:], r[1:-1], r[:-2]) for r in rows))]
            for at in range(0, len(kept[0]), BATCH):
                t.step(*(x[at : at + BATCH] for x in kept))
            made = [b"".join(x[name].tobytes() for name in names) for x in (t.p, t.seen)]
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([t.tokens], pa.int64()), "p": pa.array(made[:1], pa.binary()), "seen": pa.array(made[1:], pa.binary())})

        return run

    for k in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((p, seen))
        got = stored.where(F.col("round") == k).select("shard", "at", "outs").groupBy("shard").applyInArrow(steps(sent, k), "shard int, n long, p binary, seen binary").toArrow().sort_by("shard")
        sent.unpersist()
        if not got.num_rows:
            continue
        n = got.column("n").to_numpy().astype(np.float64)
        mean = lambda name: sum(np.frombuffer(x.as_buffer(), dtype=np.float32) * w for x, w in zip(got.column(name), n / n.sum()))
        cuts = np.cumsum([v.size for v in p.values()])[:-1]
        shaped = lambda flat: {name: x.reshape(v.shape).astype(np.float32) for (name, v), x in zip(p.items(), np.split(flat, cuts))}
        p, seen = shaped(mean("p")), shaped(mean("seen"))
    discard(stored)
    return p


class Scorer:
    """Normalised log10 probabilities; the normalisers of the contexts met are kept (``(OUT + 1) ** 2`` numbers at most)."""

    def __init__(self, p: dict):
        self.a = [p["c"][i] * p["R"] for i in range(ORDER)]
        self.Q, self.b = p["Q"], p["b"]
        self.norm = np.full((OUT + 1) * (OUT + 1), np.nan, dtype=np.float32)
        self.met = np.zeros(OUT + 1, dtype=bool)
        far = self.a[1] @ self.Q.T
        self.top = far.max(1)
        self.far = np.exp(far - self.top[:, None])

    def fill(self, ones: np.ndarray) -> None:
        """Normalisers of all contexts whose last output is one of ``ones``; those too small for the product stay NaN."""
        near = self.a[0][ones] @ self.Q.T + self.b
        top = near.max(1)
        z = np.exp(near - top[:, None]) @ self.far.T
        z[z < 1e-20] = np.nan
        self.norm.reshape(OUT + 1, OUT + 1)[ones] = np.log(z) + top[:, None] + self.top
        self.met[ones] = True

    def logs(self, out: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        ones = np.unique(one)
        ones = ones[~self.met[ones]]
        for at in range(0, len(ones), 512):
            self.fill(ones[at : at + 512])
        code = one * (OUT + 1) + two
        new = np.unique(code[np.isnan(self.norm[code])])
        for at in range(0, len(new), 1024):
            c = new[at : at + 1024]
            s = (self.a[0][c // (OUT + 1)] + self.a[1][c % (OUT + 1)]) @ self.Q.T + self.b
            top = s.max(1)
            self.norm[c] = top + np.log(np.exp(s - top[:, None]).sum(1))
        result = np.empty(len(out))
        for at in range(0, len(out), 65_536):
            w, x, y = out[at : at + 65_536], one[at : at + 65_536], two[at : at + 65_536]
            result[at : at + 65_536] = ((self.a[0][x] + self.a[1][y]) * self.Q[w]).sum(1) + self.b[w] - self.norm[code[at : at + 65_536]]
        return result / np.log(10)


def score(docs: DataFrame, keep, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from the rows for which ``keep`` holds.

    ``base_score`` is the add-one unigram score of the same counts. A NULL or empty text is the end token alone. Repeated rows
    stay repeated. Without any training row all counts are 0 and the network keeps its start.
    """
    spark = docs.sparkSession
    rows = picked(docs, id_col, text_col)
    training = rows.where(keep)
    table = written(counts(training, text_col), "lm-counts")
    total = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    N, V = int(total.n), int(total.v)
    local = [(r.token, r.c) for r in table.orderBy(F.desc("c"), "token").limit(LOCAL).toLocalIterator()]  # at most LOCAL words
    top = [t for t, _ in local[:WORDS]]
    rest = table.join(F.broadcast(spark.createDataFrame([(t,) for t in top], "token string")), "token", "left_anti")
    raw = F.encode("token", "UTF-8")
    last = F.substring(raw, F.greatest(F.lit(1), F.octet_length("token") - 2), F.lit(3))
    sums = {r.k: (r.c, r.v) for r in rest.groupBy((F.crc32(last) % CLASSES).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}  # CLASSES rows
    totals = np.array([sum(sums.get(k, (0, 0))) + 1.0 for k in range(CLASSES)])
    unigram = np.ones(OUT)
    unigram[: len(top)] += [c for _, c in local[:WORDS]]
    unigram[WORDS:] += [sums.get(k, (0, 0))[0] for k in range(CLASSES)]
    unigram[len(top) : WORDS] = 1e-6
    unigram /= unigram.sum()
    vocabulary = spark.sparkContext.broadcast(Vocabulary(local, totals))
    model = spark.sparkContext.broadcast(train(training, vocabulary, unigram, text_col, N))
    kind, name = id_type(docs, id_col), uuid.uuid4().hex

    def run(batches):
        v, scorer = vocabulary.value, per_worker(f"scorer {name}", lambda: Scorer(model.value))  # its normalisers serve all tasks of the worker
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, text_col, PART):
                place, starts, words, word = v.read(part.column(text_col))
                out = v.outputs(place)
                sizes = np.diff(np.append(starts, len(place)))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                logs = scorer.logs(out, *contexts(out, starts))
                here = place < v.n
                logc = v.logc[np.minimum(place, v.n)] * here
                inner = np.where(out >= WORDS, logc - v.logz[np.maximum(0, out - WORDS)], 0.0)
                add = lambda x: np.bincount(owner, x, minlength=len(sizes))
                ids = np.arange(row, row + len(sizes))
                row += len(sizes)
                none = pa.nulls(len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), part.column(id_col), none.cast(pa.string()), none.cast(pa.int64()), pa.array(sizes), pa.array(add(here).astype(np.int64)), pa.array(add(logc)), pa.array(add(logs + inner))],
                    ["row", id_col, "token", "n", "n_tokens", "known", "logc", "model"],
                )
                rare, times = np.unique((owner * len(words) + word)[~here], return_counts=True)
                for at in range(0, len(rare), 50_000):
                    some = rare[at : at + 50_000]
                    none = pa.nulls(len(some))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[some // len(words)]), none.cast(part.column(id_col).type), words.take(pa.array(some % len(words))), pa.array(times[at : at + 50_000].astype(np.int64)), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.float64())],
                        ["row", id_col, "token", "n", "n_tokens", "known", "logc", "model"],
                    )

    found = written(rows.mapInArrow(run, f"row long, {quoted(id_col)} {kind}, token string, n long, n_tokens long, known long, logc double, model double"), "lm-scores")
    rare = found.where("token is not null").select("row", "token", "n").join(table, "token").groupBy("row").agg(F.sum("n").alias("_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_logc"))
    whole = found.where("token is null").join(rare, "row", "left")
    more, known = F.coalesce("_logc", F.lit(0.0)), F.coalesce("_known", F.lit(0).cast("long"))
    return whole.select(quoted(id_col), "n_tokens", (F.col("known") + known).alias("n_known"), F.lit(N).cast("long").alias("train_tokens"), (F.col("logc") + more - F.col("n_tokens") * F.lit(float(np.log10(N + V + 1)))).alias("base_score"), (F.col("model") + more).alias("score"))


def op3(spark, docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    out = score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
