"""Exact Jaccard join of word-shingle sets with set-relation skipping (in the manner of Wang, Qin, Lin, Zhang, Chang 2017).

Two sets link when |A n B| * 5 >= |A u B| * 4. Equal sets are one node. The links of all nodes are found whole, but a link
between nodes already known to be connected is not looked for:

1. Answers from highly similar sets. Nodes that share a band of min-hashes meet a leader; their overlap with it is counted.
   Nodes that reach 0.4 with a common leader form a family. Within a family all overlaps are answered exactly, block against
   block: one set's overlaps with a block are counted from the index lists, those of the next, similar set are derived from
   them by the few shingles in which the two differ. Members linked to the family's main component are not compared with
   each other.
2. Index lists with skipping, for everything else. Shingles are ordered (frequent ones last, then by hash); each node enters
   the prefix of its set into the index. Entries of a list are cut into blocks by set size and by position, and only blocks
   that can still reach the threshold meet; lists that hold one node or one family are skipped whole. A parity bitmap gives
   an exact upper bound of the overlap; what passes is counted on the whole sets.

Only spanning links leave a block, never all pairs of a group. Texts are read once for each step; sets are sent only for
nodes that take part in a candidate. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import skew_join

from .common import byte_view, discard, id_type, per_worker, picked, quoted, slices, texts_of, written

SHINGLE = 5
#: Bands and min-hashes of a band (they only choose who is compared first), and the overlap that makes a family.
BANDS, ROWS = 8, 4
FAMILY = 0.4
#: Shingles of different sets that a task holds before it reports those met ``SEEN`` times; the ``HOT`` most frequent ones go
#: to the end of the order (any order gives the same links; this one keeps the lists short).
HELD, SEEN, HOT = 2_000_000, 3, 300_000
#: Shingles of one block of a family, and bits of the bitmap that chooses texts to read (both bound memory).
BLOCK = 200_000
#: Shingles of the smallest blocks into which a family is cut.
LEAST_BLOCK = 25_000
MOST_BITS = 1 << 28
#: Bits of a parity bitmap: a power of two, at least this and twice the set's size.
BITMAP = 1024
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for k, base in enumerate((_P, inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of five words; of fewer words, the whole run; without words none."""
    data, starts = byte_view(texts)
    if not data.size:
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(data.size + 1, dtype=bool)
    edge[starts] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    last = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    if not len(first):
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    up, down = _power(data.size)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    word = mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    where = np.searchsorted(first, starts)
    run = np.zeros(max(0, len(word) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        run = run * _P + word[k : len(word) - SHINGLE + 1 + k]
    run = mixed(run)
    out = []
    for a, b in zip(where[:-1], where[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(run[a : b - SHINGLE + 1]))
        elif b > a:
            h = word[a:b] * up[1 : b - a + 1]  # fewer words than a shingle: their number is part of the hash
            out.append(mixed(np.array([h.sum() ^ np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _node(s: np.ndarray, salt: int) -> tuple[int, bytes]:
    """Name of a set (64 bits) and a longer digest that shows whether two sets got the same name."""
    d = hashlib.blake2b(s.tobytes(), digest_size=24, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), d[8:]


def _seeds() -> np.ndarray:
    return mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _P)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys (sets x BANDS), and the words of the parity bitmaps of all (non-empty) sets with the place where each begins."""
    size = np.array([len(s) for s in sets])
    flat, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)[:-1]])
    low = np.stack([np.minimum.reduceat((flat ^ seed) * _P ^ (flat >> np.uint64(17)), first) for seed in _seeds()], axis=1)
    keys = low[:, 0::ROWS].copy()
    for k in range(1, ROWS):
        keys = mixed(keys * _P + low[:, k::ROWS])
    bits = np.maximum(BITMAP, 2 ** np.ceil(np.log2(2 * size)).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    bit = (flat * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)).astype(np.int64) & np.repeat(bits - 1, size)
    odd = (np.bincount(np.repeat(start[:-1], size) + bit, minlength=start[-1]) & 1).astype(np.uint8)
    return keys, np.packbits(odd, bitorder="little").view("<i8"), start >> 6


def described(docs: DataFrame, id_col: str, text_col: str, salt: int) -> DataFrame:
    """One row for each document (id, n, node, check, bands, bitmap), and rows (shingle, seen) of shingles frequent in a task."""
    schema = f"{quoted(id_col)} {id_type(docs, id_col)}, n long, node long, check binary, bands array<long>, bitmap array<long>, shingle long, seen long"
    names = [id_col, "n", "node", "check", "bands", "bitmap", "shingle", "seen"]

    def run(batches):
        per_worker("jaccard")
        held, names_held, size, kind = [], set(), 0, None

        def frequent():
            value, times = np.unique(np.concatenate(held), return_counts=True)
            value, times = value[times >= SEEN], times[times >= SEEN]
            held.clear()
            for at in range(0, len(value), 50_000):
                v, t = value[at : at + 50_000], times[at : at + 50_000]
                none = pa.nulls(len(v))
                yield pa.RecordBatch.from_arrays([none.cast(kind), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.list_(pa.int64())), none.cast(pa.list_(pa.int64())), pa.array(v.view(np.int64)), pa.array(t.astype(np.int64))], names)

        for batch in batches:
            for part in slices(batch, text_col):
                kind = part.column(id_col).type
                sets = shingle_sets(texts_of(part, text_col))
                full = [s for s in sets if len(s)]
                keys, maps, begin = signatures(full) if full else (None, None, None)
                at = np.cumsum([len(s) > 0 for s in sets]) - 1
                node = [_node(s, salt) if len(s) else (None, None) for s in sets]
                none = pa.nulls(len(sets)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in node], pa.int64()), pa.array([x[1] for x in node], pa.binary()),
                        pa.array([keys[k].view(np.int64) if len(s) else None for k, s in zip(at, sets)], pa.list_(pa.int64())), pa.array([maps[begin[k] : begin[k + 1]] if len(s) else None for k, s in zip(at, sets)], pa.list_(pa.int64())), none, none,
                    ],
                    names,
                )
                for s, x in zip(sets, node):
                    if len(s) and x[0] not in names_held:
                        names_held.add(x[0])
                        held.append(s)
                        size += len(s)
                if size >= HELD:
                    yield from frequent()
                    names_held.clear()
                    size = 0
        if held:
            yield from frequent()

    return picked(docs, id_col, text_col).mapInArrow(run, schema)


def entries(docs: DataFrame, text_col: str, hot, salt: int) -> DataFrame:
    """(shingle, node, n, pos) of the prefixes of all sets; a task enters a set that it has met lately only once."""

    def run(batches):
        per_worker("jaccard")
        late = np.sort(hot.value)
        met: set[int] = set()
        for batch in batches:
            for part in slices(batch, text_col):
                shingle, node, n, pos = [], [], [], []
                for s in shingle_sets(texts_of(part, text_col)):
                    if not len(s):
                        continue
                    name = _node(s, salt)[0]
                    if name in met:
                        continue
                    if len(met) >= 200_000:
                        met.clear()
                    met.add(name)
                    if len(late):
                        is_hot = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                        s = np.concatenate([s[~is_hot], s[is_hot]])
                    size = len(s)
                    p = size - (4 * size + 4) // 5 + 1
                    shingle.append(s[:p])
                    node.append(np.full(p, name, dtype=np.int64))
                    n.append(np.full(p, size, dtype=np.int32))
                    pos.append(np.arange(p, dtype=np.int32))
                if shingle:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([v.view(np.int64) for v in shingle], node, n, pos)], ["shingle", "node", "n", "pos"])

    return picked(docs, text_col).mapInArrow(run, "shingle long, node long, n int, pos int")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, salt: int) -> DataFrame:
    """(node, hashes) of the nodes in ``wanted`` (node, doc): a bitmap of the documents' hashes, at most ``MOST_BITS`` long,
    chooses the texts that are read; the join with ``wanted`` then takes exactly its nodes."""
    spark = docs.sparkSession
    bits = 1 << 16
    while bits < min(MOST_BITS, 16 * wanted.count()):
        bits *= 2
    at = F.xxhash64("doc").bitwiseAND(F.lit(bits - 1))
    found = wanted.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64(doc) & 63 as int))")).alias("b")).toArrow()
    bitmap = np.zeros(bits >> 6, dtype=np.int64)
    bitmap[found.column("w").to_numpy()] = found.column("b").to_numpy()
    bitmap = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            h = batch.column("_h").to_numpy(zero_copy_only=False) & (bits - 1)
            batch = batch.filter(pa.array((bitmap.value[h >> 6] >> (h & 63)) & 1 == 1))
            for part in slices(batch, "_t"):
                sets = shingle_sets(texts_of(part, "_t"))
                keep = [k for k, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(sets[k], salt)[0] for k in keep], pa.int64()), part.column("_d").take(pa.array(keep, pa.int64())), pa.array([sets[k].view(np.int64) for k in keep], pa.list_(pa.int64()))], ["node", "doc", "hashes"])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("_d"), F.xxhash64(F.col(quoted(id_col)).cast("long")).alias("_h"), F.col(quoted(text_col)).alias("_t"))
    got = rows.mapInArrow(run, "node long, doc long, hashes array<long>").join(wanted, ["node", "doc"], "left_semi")
    return written(got.dropDuplicates(["node"]).select("node", "hashes"), "jaccard-sets")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with both sizes and the overlap."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("_y")), "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("_x")), "a")
    return one.select("a", "b", F.size("_x").alias("na"), F.size("_y").alias("nb"), F.size(F.array_intersect("_x", "_y")).alias("o"))


LINK = "5 * o >= 4 * (na + nb - o)"


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``links`` (a, b): the least label reached. Every round contracts each node into its least
    neighbour; names are hashes, so few rounds are needed. Each round is stored."""
    edges, steps = written(links.select("a", "b").where("a != b").distinct(), "jaccard-edges"), []
    while not edges.isEmpty():
        if len(steps) > 60:
            raise RuntimeError("components did not converge")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "jaccard-step")
        steps.append(step)
        edges = edges.join(step.select(F.col("node").alias("a"), F.col("label").alias("_a")), "a").join(step.select(F.col("node").alias("b"), F.col("label").alias("_b")), "b")
        edges = written(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a != b").distinct(), "jaccard-edges")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    out = steps[0]
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("label"), F.col("label").alias("_next")), "label", "left").select("node", F.coalesce("_next", "label").alias("label"))
    return written(out, "jaccard-components")


def answer_block(x: list[np.ndarray], y: list[np.ndarray], cx: np.ndarray, cy: np.ndarray) -> list[tuple[int, int]]:
    """Links (index in x, index in y) that connect components not yet connected. Overlaps with the block ``y`` are counted from
    its index lists for one set and derived for the next from the shingles in which the two differ."""
    value = np.concatenate(y)
    owner = np.repeat(np.arange(len(y)), [len(s) for s in y])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    size = np.array([len(s) for s in y])
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    def listed(s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(value, s, "left"), np.searchsorted(value, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=len(y))

    base = counted = None
    out = []
    for i, s in enumerate(x):
        if base is not None and len(less := np.setdiff1d(base, s, assume_unique=True)) + len(more := np.setdiff1d(s, base, assume_unique=True)) < len(s):
            o = counted - listed(less) + listed(more)
        else:
            o = listed(s)
            base, counted = s, o
        for j in np.flatnonzero(5 * o >= 4 * (len(s) + size - o)):
            a, b = root(int(cx[i])), root(int(cy[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def answered_families(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within families, from ``members`` (fam, node, comp, main, n) and the sets (node, hashes) of the nodes.

    The members of a family outside its main component (its least label) are compared with all, those inside only with them.
    Both sides are dealt in blocks; every block outside meets every block of the family once, in a cell of its own. Members are
    dealt without their sets, which join by node afterwards, and cells are shuffled by one name of their own, so the cells of a
    large family spread over all tasks. A block holds at most about ``BLOCK`` shingles; smaller families are cut too, outside
    into up to four blocks and inside into blocks as large as those, ``LEAST_BLOCK`` at least, which copies no set more than a
    few times on average.
    """
    members = members.withColumn("out", (F.col("comp") != F.col("main")).cast("int"))
    load = members.groupBy("fam").agg(*[F.sum(F.when(F.col("out") == k, F.col("n")).otherwise(0)).alias(f"_s{k}") for k in (0, 1)]).where("_s1 > 0")
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.col("_s1") / 4))
    blocks = load.select("fam", F.ceil(F.col("_s1") / size).cast("int").alias("_b1"), F.ceil(F.col("_s0") / size).cast("int").alias("_b0"))
    rows = skew_join(members.select("fam", "node", "comp", "out"), blocks, ["fam"], "inner")
    rows = rows.withColumn("_k", F.pmod(F.xxhash64("node"), F.when(F.col("out") == 1, F.col("_b1")).otherwise(F.col("_b0"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda role, t, i, j: F.struct(F.lit(role).alias("role"), F.lit(t).alias("t"), i.alias("i"), j.alias("j"))
    one, many, own = F.col("_b1"), F.col("_b0"), F.col("_k")
    # the outer block i meets inner blocks (0, j) and outer blocks (1, j), i <= j; it is the left side (role 0) of both
    inner = F.transform(upto(one), lambda i: cell(1, 0, i, own))
    outer = F.concat(
        F.transform(upto(many), lambda j: cell(0, 0, own, j)),
        F.transform(F.filter(upto(one), lambda j: j >= own), lambda j: cell(0, 1, own, j)),
        F.transform(F.filter(upto(one), lambda i: i <= own), lambda i: cell(1, 1, i, own)),
    )
    dealt = rows.withColumn("_m", F.explode(F.when(F.col("out") == 0, inner).otherwise(outer)))
    dealt = dealt.select(F.concat_ws("/", "fam", "_m.t", "_m.i", "_m.j").alias("cell"), "_m.role", "node", "comp")

    def run(key, table):
        table = table.sort_by("node")
        role = table.column("role").to_numpy()
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        flat = table.column("hashes").combine_chunks()
        ends = flat.offsets.to_numpy()
        value = flat.values.to_numpy().view(np.uint64)
        sets = [value[a:b] for a, b in zip(ends[:-1], ends[1:])]
        x, y = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        got = answer_block([sets[k] for k in x], [sets[k] for k in y], comp[x], comp[y]) if len(x) and len(y) else []
        return pa.table({"a": pa.array([int(node[x[i]]) for i, _ in got], pa.int64()), "b": pa.array([int(node[y[j]]) for _, j in got], pa.int64())})

    return dealt.join(sets, "node").groupBy("cell").applyInArrow(run, "a long, b long")


def listed_pairs(listed: DataFrame, family: DataFrame) -> DataFrame:
    """Candidates (a, b) of different families, a the smaller set, from index entries (shingle, node, n, pos).

    The smaller set of a linked pair shares a shingle within the shorter, the larger within the longer prefix; sizes differ by
    a quarter at most, so a list's size blocks meet only themselves and the next. Entries beyond these positions are skipped.
    """
    alone = listed.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("shingle")
    shared = listed.join(alone, "shingle", "left_semi").distinct()
    shared = written(shared.join(family, "node", "left").withColumn("fam", F.coalesce("fam", "node")), "jaccard-lists")
    mixed_lists = shared.groupBy("shingle").agg(F.min("fam").alias("lo"), F.max("fam").alias("hi")).where("lo != hi").select("shingle")
    rows = shared.join(mixed_lists, "shingle", "left_semi").withColumn("blk", F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25)) + 1e-9).cast("int"))
    small = rows.where("pos < n - (8 * n + 8) div 9 + 1").withColumn("blk", F.explode(F.array(F.col("blk"), F.col("blk") + 1)))
    one = small.select("shingle", "blk", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("fam").alias("fa"))
    two = rows.select("shingle", "blk", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("fam").alias("fb"))
    met = one.join(two, ["shingle", "blk"]).where("fa != fb and na <= nb and 5 * na >= 4 * nb and (na < nb or a < b)")
    return met.where("least(pa, pb) + least(na - pa, nb - pb) >= (4 * (na + nb) + 8) div 9").select("a", "b", "na", "nb").distinct()


def classified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """The table of documents (id, n, node), the nodes with their class (node, doc, class: the least id reached), and the salt
    of the nodes' names."""
    rows = picked(docs, id_col, text_col).withColumn(id_col, F.col(quoted(id_col)).cast("long"))
    spark, salt = docs.sparkSession, 0
    while True:
        table = written(described(rows, id_col, text_col, salt), "jaccard-documents")
        known = table.where(f"node is not null and {quoted(id_col)} is not null")
        nodes = written(known.groupBy("node").agg(F.min(id_col).alias("doc"), F.max("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.max("bands").alias("bands"), F.max("bitmap").alias("bitmap")), "jaccard-nodes")
        if nodes.where("lo != hi").isEmpty():
            break
        salt += 1  # two sets got one name: name all anew
    texts = rows.where(F.col(quoted(id_col)).isNotNull())

    # 1. leaders of bands, families, and the answers within them
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    leaders = banded.groupBy("band", "key").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a != hi").drop("hi")
    stars = written(banded.join(leaders, ["band", "key"]).where("node != a").select("a", F.col("node").alias("b")).distinct(), "jaccard-stars")
    wanted = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "doc"), "node")
    sets = sets_of(texts, wanted, id_col, text_col, salt)
    counted = written(overlaps(stars, sets), "jaccard-stars-counted")
    links = counted.where(LINK).select("a", "b")
    near = counted.where(f"o >= {FAMILY} * (na + nb - o)").select("a", "b")
    family = components(near).withColumnRenamed("label", "fam")
    label = components(links).withColumnRenamed("label", "comp")
    members = family.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # the main component of a family: the one with most members, the least label among equals
    main = members.groupBy("fam", "comp").count().groupBy("fam").agg(F.max_by("comp", F.struct(F.col("count"), -F.xxhash64("comp").bitwiseAND(F.lit(0xFFFFFF)))).alias("main"))
    members = skew_join(members.join(nodes.select("node", "n"), "node"), main, ["fam"], "inner")
    inside = answered_families(written(members, "jaccard-members"), sets)
    links = written(links.unionByName(inside), "jaccard-links")

    # 2. index lists for pairs of different families
    hot = table.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "shingle").limit(HOT)
    late = spark.sparkContext.broadcast(hot.select("shingle").toArrow().column("shingle").to_numpy().view(np.uint64))  # HOT numbers at most
    listed = written(entries(texts, text_col, late, salt), "jaccard-entries")
    pairs = written(listed_pairs(listed, family), "jaccard-candidates")
    discard(listed)
    maps = nodes.select("node", "bitmap")
    pairs = pairs.join(maps.select(F.col("node").alias("a"), F.col("bitmap").alias("_x")), "a").join(maps.select(F.col("node").alias("b"), F.col("bitmap").alias("_y")), "b")
    # sizes differ by a quarter at most, so bitmaps by one doubling; the halves of the longer one make one of the other's length
    halved = lambda c, n: F.zip_with(F.slice(c, 1, n), F.slice(c, n + 1, n), lambda x, y: x.bitwiseXOR(y))
    alike = lambda c, n: F.when(F.size(c) > n, halved(c, n)).otherwise(F.col(c))
    short = F.least(F.size("_x"), F.size("_y"))
    apart = F.aggregate(F.zip_with(alike("_x", short), alike("_y", short), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = written(pairs.withColumn("_most", F.floor((F.col("na") + F.col("nb") - apart) / 2)).where("9 * _most >= 4 * (na + nb)").select("a", "b"), "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "doc"), "node")
    across = overlaps(pairs, sets_of(texts, wanted, id_col, text_col, salt)).where(LINK).select("a", "b")

    # 3. classes
    label = components(links.unionByName(across))
    least = label.join(nodes.select("node", "doc"), "node").groupBy("label").agg(F.min("doc").alias("_least"))
    found = nodes.select("node", "doc").join(label.join(least, "label").select("node", "_least"), "node", "left").select("node", F.coalesce("_least", "doc").alias("_class"), "doc")
    return table.where("n is not null").select(quoted(id_col), "n", "node"), found, salt


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: set size, and the smallest id of its connected class.

    NULL and empty texts, and texts without a word, have an empty set, link with nothing and are their own class, repeated or
    not. A row with a NULL id has its set's size and no class (NULL), and joins nothing. Rows that repeat an id and a text stay
    repeated; rows of one id with different texts are different sets and may fall into different classes.
    """
    table, found, _ = classified(docs, id_col, text_col)
    own = F.col(quoted(id_col))
    out = skew_join(table, found, ["node"])  # a third of the documents may be copies of one text
    return out.select(own, F.col("n").alias("n_shingles"), F.when(own.isNotNull(), F.coalesce("_class", own)).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stay: of every class the document with the smallest id, once.

    Rows without a class (empty sets, NULL ids) all stay. Of rows that repeat the id and the text that stays, one stays.
    """
    table, found, salt = classified(docs, id_col, text_col)
    kept = written(found.groupBy("_class").agg(F.min(F.struct("doc", "node")).alias("_k")).select(F.col("_k.doc").alias("_doc"), F.col("_k.node").alias("_node")), "jaccard-kept")
    again = table.where("node is not null").groupBy(F.col(quoted(id_col)).alias("_doc"), F.col("node").alias("_node")).count().where("count > 1").drop("count")
    again = written(again.join(kept, ["_doc", "_node"], "left_semi"), "jaccard-again")
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                node = [_node(s, salt)[0] if len(s) else None for s in shingle_sets(texts_of(part, text_col))]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(part.columns, part.schema.names), part.column(id_col).cast(pa.int64()), pa.array(node, pa.int64())], ["_row", "_doc", "_node"])

    rows = docs.mapInArrow(run, f"_row struct<{fields.replace('` ', '`: ')}>, _doc long, _node long")
    free = rows.where("_doc is null or _node is null")
    own = rows.where("_doc is not null and _node is not null").join(kept, ["_doc", "_node"], "left_semi")
    if not again.isEmpty():
        twice = own.join(again, ["_doc", "_node"], "left_semi").dropDuplicates(["_doc", "_node"])
        own = own.join(again, ["_doc", "_node"], "left_anti").unionByName(twice)
    return free.unionByName(own).select("_row.*")


def op4(spark, docs: DataFrame) -> DataFrame:
    return classes(docs)
