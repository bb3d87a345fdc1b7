"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

A vector x is scaled to length 1 and quantised to c = rint(u / s), s = max|u| / 127. What quantisation loses is measured, not estimated:
r = |u - s c|. For two vectors

    |u.v - (s c).(t d)| <= r_u |t d| + r_v

so the product of two int8 tiles says of almost every pair on which side of the threshold it lies. Pairs that may lie on
either side are computed again from the original vectors in double precision. Products of codes are sums of integers below 2^24
and therefore exact in float32 matrix products.

Vectors are sorted by their nearest pivot, so that tiles are narrow where the data are clustered; two tiles whose centres are
further apart than both radii and the threshold angle allow are not multiplied. The table is dealt into groups bounded in
bytes; every pair of groups is one partition, so a group of near copies of any size is spread over many tasks like any other
vectors. Only counts for each vector and a path through each connected part leave a task, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import skew_join

from .common import id_type, picked, quoted, written
from .jaccard import components

THRESHOLD = 0.9
TILE = 1_024
#: Bytes of one group (a task holds two), and the least number of groups.
GROUP_BYTES = 32 << 20
GROUPS = 8
#: Vectors of the sample that orders the tiles (it decides nothing else).
PIVOTS = 64
#: Above all rounding errors of the float32 scaling and of the residuals.
SLACK = 2e-6
#: Columns of a product whose sums stay exact in float32.
EXACT = 1_024


def directions(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component is divided out first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the quantised vectors and lengths of what was lost."""
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.sqrt((back * back).sum(1)), np.sqrt(((u - back) ** 2).sum(1))


class Tile:
    """Some rows of a group, ready for products."""

    def __init__(self, at: np.ndarray, x: np.ndarray):
        self.at, self.x, u = at, x, directions(x.astype(np.float64))
        self.unit = u
        self.codes, self.scale, self.length, self.lost = quantised(u)
        self.wide = self.codes.astype(np.float32)
        mean = u.mean(0)
        size = np.linalg.norm(mean)
        self.centre = mean / size if size > 1e-9 else u[0]
        self.radius = float(np.arccos(np.clip((u @ self.centre).min(), -1, 1)))


def product(a: Tile, b: Tile) -> np.ndarray:
    """Products of all codes, exact."""
    if a.wide.shape[1] <= EXACT:
        return a.wide @ b.wide.T
    out = np.zeros((len(a.at), len(b.at)))
    for k in range(0, a.wide.shape[1], EXACT):
        out += a.wide[:, k : k + EXACT] @ b.wide[:, k : k + EXACT].T
    return out


def links(a: Tile, b: Tile, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions (in a, in b) of all pairs whose cosine reaches the threshold, each pair once if ``a is b``; and the number of
    pairs computed again in double precision."""
    close = product(a, b)
    close *= b.scale.astype(close.dtype)
    least = (threshold - SLACK - b.lost.max() - a.lost * b.length.max()) / a.scale
    maybe = close >= (least - 1e-6 * np.abs(least))[:, None]
    if a is b:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    guess = close[i, j].astype(np.float64) * a.scale[i]
    error = a.lost[i] * b.length[j] + b.lost[j] + SLACK
    good = guess - error >= threshold
    unsure = np.flatnonzero(~good & (guess + error >= threshold))
    for k in range(0, len(unsure), 1 << 14):
        some = unsure[k : k + (1 << 14)]
        good[some] = np.einsum("ij,ij->i", a.unit[i[some]], b.unit[j[some]]) >= threshold
    return i[good], j[good], len(unsure)


def apart(a: Tile, b: Tile, threshold: float = THRESHOLD) -> bool:
    """True if no pair of the two tiles can reach the threshold."""
    return math.acos(min(1.0, max(-1.0, float(a.centre @ b.centre)))) - a.radius - b.radius > math.acos(min(1.0, max(-1.0, threshold))) + 1e-6


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the parts of i[k] and j[k] in a forest whose roots name themselves."""

    def root(x):
        while not np.array_equal(up := label[x], x):
            x = up
        return x

    while len(i):
        i, j = root(i), root(j)
        differ = i != j
        i, j = i[differ], j[differ]
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))


def _vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, _v, _ok): _ok vectors take part."""
    kind = table.schema[vec_col].dataType.simpleString()
    v = F.col(quoted(vec_col)) if kind in ("array<float>", "array<double>") else F.col(quoted(vec_col)).cast("array<double>")
    rows = picked(table, id_col, vec_col).select(F.col(quoted(id_col)).alias("_id"), v.alias("_v"))
    bad = F.exists("_v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return rows.withColumn("_ok", F.coalesce(~bad & F.exists("_v", lambda x: x != 0), F.lit(False)))


def _matrices(batch: pa.RecordBatch):
    """(positions in the batch, matrix) for each vector length of a batch."""
    v = batch.column("_v")
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)


def _near_pivots(rows: DataFrame, pivots: list) -> DataFrame:
    """Add _pivot (the nearest of the same length, else -1) and _cos."""
    by_size: dict[int, np.ndarray] = {}
    for p in pivots:
        by_size.setdefault(len(p), []).append(p)
    by_size = {d: directions(np.array(x, dtype=np.float64)) for d, x in by_size.items()}

    def run(batches):
        for batch in batches:
            pivot, cos = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows, np.float32)
            for at, x in _matrices(batch):
                if x.shape[1] in by_size:
                    for k in range(0, len(at), TILE):
                        near = directions(x[k : k + TILE].astype(np.float64)) @ by_size[x.shape[1]].T
                        best = near.argmax(1)
                        pivot[at[k : k + TILE]], cos[at[k : k + TILE]] = best, near[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_v"), pa.array(pivot), pa.array(cos)], ["_id", "_v", "_pivot", "_cos"])

    return rows.mapInArrow(run, f"_id {id_type(rows, '_id')}, _v {rows.schema['_v'].dataType.simpleString()}, _pivot int, _cos float")


def grouped(rows: DataFrame, groups: int, pivots: list) -> tuple[DataFrame, np.dtype]:
    """(g, base, ids, d, x): the vectors packed into blocks of one length, block by block in the order of their pivots. ``base`` + position
    numbers every row of the table."""
    kind = rows.schema["_v"].dataType.elementType.simpleString()
    near = _near_pivots(rows, pivots)
    # the last key spreads equal vectors
    keys = [F.size("_v"), "_pivot", F.desc("_cos"), F.xxhash64("_id")]
    dealt = near.repartitionByRange(groups, *keys).sortWithinPartitions(*keys)
    out = f"g int, base bigint, ids array<{id_type(rows, '_id')}>, d int, x binary"

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("_id")
            for at, x in _matrices(batch):
                for k in range(0, len(at), TILE):
                    own, block = ids.take(pa.array(at[k : k + TILE])), x[k : k + TILE]
                    yield pa.RecordBatch.from_arrays([pa.array([part % groups], pa.int32()), pa.array([(part << 40) + n], pa.int64()), pa.ListArray.from_arrays([0, len(own)], own), pa.array([x.shape[1]], pa.int32()), pa.array([np.ascontiguousarray(block).tobytes()], pa.binary())], ["g", "base", "ids", "d", "x"])
                    n += len(own)

    return dealt.select("_id", "_v").mapInArrow(run, out), np.dtype("f4" if kind == "float" else "f8")


def _compared(blocks: DataFrame, groups: int, kind: np.dtype, threshold: float) -> DataFrame:
    """(a, b, n): rows (a, NULL, n) add n links to row a; rows (a, b, NULL) say that a and b are in one part."""
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    both = blocks.select("g", "base", "d", "x", F.size("ids").alias("rows")).withColumn("h", other)
    lo, hi = F.least("g", "h"), F.greatest("g", "h")
    # pairs of groups are numbered row by row
    both = both.withColumn("pair", (lo * groups - F.floor(lo * (lo - 1) / 2) + hi - lo).cast("int")).drop("h")
    dealt = both.repartitionById(groups * (groups + 1) // 2, F.col("pair"))

    def tiles(rows: list[dict], start: int) -> tuple[list[Tile], int]:
        made: list[Tile] = []
        for d in sorted({r["d"] for r in rows}):
            own = sorted((r for r in rows if r["d"] == d), key=lambda r: r["base"])
            x = np.concatenate([np.frombuffer(r["x"], kind).reshape(-1, d) for r in own])
            for k in range(0, len(x), TILE):
                made.append(Tile(np.arange(start + k, start + min(len(x), k + TILE)), x[k : k + TILE]))
            start += len(x)
        return made, start

    def names(rows: list[dict]) -> list[np.ndarray]:
        return [r["base"] + np.arange(r["rows"]) for d in sorted({r["d"] for r in rows}) for r in sorted((r for r in rows if r["d"] == d), key=lambda r: r["base"])]

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        sides = sorted({r["g"] for r in rows})
        pair = rows[0]["pair"]
        # a pair of two groups of which one is empty has nothing to compare
        if len(sides) == 1 and pair != sides[0] * groups - sides[0] * (sides[0] - 1) // 2:
            return
        parts = [[r for r in rows if r["g"] == g] for g in sides]
        name = np.concatenate([x for p in parts for x in names(p)])
        left, n = tiles(parts[0], 0)
        right = tiles(parts[1], n)[0] if len(parts) > 1 else left
        count, label = np.zeros(len(name), np.int64), np.arange(len(name))
        for k, a in enumerate(left):
            for b in right if len(parts) > 1 else left[k:]:
                if a.x.shape[1] != b.x.shape[1] or apart(a, b, threshold):
                    continue
                i, j, _ = links(a, b, threshold)
                if len(i):
                    np.add.at(count, a.at, np.bincount(i, minlength=len(a.at)))
                    np.add.at(count, b.at, np.bincount(j, minlength=len(b.at)))
                    merge(label, a.at[i], b.at[j])
        hit = np.flatnonzero(count)
        root = hit
        while not np.array_equal(up := label[root], root):
            root = up
        order = np.lexsort((hit, root))
        hit, root = hit[order], root[order]
        path = np.flatnonzero(root[1:] == root[:-1])
        a = pa.array(np.concatenate([name[hit], name[hit[path]]]), pa.int64())
        b = pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(name[hit[path + 1]], pa.int64())])
        c = pa.concat_arrays([pa.array(count[hit], pa.int64()), pa.nulls(len(path), pa.int64())])
        yield pa.RecordBatch.from_arrays([a, b, c], ["a", "b", "n"])

    return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", groups: int = GROUPS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of the table.

    Vectors link when their cosine reaches the threshold; a cosine is the product of the two scaled vectors in double precision.
    NULL and zero vectors and those with NULL or non-finite components link with nothing; vectors of different lengths do not
    link with each other. ``component_id`` is the least id reachable by links, the row's own included; ``kept`` rows have it as
    their id. Rows of a repeated id are vectors of their own; NULL ids come after all others and count as equal. An empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    rows = _vectors(table, id_col, vec_col)
    valid = rows.where("_ok")
    seen = valid.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_v")).alias("values")).first()
    alone = lambda df: df.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    if not seen["n"]:
        return alone(rows)
    width = np.dtype("f4").itemsize if valid.schema["_v"].dataType.elementType.simpleString() == "float" else 8
    groups = max(groups, -(-seen["values"] * (width + 9) // group_bytes))
    pivots = [r["_v"] for r in valid.orderBy(F.xxhash64("_id"), "_id").select("_v").limit(PIVOTS).collect()]
    packed, kind = grouped(valid.select("_id", "_v"), groups, pivots)
    blocks = written(packed, "neardup-blocks")
    found = written(_compared(blocks, groups, kind, threshold), "neardup-found")
    # xxhash64 of one long is a bijection: names in no order, so that contraction takes few rounds
    label = components(found.where("b is not null").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    linked = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n_links")).withColumn("node", F.xxhash64("a")).join(label, "node").drop("node")
    members = blocks.select("base", F.posexplode("ids").alias("at", "_id")).select((F.col("base") + F.col("at")).alias("a"), "_id")
    all_rows = written(members.join(linked, "a", "left").select("_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "label", F.col("label").isNotNull().alias("_in")), "neardup-rows")
    least = all_rows.where("_in").groupBy("label").agg(F.min("_id").alias("component_id"))
    joined = skew_join(all_rows.where("_in"), least, ["label"])
    out = joined.select(F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(alone(all_rows.where("not _in"))).unionByName(alone(rows.where("not _ok")))


def op12(spark, table: DataFrame) -> DataFrame:
    """Near-duplicate classes of all vectors at cosine 0.9."""
    return near_duplicates(table)
