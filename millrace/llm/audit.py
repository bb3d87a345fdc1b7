"""Filter interaction audit: what each of five filters removes in every order they can be applied in.

Four filters look at one text alone. The fifth asks whether a smaller id has the same text, and a counting Bloom prepass
keeps most texts out of that question: every task counts its text hashes in a sketch, the sketches are merged by adding, and a text
that meets a counter below two is certainly unique. Only texts that may be repeated are shuffled, whole, to find the least id
of each exact text; the flags join the other four, and the five bits of a document (its mask) are counted. All results
of all orders are sums over at most 32 counts for each part. A larger sketch only lets fewer unique texts pass; results do not
depend on its size.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import skew_join

from .common import SLICE_BYTES, id_type, picked, slices, texts_of, written

FILTERS = "ABCDE"
#: Counters for each row, the least and the largest number of counters (two bits each: 32 MB), and positions of a text.
PER_ROW = 12
LEAST, MOST = 1 << 16, 1 << 27
PROBES = 3
#: Counters of a block; blocks are what tasks send and merge.
BLOCK = 1 << 16
SYMBOLS = regex.compile(r"[#$%&*|]")
UPPER = bytes(range(ord("A"), ord("Z") + 1))


def text_mask(text: str) -> int:
    """Bits 0 to 3: the text fails A (under 100 words), B (less than 80 % distinct words), C (more than 10 % A-Z), D (a symbol)."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * len(text)) << 2 | (SYMBOLS.search(text) is not None) << 3


def text_digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "replace"))


def probes(digests: list[bytes], counters: int) -> np.ndarray:
    """Counter numbers of every text, one row each (double hashing)."""
    h = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    k = np.arange(PROBES, dtype=np.uint64)
    return ((h[:, :1] + k * (h[:, 1:] | np.uint64(1))) & np.uint64(counters - 1)).astype(np.int64)


def counters_for(rows: int) -> int:
    """A power of two: ``PER_ROW`` counters a row, within the bounds."""
    return min(MOST, max(LEAST, 1 << max(0, PER_ROW * rows - 1).bit_length()))


def _pack(counts: np.ndarray) -> bytes:
    """Two bits a counter: 0, 1, or 2 for more."""
    c = np.minimum(counts, 2).astype(np.uint8).reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()


def repeated(sketch: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for the texts all of whose counters reach two."""
    return (((sketch[at >> 2] >> ((at & 3) << 1).astype(np.uint8)) & 3) >= 2).all(1)


def merged_sketch(texts: DataFrame, counters: int) -> np.ndarray:
    """The packed counting Bloom sketch of all texts: ``counters / 4`` bytes, at most 32 MB, on the driver.

    A task sends the counters it touched, in blocks; each block is added up by one task.
    """

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "_t"):
                held.append(probes([text_digest(t) for t in texts_of(part, "_t")], counters).ravel())
                if sum(map(len, held)) > 1 << 20:
                    yield sent(held)
                    held = []
        if held:
            yield sent(held)

    def sent(held):
        # a position that one text meets twice counts twice, here and in every test: counters are never too low
        at, n = np.unique(np.concatenate(held), return_counts=True)
        blocks, first = np.unique(at // BLOCK, return_index=True)
        ends = [*first[1:], len(at)]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([(at[a:b] % BLOCK).astype("<u2").tobytes() for a, b in zip(first, ends)], pa.binary()), pa.array([np.minimum(n[a:b], 2).astype(np.uint8).tobytes() for a, b in zip(first, ends)], pa.binary())], ["block", "at", "n"])

    def added(frame):
        total = np.zeros(BLOCK, np.int64)
        for at, n in zip(frame["at"], frame["n"]):
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.uint8)
        return frame.iloc[:1][["block"]].assign(sketch=[_pack(total)])

    sketch = np.zeros(counters // 4, np.uint8)
    blocks = texts.mapInArrow(run, "block bigint, at binary, n binary").groupBy("block").applyInPandas(added, "block bigint, sketch binary")
    for r in blocks.toLocalIterator():
        at = r["block"] * BLOCK // 4
        sketch[at : at + BLOCK // 4] = np.frombuffer(r["sketch"], np.uint8)
    return sketch


def _looked_up(rows: DataFrame, sketch, counters: int, texts: bool) -> DataFrame:
    """(_id, _part, mask, key) of every row, ``key`` (a digest) only where the text may be repeated; or, with ``texts``, (_id, key, _t) of
    the rows whose text may be repeated."""

    def run(batches):
        own = sketch.value
        for batch in batches:
            for part in slices(batch, "_t", SLICE_BYTES):
                said = texts_of(part, "_t")
                digests = [text_digest(t) for t in said]
                again = repeated(own, probes(digests, counters))
                if texts:
                    at = np.flatnonzero(again)
                    yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(at)), pa.array([digests[k] for k in at], pa.binary()), pa.array([said[k] for k in at], pa.string())], ["_id", "key", "_t"])
                else:
                    keys = [d if a else None for d, a in zip(digests, again)]
                    yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_part"), pa.array([text_mask(t) for t in said], pa.int32()), pa.array(keys, pa.binary())], ["_id", "_part", "mask", "key"])

    kind = id_type(rows, "_id")
    if texts:
        return rows.select("_id", "_t").mapInArrow(run, f"_id {kind}, key binary, _t string")
    return rows.mapInArrow(run, f"_id {kind}, _part string, mask int, key binary")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(_id, _part, mask) of every row: bit k is set if the document fails filter k of ``FILTERS``. Stored.

    NULL texts are empty, a NULL part is the empty string. A row repeats if a smaller id has the same text; rows of one id and
    text are no repeats of each other, and NULL ids are neither smaller nor larger than others.
    """
    rows = picked(docs, id_col, text_col, part_col).select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("_part"))
    spark = docs.sparkSession
    counters = counters_for(rows.count())
    sketch = spark.sparkContext.broadcast(merged_sketch(rows.select("_t"), counters))
    alone = written(_looked_up(rows, sketch, counters, False), "audit-masks")
    first = _looked_up(rows, sketch, counters, True).groupBy("_t").agg(F.min("_id").alias("_first"), F.min("key").alias("key")).drop("_t")
    # equal digests of different texts are as good as impossible; the larger of their first ids would be a repeat of no text
    flagged = skew_join(alone.where("key is not null"), first.groupBy("key").agg(F.min("_first").alias("_first")), ["key"])
    again = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)).cast("int")
    return alone.where("key is null").select("_id", "_part", "mask").unionByName(flagged.select("_id", "_part", (F.col("mask") + again * 16).alias("mask")))


def mask_counts(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, those labelled quality 1 and those labelled toxic 1. At most 32 rows a part.

    An id counts as labelled 1 if any of its label rows says so; labels of absent ids and NULL labels say nothing.
    """
    known = picked(labels, id_col, "quality", "toxic").toDF("_id", "_q", "_x")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int")
    known = known.where("(_q = 1 or _x = 1) and _id is not null").groupBy("_id").agg(one("_q").alias("_q"), one("_x").alias("_x"))
    # rows of one id are one row before the join
    docs = masked.groupBy("_id", "_part", "mask").agg(F.count(F.lit(1)).alias("n")).join(known, "_id", "left")
    got = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return docs.groupBy(F.col("_part").alias("part"), "mask").agg(F.sum("n").alias("n"), got("_q").alias("good"), got("_x").alias("toxic"))


def _bits(mask: Column, bits: Column) -> Column:
    return mask.bitwiseAND(bits) != 0


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step, from the counts of the masks (see ``op11`` for the columns)."""
    places = [(("".join(order)), k + 1, 1 << filters.index(name), sum(1 << filters.index(x) for x in order[:k])) for order in permutations(filters) for k, name in enumerate(order)]
    kind = "array<struct<filter_order:string,step:int,own:int,before:int>>"
    listed = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"own":{w},"before":{b}}}' for o, s, w, b in places) + "]"), kind)
    rows = counts.select("*", F.explode(listed).alias("at")).select("*", "at.*")
    fails, earlier = _bits(F.col("mask"), F.col("own")), _bits(F.col("mask"), F.col("before"))
    here = fails & ~earlier
    orders = len(places) // len(filters)
    sums = {
        "kept": F.when(~fails & ~earlier, F.col("n")), "removed": F.when(here, F.col("n")), "redundant": F.when(fails & earlier, F.col("n")), "unique_fails": F.when(F.col("mask") == F.col("own"), F.col("n")),
        "good_lost": F.when(here, F.col("good")), "toxic_lost": F.when(here, F.col("toxic")),
        # a filter comes first among the k that a document fails in one order of k
        "shapley": F.when(fails, F.col("n") * F.expr(f"{orders} div bit_count(mask)")),
    }
    return rows.groupBy("part", "filter_order", "step").agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in sums.items()])


def op11(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) over all 120 orders of five filters."""
    return interactions(mask_counts(masks(docs), labels))


SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
    SELECT doc_id, part, min(doc_id) OVER (PARTITION BY t) AS first_id, len(words) AS n_words, len(list_distinct(words)) AS n_distinct,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(t) AS points, regexp_matches(t, '[#$%&*|]') AS symbol
    FROM texts
), flags AS (
    SELECT doc_id, part, [n_words < 100, 100 * n_distinct < 80 * n_words, 100 * upper > 10 * points, symbol, coalesce(doc_id > first_id, false)] AS f FROM marks
), known AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), counts AS (
    SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM flags LEFT JOIN known USING (doc_id) GROUP BY part, f
), letters AS (
    SELECT unnest(range(1, 6)) AS k
), orders AS (
    SELECT [a.k, b.k, c.k, d.k, e.k] AS p FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), places AS (
    SELECT p, step, p[step] AS own, p[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), steps AS (
    SELECT part, array_to_string([substr('ABCDE', x, 1) FOR x IN p], '') AS filter_order, step, own, n, good, bad, f[own] AS fails,
        len([x FOR x IN before IF f[x]]) > 0 AS earlier, len([x FOR x IN f IF x]) AS failed
    FROM counts, places
), summed AS (
    SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN bad ELSE 0 END) AS toxic_lost
    FROM steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""
