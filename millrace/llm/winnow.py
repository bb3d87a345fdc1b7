"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken 2003), in DataFrame functions only.

Tokens are runs of non-space code points (runs longer than ``RUN`` are cut, so texts without spaces have tokens too). Every
``k`` neighbouring tokens give one hash, rolled up from the token hashes; in every window of ``w`` neighbouring hashes the
smallest is chosen, the rightmost among equals, and kept with its position. So two texts that share a run of w + k - 1 tokens
share a fingerprint, and a shared fingerprint marks k equal tokens at known positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import picked, written

K = 3
W = 8
RUN = 16
#: Rows of a stretch of ids that one window partition holds, and the largest number of stretches.
STRETCH = 1_000
STRETCHES = 1_024
_POSITIONS = 1 << 31


def gram_hashes(text: Column, k: int = K) -> Column:
    """Array of longs: the 32-bit hash of each run of ``k`` tokens above its place from the right end, so that the smallest
    long is the smallest hash and, among equals, the rightmost. Fewer than ``k`` tokens give one hash of all of them; none gives
    an empty array."""
    tokens = F.regexp_extract_all(text, F.lit(f"(\\S{{1,{RUN}}})"), F.lit(1))
    codes = F.transform(tokens, lambda t: F.hash(t).cast("long"))

    def rolled(c: Column) -> Column:
        def at(_, i):  # a polynomial in the token hashes, mixed once more so that minima are spread evenly
            total = F.lit(0).cast("long")
            for j in range(k):
                total = total.bitwiseAND(F.lit(0x7FFFFFFF)) * 1_000_003 + F.get(c, i + j)
            return _placed(F.hash(total), i)

        whole = F.when(F.size(c) > 0, F.array(_placed(F.hash(c), F.lit(0)))).otherwise(F.array().cast("array<long>"))
        return F.when(F.size(c) >= k, F.transform(F.slice(c, 1, F.greatest(F.lit(1), F.size(c) - (k - 1))), at)).otherwise(whole)

    return _bound(codes, rolled)


def _placed(code: Column, i: Column) -> Column:
    return F.shiftleft(code.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(F.lit(_POSITIONS - 1) - i)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _halved(s: int):
    """Minima of windows twice as long, from those of windows of ``s``; a shorter array becomes its minimum."""

    def level(a: Column) -> Column:
        pairs = F.transform(F.slice(a, 1, F.greatest(F.lit(1), F.size(a) - s)), lambda x, i: F.least(x, F.get(a, i + s)))
        return F.when(F.size(a) > s, pairs).otherwise(F.when(F.size(a) > 0, F.array(F.array_min(a))).otherwise(a))

    return level


def window_minima(grams: Column, w: int = W) -> Column:
    """Distinct smallest longs of every window of ``w`` (a power of two) entries; of all entries if there are fewer."""
    assert w & (w - 1) == 0
    out, step = grams, 1
    while step < w:
        out = _bound(out, _halved(step))
        step *= 2
    return F.array_distinct(out)


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """Array of longs, in the order of the text: the chosen hashes with their positions."""
    return window_minima(gram_hashes(text, k), w)


def hashes(fp: Column) -> Column:
    return F.transform(fp, lambda x: F.shiftrightunsigned(x, 31))


def shown(fp: Column) -> Column:
    """Fingerprint as text: hexadecimal hash, ``@``, position of the first token of the run; empty for a text without tokens."""
    return F.array_join(F.transform(fp, lambda x: F.concat(F.hex(F.shiftrightunsigned(x, 31)), F.lit("@"), (F.lit(_POSITIONS - 1) - x.bitwiseAND(F.lit(_POSITIONS - 1))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """2 |A n B| / (|A| + |B|) over the sets of chosen hashes; 1 if both are empty, 0 if one is."""
    x, y = F.array_distinct(hashes(a)), F.array_distinct(hashes(b))
    both = F.size(x) + F.size(y)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)


def next_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, WindowSpec]:
    """Rows (_s, _end, _id, _t) and the window in which the row after each, by id, then by text, follows it. NULL ids come first,
    NULL texts read as empty. Rows with _end 1 only stand for the first row of the next stretch (after the last: of the first)
    and are to be dropped after the window. A row of its own is its own next.

    Ids are cut into stretches at quantiles, so a window partition holds about ``STRETCH`` rows (beyond ``STRETCHES`` stretches
    they grow and the window spills); rows that share one id stay together. The texts go through one shuffle.
    """
    spark = docs.sparkSession
    rows = picked(docs, id_col, text_col).toDF("_id", "_t").select(F.col("_id").cast("long").alias("_id"), F.coalesce("_t", F.lit("")).alias("_t"))
    pieces = max(1, min(STRETCHES, -(-docs.count() // STRETCH)))
    ids = rows.select(F.col("_id").cast("double"))
    cuts = sorted(set(ids.approxQuantile("_id", [k / pieces for k in range(1, pieces)], 0.1 / pieces))) if pieces > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= F.col("_id"))) if cuts else F.lit(0)
    dealt = rows.withColumn("_s", F.when(F.col("_id").isNull(), F.lit(-1)).otherwise(at).cast("int")).withColumn("_end", F.lit(0))
    # the first row of each stretch: a few ids, then the least text of each
    least = dealt.groupBy("_s").agg(F.min("_id").alias("_least"))
    first = dealt.join(F.broadcast(least), "_s").where(F.col("_id").eqNullSafe(F.col("_least"))).groupBy("_s").agg(F.min("_id").alias("_id"), F.min("_t").alias("_t"))
    first = written(first, "winnow-first")
    known = [r._s for r in first.select("_s").orderBy("_s").collect()]
    before = spark.createDataFrame([(known[(k + 1) % len(known)], s) for k, s in enumerate(known)], "_s int, _to int") if known else first.select("_s", F.col("_s").alias("_to"))
    ends = first.join(F.broadcast(before), "_s").select(F.col("_to").alias("_s"), F.lit(1).alias("_end"), "_id", "_t")
    out = dealt.select("_s", "_end", "_id", "_t").unionByName(ends)
    return out, Window.partitionBy("_s").orderBy("_end", "_id", "_t")


def op5(spark, docs: DataFrame) -> DataFrame:
    rows, order = next_rows(docs, "doc_id", "text")
    n, half = F.char_length("_t"), F.floor(F.char_length("_t") / 2).cast("int")
    rows = rows.withColumn("_next", F.lead("_t").over(order)).withColumn("_fp", fingerprint(F.col("_t"))).withColumn("_next_fp", F.lead("_fp").over(order)).where("_end = 0")
    edited = F.concat(F.substring(F.col("_t"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    rows = rows.select("_id", n.cast("long").alias("n_chars"), "_fp", "_next_fp", edited.alias("_edited"))
    rows = rows.withColumn("_edited_fp", fingerprint(F.col("_edited")))
    return rows.select(F.col("_id").alias("doc_id"), "n_chars", F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"), shown(F.col("_fp")).alias("fingerprint"), shown(F.col("_edited_fp")).alias("edited_fingerprint"), likeness(F.col("_fp"), F.col("_edited_fp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_next_fp")).alias("near_next"))
