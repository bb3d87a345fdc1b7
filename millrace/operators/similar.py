"""Groups of similar texts: bands of min-hashes choose who meets, the shared shingles decide.

All steps are DataFrame expressions, but for the min-hashes, which numpy takes over many rows at once, and the shared shingles of many pairs. Texts with the same shingles are one node, so a text that stands in a third of all rows costs one.
The nodes of a band are not paired with each other: they meet the band's first node, and what that connects is one part. Only nodes of
different parts of a band are compared after that.

The shingles of a text take more room than the text. They are never stored or sent for a text that shares no band with another: those of
the others are made again by a second reading of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.graph import connected
from millrace.operators.ordered import skew_join
from millrace.operators.windows import dedup
from millrace.runtime import stored_lean

#: Bands, and min-hashes of a band: a pair of similarity 0.8 shares no band twice in a million times, one of 0.2 shares one in 25.
BANDS, ROWS = 25, 4
#: Codes that a block of texts holds when all its pairs with another block are compared.
BLOCK_CODES = 1 << 19
#: Nodes that are sent to all tasks to pick out their texts; more are joined by a shuffle.
SENT_NODES = 1 << 20
#: Bytes, by the planner's estimate, up to which texts are dealt out anew before they are hashed.
DEALT_BYTES = 1 << 26


def shingle_codes(text: Column, words: int = 5) -> Column:
    """The distinct runs of ``words`` neighbouring words of a text, as sorted 64-bit hashes. Words are in lower case and without punctuation;
    a text of fewer words is one run, NULL and a text without letters and digits have none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - words))
        return F.transform(at, lambda k: F.xxhash64(*[F.get(w, k + j) for j in range(words)]))

    # the hashes of the words are computed once
    found = F.get(F.transform(F.array(F.transform(F.split(plain, " "), lambda x: F.when(x != "", F.xxhash64(x)))), runs), F.lit(0))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}]"), F.sort_array(F.array_distinct(found))).otherwise(F.array().cast("array<bigint>"))


def minima(salts: list[int], codes: Column) -> Column:
    """For each salt the smallest code after an XOR with it. Rows are taken together, some 100,000 codes at a time."""

    @F.arrow_udf("array<bigint>")
    def run(lists: pa.Array) -> pa.Array:
        mins = np.empty((len(lists), len(salts)), dtype=np.int64)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        values = lists.flatten().to_numpy(zero_copy_only=False)
        row = 0
        while row < len(lists):
            start = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, start + 100_000, side="right")))
            part, first = values[start : ends[stop - 1]], np.concatenate(([0], ends[row : stop - 1] - start))
            for k, salt in enumerate(salts):
                mins[row:stop, k] = np.minimum.reduceat(part ^ np.int64(salt), first)
            row = stop
        return pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * len(salts), mins.ravel())

    return run(codes)


def bands(codes: Column, n: int = BANDS, rows: int = ROWS) -> Column:
    """``n`` longs, each the hash of ``rows`` min-hashes of codes that are not empty. Codes are random, so a code combined with a constant
    by XOR is a random order of them."""
    salts = SparkSession.active().range(1, n * rows + 1).select(F.collect_list(F.xxhash64(F.col("id").cast("int"))).alias("s"), F.collect_list("id").alias("k")).first()
    mins = minima([s for _, s in sorted(zip(salts["k"], salts["s"]))], codes)
    joined = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.xxhash64(b, F.slice(m, b * rows + 1, rows)))
    return F.get(F.transform(F.array(mins), joined), F.lit(0))


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of nodes. A ``b`` may stand in any share of the pairs."""
    codes = nodes.select("node", "codes")
    with_a = pairs.join(codes.withColumnsRenamed({"node": "a", "codes": "ca"}), "a")
    both = skew_join(with_a, codes.withColumnsRenamed({"node": "b", "codes": "cb"}), ["b"], "inner")
    shared = F.size(F.array_intersect("ca", "cb"))
    return both.select("a", "b", F.size("ca").alias("na"), F.size("cb").alias("nb"), shared.alias("o")).select("a", "b", (F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("similarity"))


def _links(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    found = _compared(stored_lean(pairs.distinct(), "similar-pairs"), nodes).filter(F.col("similarity") >= threshold)
    return stored_lean(found.select(F.col("a").alias("src"), F.col("b").alias("dst")), "similar-links")


def _block_links(open_: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links of the nodes of different parts of a band, but for its first node. ``open_`` has band, node, part, n, lead and own, the part of the lead.

    What is sent are the codes of the nodes to the blocks of their bands, not those of each pair. Bands of the same nodes are one.
    """
    a, b = F.col("part") != F.col("own"), F.col("node") != F.col("lead")
    blocks = lambda side: F.greatest(F.lit(1), F.ceil(F.sum(F.when(side, F.col("n")).otherwise(0)) / BLOCK_CODES)).cast("int")
    sizes = open_.groupBy("band").agg(blocks(a).alias("na"), blocks(b).alias("nb"), F.count(F.lit(1)).alias("c"), F.min("node").alias("lo"), F.bit_xor(F.xxhash64("node")).alias("x"))
    kept = sizes.groupBy("c", "lo", "x").agg(F.min("band").alias("band"), F.min_by("na", "band").alias("na"), F.min_by("nb", "band").alias("nb")).select("band", "na", "nb")
    entries = stored_lean(skew_join(open_, kept, ["band"], "inner"), "similar-entries")
    sides = F.filter(F.array(F.when(a, F.lit(True)), F.when(b, F.lit(False))), lambda x: x.isNotNull())
    held = entries.select("band", "node", "part", "n", "own", "na", "nb", F.explode(sides).alias("first")).join(nodes.select("node", "codes"), "node")
    own_block = F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("first"), F.col("na")).otherwise(F.col("nb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("first"), F.col("nb")).otherwise(F.col("na")) - 1))
    cells = held.select("band", "node", "part", "n", "own", "first", "codes", own_block.alias("__k"), other.alias("__o"))
    cells = cells.select("band", F.when(F.col("first"), F.col("__k")).otherwise(F.col("__o")).alias("i"), F.when(F.col("first"), F.col("__o")).otherwise(F.col("__k")).alias("j"), "node", "part", "n", "own", "first", "codes")

    def links(cell: pa.Table) -> pa.Table:
        column = lambda name: cell.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        node, part, n, own, first = (column(x) for x in ("node", "part", "n", "own", "first"))
        ends = np.cumsum(n)
        _, names = np.unique(cell.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        of = lambda k: names[ends[k] - n[k] : ends[k]]
        firsts, others = np.flatnonzero(first), np.flatnonzero(~first)
        src, dst = [], []
        if len(firsts) and len(others):
            theirs, starts = np.concatenate([of(k) for k in others]), np.cumsum(n[others]) - n[others]
            mark = np.zeros(len(names), dtype=np.int64)
            for k in firsts:
                least, most = np.minimum(n[k], n[others]), np.maximum(n[k], n[others])
                asked = (part[others] != part[k]) & ((part[others] == own[k]) | (node[k] < node[others])) & (least >= threshold * most - 1e-6)
                if asked.any():
                    mark[of(k)] = 1
                    shared = np.add.reduceat(mark[theirs], starts)
                    mark[of(k)] = 0
                    hit = others[asked & (shared / (n[k] + n[others] - shared) >= threshold)]
                    src.append(np.full(len(hit), node[k]))
                    dst.append(node[hit])
        whole = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, dtype=np.int64), pa.int64())
        return pa.table({"src": whole(src), "dst": whole(dst)})

    return stored_lean(cells.groupBy("band", "i", "j").applyInArrow(links, "src bigint, dst bigint").distinct(), "similar-links")


def near_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """(id, group_id, copies, similarity) of the rows whose text is similar to another row's: the smallest id of the group, its
    number of rows, and the Jaccard similarity of the row's shingles to those of the row with that id.

    Two texts link if they share a band and the similarity of their shingle sets reaches ``threshold``; a group is a connected part. Texts
    without words are in no group. Equal sets are told by 64-bit hashes. Work grows with the rows, except in a band that many
    texts share which are not similar: there it grows with the rows outside the band's first part times the rows of the band.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # hashing is work on few bytes: a small table is dealt to as many tasks as the session has shuffle partitions
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < DEALT_BYTES:
        texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded = texts.select("id", shingle_codes(F.col("text"), words).alias("codes"))
    some = F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.array(F.lit(0).cast("bigint")))
    rows = stored_lean(coded.select("id", F.xxhash64("codes").alias("node"), F.size("codes").alias("n"), bands(some).alias("bands")), "similar-rows").filter("n > 0")
    every = stored_lean(dedup(rows, ["node"], ["id"]).select("node", "n", F.explode_outer("bands").alias("band")), "similar-bands")
    first = every.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("__last")).filter("lead < __last").drop("__last")
    # from here on only bands of several nodes, and their nodes
    entries = stored_lean(skew_join(every, stored_lean(first, "similar-leads"), ["band"], "inner"), "similar-shared")
    met = entries.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    needed = stored_lean(entries.select("node").distinct(), "similar-needed")
    again = coded.select(F.xxhash64("codes").alias("node"), "codes")
    again = again.join(F.broadcast(needed) if needed.count() <= SENT_NODES else needed, "node", "left_semi")
    nodes = stored_lean(dedup(again, ["node"], ["node"]), "similar-nodes")
    links = _links(met, nodes, threshold)

    label = connected(links)
    known = stored_lean(entries.drop("lead").join(label, "node", "left").select("band", "node", "n", F.coalesce("label", "node").alias("part")), "similar-known")
    ends = known.groupBy("band").agg(F.min("part").alias("__lo"), F.max("part").alias("__hi"), F.min("node").alias("lead"), F.min_by("part", "node").alias("own"))
    open_ = stored_lean(skew_join(known, ends.filter("__lo < __hi").drop("__lo", "__hi"), ["band"], "inner"), "similar-open")
    more = _block_links(open_, nodes, threshold)

    label = connected(links.unionByName(more))
    placed = rows.select("id", "node").join(label, "node", "left").select("id", "node", F.coalesce("label", "node").alias("part"))
    groups = placed.groupBy("part").agg(F.min("id").alias("group_id"), F.min_by("node", "id").alias("b"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and b is not null")
    members = stored_lean(skew_join(placed, groups, ["part"], "inner").select("id", "node", "group_id", "copies", "b"), "similar-members")
    asked = members.filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    likeness = stored_lean(_compared(asked, nodes).select(F.col("a").alias("node"), "similarity"), "similar-likeness")
    # copies of the text of the first row have its shingles
    return skew_join(members, likeness, ["node"], "left").select(F.col("id").alias(id_col), "group_id", "copies", F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
