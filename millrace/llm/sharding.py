"""Sharding by extendible hashing: a directory of hash prefixes in which only buckets over the byte limit split on another bit.

A row's hash is the first 60 bits of the MD5 of its id as text. A bucket is a prefix of ``depth`` bits; it is split while its
rows hold more bytes than the limit and at least two different hashes. The directory is made from byte sums, ``BITS`` levels at
a time and only for prefixes that are still too large, so rows are never gathered. Rows that share one hash (a repeated id)
cannot be told apart by bits: such a bucket gets overflow pages, cut by a running byte sum over the sums of short runs of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.runtime import scratch_path

from .common import picked, quoted, written

LIMIT = 8 << 20
HASH_BITS = 60
BITS = 12


def _hash(id_col: str):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _h, _bytes): hash and UTF-8 size of each row; a NULL text has no bytes, a NULL id hashes as empty text."""
    return picked(docs, id_col, text_col).select(F.col(quoted(id_col)).alias("_id"), _hash(id_col).alias("_h"), F.coalesce(F.octet_length(F.col(quoted(text_col))), F.lit(0)).cast("long").alias("_bytes"))


def directory(rows: DataFrame, limit: int = LIMIT) -> list[DataFrame]:
    """For each step of ``BITS`` bits, (_cell, _depth): the bucket depth of the hashes whose first bits are _cell.

    Cells missing from a step belong to an earlier or a later one. Levels are sums over cells, not over rows.
    """
    out, left = [], rows
    for base in range(0, HASH_BITS, BITS):
        deep = base + BITS
        cells = left.groupBy(F.shiftright("_h", HASH_BITS - deep).alias("_cell")).agg(F.sum("_bytes").alias("b"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        cells = written(cells, "shard-cells")
        levels = cells.withColumn("_depth", F.explode(F.sequence(F.lit(base), F.lit(deep)))).withColumn("_prefix", F.expr(f"shiftright(_cell, {deep} - _depth)"))
        sums = levels.groupBy("_depth", "_prefix").agg(F.sum("b").alias("sum"), F.min("lo").alias("least"), F.max("hi").alias("most"))
        # under the first level of a later step there is always a prefix that was too large, so its own level cannot stop it
        stops = sums.where((F.col("sum") <= limit) | (F.col("least") == F.col("most"))).select("_depth", "_prefix")
        ended = written(levels.join(stops, ["_depth", "_prefix"]).groupBy("_cell").agg(F.min("_depth").alias("_depth")), "shard-directory")
        out.append(ended)
        open_cells = cells.join(ended, "_cell", "left_anti").select("_cell")
        if deep == HASH_BITS or open_cells.isEmpty():
            break
        left = left.withColumn("_cell", F.shiftright("_h", HASH_BITS - deep)).join(open_cells, "_cell", "left_semi").drop("_cell")
    return out


def _placed(rows: DataFrame, slim: DataFrame, limit: int) -> DataFrame:
    """``rows`` with _depth and _page. ``slim`` has (_h, _bytes) of the same rows; ``rows`` may hold more columns.

    Rows of an overflowing hash are taken out first, by a broadcast of these hashes: each has more than ``limit`` bytes, so they
    are few. No join or window deals rows by such a hash.
    """
    steps = directory(slim, limit)
    full = slim.groupBy("_h").agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")).where((F.col("b") > limit) & (F.col("n") > 1)).select("_h")
    full = written(full, "shard-overflow")
    some = not full.isEmpty()

    def deep(left):
        out = None
        for step, ended in enumerate(steps):
            at = left.withColumn("_cell", F.shiftright("_h", HASH_BITS - (step + 1) * BITS))
            hit = at.join(ended, "_cell").drop("_cell")
            out = hit if out is None else out.unionByName(hit)
            left = at.join(ended, "_cell", "left_anti").drop("_cell")
        return out

    normal = deep(rows.join(F.broadcast(full), "_h", "left_anti") if some else rows).withColumn("_page", F.lit(0).cast("long"))
    if not some:
        return normal
    # overflow: running byte sums, within runs of 65,536 stored rows of the hash, then over the runs
    over = written(rows.join(F.broadcast(written(deep(full), "shard-overflow-depth")), "_h"), "shard-over")
    over = over.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    at = over.select("_h", "_bytes", "_file", "_at", F.shiftright("_at", 16).alias("_run"))
    runs = at.groupBy("_h", "_file", "_run").agg(F.sum("_bytes").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_h").orderBy("_file", "_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).drop("_sum")
    inside = F.coalesce(F.sum("_bytes").over(Window.partitionBy("_h", "_file", "_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("_in", inside).join(runs, ["_h", "_file", "_run"]).withColumn("_start", F.col("_before") + F.col("_in"))
    first, last = F.floor(F.col("_start") / limit), F.floor((F.col("_start") + F.greatest(F.col("_bytes"), F.lit(1)) - 1) / limit)
    at = at.select("_file", "_at", (2 * first + (last > first).cast("long")).cast("long").alias("_page"))  # rows across a cut: one for each cut, on a page of its own
    return normal.unionByName(over.join(at, ["_file", "_at"]).drop("_file", "_at"))


def _bits(none: str):
    return F.when(F.col("_depth") == 0, F.lit(none)).otherwise(F.expr(f"lpad(bin(shiftright(_h, {HASH_BITS} - _depth)), _depth, '0')"))


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, shard, depth, page) of every row: the bucket's prefix as bits, its length, and the overflow page.

    Every (shard, page) holds at most ``limit`` bytes, but for a row that is larger by itself, which then has a page of its own.
    A bucket of one hash within the limit has only page 0.
    """
    rows = written(keys(docs, id_col, text_col), "shard-keys")
    found = _placed(rows, rows, limit)
    return found.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), _bits("").alias("shard"), F.col("_depth").cast("int").alias("depth"), F.col("_page").alias("page"))


def write(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, str]:
    """``docs``, all columns, in one folder for each shard and page under ``path``; the names of the two partition columns.

    Every (shard, page) is one file within the limit of ``assign``, cut by the same byte sums over these very rows. The shard of
    all rows is named "all". Columns named shard or page stay: the partition columns then get underscores before their names.
    """
    slim = written(keys(docs, id_col, text_col).select("_h", "_bytes"), "shard-keys")
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("shard", "page"):
        while name in taken:
            name = "_" + name
        names.append(name)
    size = F.coalesce(F.octet_length(F.col(quoted(text_col))), F.lit(0)).cast("long")
    rows = docs.select(_hash(id_col).alias("_h"), size.alias("_bytes"), F.struct("*").alias("_row"))
    found = _placed(rows, slim, limit).select(_bits("all").alias("_shard"), "_page", "_row").repartition("_shard", "_page")
    found.select(F.col("_shard").alias(names[0]), F.col("_page").alias(names[1]), "_row.*").write.partitionBy(*names).parquet(path)
    return names[0], names[1]


SQL = f"""
WITH k AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
levels AS (SELECT d::INTEGER AS d, h >> ({HASH_BITS} - d)::INTEGER AS p, sum(n_bytes) AS b, min(h) AS lo, max(h) AS hi FROM k, range({HASH_BITS} + 1) t(d) GROUP BY ALL),
stops AS (SELECT d, p FROM levels WHERE b <= {LIMIT} OR lo = hi),
found AS (SELECT k.doc_id, k.n_bytes, k.h, min(s.d) AS depth FROM k JOIN stops s ON s.p = k.h >> ({HASH_BITS} - s.d) GROUP BY ALL)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({HASH_BITS} - depth)), depth, '0') END AS shard,
       depth::INTEGER AS depth, 0::BIGINT AS page FROM found
"""


def op8(spark, docs: DataFrame) -> DataFrame:
    """The shards are written with all columns of the documents; the rows are read back from them."""
    path = scratch_path(spark, "shards")
    shard, page = write(docs, path)
    back = spark.read.schema(StructType([*docs.schema.fields, StructField(shard, StringType()), StructField(page, LongType())])).parquet(path)
    prefix = F.when(F.col(shard) == "all", "").otherwise(F.col(shard))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return back.select("doc_id", size.alias("n_bytes"), prefix.alias("shard"), F.length(prefix).alias("depth"), F.col(page).alias("page"))
