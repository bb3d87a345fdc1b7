"""Files: readers by format, permissive reads, listings, conversion and compaction."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Format by file extension.
FORMATS = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".json": "json",
    ".jsonl": "json",
    ".parquet": "parquet",
    ".avro": "avro",
    ".orc": "orc",
    ".xml": "xml",
}


class MixedFormats(ValueError):
    """A folder holds files of several formats."""


def detect_format(spark: SparkSession, path: str) -> str:
    """Format by extension, else by the first bytes of the files without a known one, else csv. Every file is looked at: a
    folder of several formats is an error, since one reader would misread a part of it."""
    known = FORMATS.get(os.path.splitext(path.rstrip("/*"))[1].lower())
    if known:
        return known
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)))
    found = {r.fmt for r in files.select(by_name.alias("fmt")).distinct().collect()}
    if None in found:
        start = F.substring("content", 1, 64)
        text = F.trim(F.regexp_replace(F.decode(start, "ISO-8859-1"), r"\s+", " "))
        head = (
            F.when(F.substring(start, 1, 4) == F.lit(b"PAR1"), "parquet").when(F.substring(start, 1, 3) == F.lit(b"ORC"), "orc")
            .when(text.rlike(r"^[{\[]"), "json").when(text.startswith("<"), "xml").otherwise("csv")
        )
        found = (found - {None}) | {r.fmt for r in files.filter(by_name.isNull()).select(head.alias("fmt")).distinct().collect()}
    if len(found) > 1:
        raise MixedFormats(f"{path}: {', '.join(sorted(found))}")
    return found.pop() if found else "csv"


def read_any(spark: SparkSession, path: str, schema: str | T.StructType | None = None, fmt: str | None = None, **options) -> DataFrame:
    """Read a path in the format it has. Without ``schema`` text formats are inferred, at the price of a scan."""
    kind = fmt or detect_format(spark, path)
    reader = spark.read
    if kind in ("csv", "tsv"):
        reader = reader.option("header", "true")
        if kind == "tsv":
            reader = reader.option("sep", "\t")
        if schema is None:
            reader = reader.option("inferSchema", "true")
        kind = "csv"
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).format(kind).load(path)


def read_permissive(spark: SparkSession, path: str, schema: str, fmt: str = "csv", **options) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt rows with their text). Malformed input does not stop the read."""
    corrupt = "_corrupt_record"
    reader = spark.read.schema(f"{schema}, {corrupt} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    rows = reader.options(**options).format(fmt).load(path)
    # readers parse only the columns a query uses, and a bad value elsewhere would go unseen: use them all
    other = F.concat_ws("", *[F.col(c).cast("string") for c in rows.columns if c != corrupt])
    broken = F.concat(F.col(corrupt), other)
    good, bad = rows.filter(broken.isNull()).drop(corrupt), rows.filter(broken.isNotNull())
    return good, bad


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """One row per ``row_tag`` element."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, name, length, modified); the content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(path).select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"))


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """A sequence file of text keys and values. Spark has no DataFrame reader for this format."""
    pairs = spark.sparkContext.sequenceFile(path)
    return pairs.map(lambda kv: (str(kv[0]), str(kv[1]))).toDF("key string, value string")


def convert(df: DataFrame, path: str, fmt: str = "parquet", codec: str | None = None, mode: str = "overwrite", **options) -> None:
    """Write in another format, compressed; ``avro`` needs its module on the class path."""
    writer = df.write.mode(mode).options(**options).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if codec:
        writer = writer.option("compression", codec)
    writer.save(path)


def compact(spark: SparkSession, path: str, target: str, target_bytes: int = 128 * 1024 * 1024, max_records: int = 0) -> int:
    """Rewrite many small Parquet files as few of about ``target_bytes``; returns the number of partitions written.

    Spark packs small files into read partitions and these are put together without a shuffle. A file that is larger than
    the target already is not divided.
    """
    total = list_files(spark, path, "*.parquet").agg(F.sum("length").alias("b")).first()["b"] or 0
    rows = spark.read.parquet(path)
    parts = min(max(1, math.ceil(total / target_bytes)), max(1, rows.rdd.getNumPartitions()))
    writer = rows.coalesce(parts).write.mode("overwrite")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(target)
    return parts


def write_table(
    df: DataFrame, name: str, mode: str = "append", partition_by: list[str] | None = None, fmt: str = "parquet",
    path: str | None = None,
) -> None:
    """Save as a table of the session catalogue (or under ``path``)."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_by(df: DataFrame, path: str, fields: list[str], mode: str = "overwrite", max_records: int = 5_000_000) -> None:
    """One folder per field value. Tasks write what they hold, so a frequent value is written by many tasks."""
    df.write.mode(mode).partitionBy(*fields).option("maxRecordsPerFile", max_records).parquet(path)
