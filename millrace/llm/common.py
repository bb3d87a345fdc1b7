"""Helpers shared by the operators: folds, bounded batches, byte views, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import scratch_path

#: Texts are handled in slices of about this many bytes, so a task's memory does not follow the batch or the file.
SLICE_BYTES = 1 << 20


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def picked(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name: other columns may have any name, also one that differs only in case."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).select(*[F.col(f"c{k}").alias(n) for k, n in zip(at, names)])


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


#: Spark's own option to remove the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` stored once on the shared folder and read back: it survives lost executors and is not computed again.

    One folder for each value of the last columns ``by``, if there are any. The shuffle files of the write are removed with it; the session's setting is put back.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a stored table that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose texts hold about ``budget`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a slice; NULL reads as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


_state: dict[str, object] = {}


def per_worker(name: str, make: Callable[[], object] = dict):
    """State that the tasks of one Python worker share. A worker holds one at a time: the next operator's state replaces it, so
    the memory of a worker does not add up over the steps of a job."""
    if name not in _state:
        _state.clear()
        pa.default_memory_pool().release_unused()
        _state[name] = make()
    return _state[name]


def map_slices(df: DataFrame, text_col: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], budget: int = SLICE_BYTES) -> DataFrame:
    """``make()`` builds, once per task, the function that turns a slice into result rows."""

    def run(batches):
        fn = make()
        for batch in batches:
            for part in slices(batch, text_col, budget):
                yield fn(part)

    return df.mapInArrow(run, schema)


def byte_view(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and each text's first position (one more at the end)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    starts = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=starts[1:])
    return np.frombuffer(b"".join(raw), dtype=np.uint8), starts
