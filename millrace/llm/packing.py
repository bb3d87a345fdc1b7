"""Best-fit packing of token sequences: vector best-fit under three capacities.

A bin (sequence) has room for tokens, for pieces, and for attention cost (the sum of squared piece lengths). Pieces go, the
longest first, into the open bin that fits under every capacity and whose residual vector is best for the piece: the largest
weighted dot-product with it, or the smallest weighted norm of what would be left; a new bin opens only if none fits.
Pieces are dealt by hash into groups of about ``GROUP`` and each group is packed in one task, so a task's memory is bounded
and only the few last bins of a group stay open. Text ids come from the tokenizer file (see ``bpe``).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PART, codec, spec_of
from .common import id_type, map_slices, picked, quoted, texts_of, written

GROUP = 16_384


@dataclass(frozen=True)
class Capacity:
    """Capacities of a bin. ``pieces`` and ``attention`` None: as many as the tokens allow (they never bind)."""

    tokens: int = 2048
    pieces: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces or self.tokens, self.attention or self.tokens**2], dtype=np.float64)


def pack(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece. Raises if one piece alone breaks a capacity."""
    size, weight = cap.vector(), np.array(cap.weights)
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return bins, offsets
    if lengths.max() > size[0] or lengths.max() ** 2 > size[2] or size[1] < 1:
        raise ValueError("a piece is larger than a sequence's capacity")
    least = lengths.min()
    left, name, used, made = np.zeros((n, 3)), np.zeros(n, dtype=np.int64), 0, 0
    for i in np.lexsort((np.arange(n), -lengths)):
        item = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        room = left[:used]
        fits = np.flatnonzero((room >= item).all(1)) if used else ()
        if len(fits):
            r = room[fits]
            value = (r * item / size**2) @ weight if cap.rule == "dot" else -((((r - item) / size) ** 2) @ weight)
            k = fits[int(np.argmax(value))]
        else:
            k, used = used, used + 1
            left[k], name[k] = size, made
            made += 1
        bins[i], offsets[i] = name[k], cap.tokens - left[k, 0]
        left[k] -= item
        if left[k, 0] < least or left[k, 1] < 1 or left[k, 2] < float(least) ** 2:  # nothing fits any more
            used -= 1
            left[k], name[k] = left[used], name[used]
    return bins, offsets


def pieces(docs: DataFrame, path: str, tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): the ids of every whole text and then ``end_id``, cut only where longer than ``tokens``.

    A NULL or empty text has the end id alone. Repeated rows stay repeated.
    """
    spec = spec_of(docs.sparkSession, path)
    end = int(end_id).to_bytes(4, "little")

    def make():
        c = codec(spec.value)

        def run(part):
            row, piece, start, length, crc = [], [], [], [], []
            flat, starts = c.encode(texts_of(part, text_col))
            for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                ids = memoryview(flat[a:b].tobytes() + end)
                for j, at in enumerate(range(0, len(ids), 4 * tokens)):
                    own = ids[at : at + 4 * tokens]
                    row.append(k)
                    piece.append(j)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            return pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

        return run

    return map_slices(picked(docs, id_col, text_col), text_col, f"{quoted(id_col)} {id_type(docs, id_col)}, piece int, start long, length long, ids_crc32 long", make, PART)


def pack_pieces(cut: DataFrame, cap: Capacity = Capacity(), id_col: str = "doc_id", group: int = GROUP) -> DataFrame:
    """``cut`` with sequence_id and offset. Rows are dealt to groups by their place in the stored table, so repeated rows spread too."""
    stored = written(cut, "packing-pieces")
    groups = max(1, -(-stored.count() // group))

    def packed(key, rows):
        rows = rows.drop_columns(["_group"]).sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending")])
        bins, offsets = pack(rows.column("length").to_numpy(), cap)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = stored.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in stored.schema.fields)
    return dealt.groupBy("_group").applyInArrow(packed, f"{fields}, sequence_id long, offset long")


def op6(spark, docs: DataFrame, path: str) -> DataFrame:
    return pack_pieces(pieces(docs, path))
