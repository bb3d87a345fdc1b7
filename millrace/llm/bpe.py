"""BPE encoding and decoding with the files of public tokenizers; forced-boundary splitting of byte-level pieces.

A text is cut at special tokens, then by the tokenizer's word pattern. Inside a piece, two neighbouring bytes that never
stand side by side within any token of the vocabulary can never be merged over: between them there is a certain cut. The
fragments between such cuts are encoded on their own and their ids put one after another, so the work of a merge loop
follows the fragment and not the piece. Words and pieces repeat, so a worker remembers a bounded number of each.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_slices, per_worker, picked, quoted, texts_of

#: The word patterns of the two tokenizer files (the first is that of the library's byte-level splitter).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE_BEFORE = regex.compile(r"[\s\x1c-\x1f] ")
#: Texts looked up at once, in bytes: equal words among them are looked up once.
PART = 4 << 20
#: Entries of each of a memory's two generations, and the longest key kept.
REMEMBERED = 600_000
REMEMBERED_CHARS = 48
#: Fragments up to this length find the next merge in a list of the neighbours' ranks, longer ones with a heap; the order is the same.
SHORT = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for k, b in enumerate(rest):
        out[b] = chr(256 + k)
    return out


class Memory(dict):
    """Key -> ``work(key)``, in two generations: what is asked for again stays, the rest goes when a generation is full."""

    def __init__(self, work):
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.work(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class Codec:
    """Text <-> packed ids (little-endian unsigned 32 bit)."""

    def __init__(self, spec: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are packed as little-endian 32-bit numbers of the machine")
        self.runs = Memory(self.run)
        spec = json.loads(spec)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words = bool(self.suffix)
        self.pattern = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.special = {k: np.uint32(v).astype("<u4").tobytes() for k, v in special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(k) for k in sorted(special, key=len, reverse=True)) + ")") if special else None
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        back = {s: bytes([b]) for b, s in enumerate(symbols)}
        self.bytes = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            if token not in special:
                end = self.suffix if self.suffix and token.endswith(self.suffix) else ""
                self.bytes[i] = b"".join(back[c] for c in token[: len(token) - len(end)]) + (b" " if end else b"")
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.merge, self.made = {}, []
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        #: Pairs of bytes that are neighbours within some token. Any other pair marks a certain cut.
        self.side = {p for token, i in vocab.items() if token not in special for p in zip(self.bytes[i], self.bytes[i][1:])}

    def fragments(self, raw: bytes) -> list[bytes]:
        side = self.side
        cuts = [k for k, pair in enumerate(zip(raw, raw[1:]), 1) if pair not in side]
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])] if cuts else [raw]

    def merged(self, ids: list[int]) -> list[int]:
        """Apply the merges of lowest rank first, the leftmost first among equals; n log n in the fragment's length."""
        n, merge, made = len(ids), self.merge, self.made
        if n <= SHORT:
            get, never = merge.get, len(made)
            ranks = [get(p, never) for p in zip(ids, ids[1:])]
            while ranks and (rank := min(ranks)) < never:
                k = ranks.index(rank)
                new = ids[k] = made[rank]
                del ids[k + 1], ranks[k]
                if k:
                    ranks[k - 1] = get((ids[k - 1], new), never)
                if k < len(ranks):
                    ranks[k] = get((new, ids[k + 1]), never)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merge[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in merge]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if ids[k] < 0 or after[k] >= n or merge.get((ids[k], ids[after[k]])) != rank:
                continue
            gone = after[k]
            ids[k], ids[gone] = made[rank], -1
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
                if (got := merge.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (got, k))
            if before[k] >= 0 and (got := merge.get((ids[before[k]], ids[k]))) is not None:
                heapq.heappush(heap, (got, before[k]))
        return [i for i in ids if i >= 0]

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        if self.words:
            ids = list(map(self.first.__getitem__, raw))
            ids[-1] = self.last[raw[-1]]
            return array("I", self.merged(ids)).tobytes()
        parts = self.fragments(raw)
        if len(parts) == 1:
            return array("I", self.merged(list(map(self.first.__getitem__, raw)))).tobytes()
        return array("I", [i for part in parts for i in self.merged(list(map(self.first.__getitem__, part)))]).tobytes()

    def run(self, text: str) -> bytes:
        """Ids of a word run: of its only piece, or of its pieces (remembered like runs; a piece alone matches as itself)."""
        if text.isalpha() or (not self.words and text[0:1] == " " and text[1:].isalpha()):
            return self.piece(text)
        found = self.pattern.findall(text)
        return self.piece(text) if len(found) == 1 and len(found[0]) == len(text) else b"".join(map(self.runs.__getitem__, found))

    def normal(self, text: str) -> str:
        if self.words:
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # capital sigma has one small form here, wherever it stands
        return text

    def alone(self, text: str) -> bytes:
        """Ids of one text by the definition: special tokens, then pieces."""
        parts = self.cut.split(text) if self.cut else [text]
        return b"".join(self.special.get(part) or b"".join(map(self.runs.__getitem__, self.pattern.findall(self.normal(part)))) for part in parts if part)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more at the end).

        Texts are cut into word runs, equal runs are looked up once, and the ids are gathered for all places at once. A cut
        is made at white space (words) or before a single space (bytes): no piece reaches over it. Texts with special tokens,
        with the mark used for cutting or, for bytes, with white space before a space go the plain way.
        """
        odd = [k for k, t in enumerate(texts) if "\x01" in t or any(x in t for x in self.special) or (not self.words and SPACE_BEFORE.search(t))]
        own = {k: np.frombuffer(self.alone(texts[k]), dtype="<u4") for k in odd}
        rest = [None if k in own else self.normal(t) if self.words else t.replace(" ", "\x01 ") for k, t in enumerate(texts)]
        lists = pc.ascii_split_whitespace(pa.array(rest, pa.string())) if self.words else pc.split_pattern(pa.array(rest, pa.string()), "\x01")
        runs = lists.flatten().dictionary_encode()
        packed = [self.runs[r] for r in runs.dictionary.to_numpy(zero_copy_only=False).tolist()]
        size = np.array([len(x) // 4 for x in packed] or [0], dtype=np.int64)
        pool = np.frombuffer(b"".join(packed), dtype="<u4")
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        at = runs.indices.to_numpy(zero_copy_only=False)
        many = size[at] if len(at) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(many)])
        flat = pool[np.repeat(first[at] - ends[:-1], many) + np.arange(ends[-1])] if len(at) else pool[:0]
        count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = ends[np.concatenate([[0], np.cumsum(count)])]
        if not own:
            return flat, starts
        parts = [own.get(k, flat[starts[k] : starts[k + 1]]) for k in range(len(texts))]
        return np.concatenate(parts).astype("<u4"), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def codec(spec: str) -> Codec:
    """One codec per Python worker; tasks of the same worker share its memory."""
    return per_worker(f"codec {hash(spec)}", lambda: Codec(spec))


def spec_of(spark, path: str):
    """The tokenizer file, read once on the driver and broadcast (its size is fixed by the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def packed(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Ids of each text as one binary value."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((4 * starts).astype(np.int64).tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())]).cast(pa.binary())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): packed ids of every whole text; NULL reads as empty (0 tokens). Repeated rows stay repeated."""
    spec = spec_of(docs.sparkSession, path)

    def make():
        c = codec(spec.value)

        def run(part):
            flat, starts = c.encode(texts_of(part, text_col))
            return pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.diff(starts)), packed(flat, starts)], [id_col, "n_tokens", "ids"])

        return run

    return map_slices(picked(docs, id_col, text_col), text_col, f"{quoted(id_col)} {id_type(docs, id_col)}, n_tokens long, ids binary", make)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of packed ids; NULL ids give an empty text. Bytes that are no UTF-8 read as the replacement character."""
    spec = spec_of(encoded.sparkSession, path)

    def make():
        c = codec(spec.value)

        def run(part):
            ids = [np.frombuffer(x or b"", dtype="<u4") for x in part.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([part.column(id_col), pa.array(map(c.decode, ids), pa.string())], [id_col, "text"])

        return run

    return map_slices(encoded.select(quoted(id_col), "ids"), "ids", f"{quoted(id_col)} {id_type(encoded, id_col)}, text string", make)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): ``encode`` followed by ``decode`` of its ids, in one pass over every whole text."""
    spec = spec_of(docs.sparkSession, path)

    def make():
        c = codec(spec.value)

        def run(part):
            flat, starts = c.encode(texts_of(part, text_col))
            texts = [c.decode(flat[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            return pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.diff(starts)), packed(flat, starts), pa.array(texts, pa.string())], [id_col, "n_tokens", "ids", "decoded"])

        return run

    return map_slices(picked(docs, id_col, text_col), text_col, f"{quoted(id_col)} {id_type(docs, id_col)}, n_tokens long, ids binary, decoded string", make, PART)


def op2(spark, docs: DataFrame, path: str) -> DataFrame:
    out = round_trip(docs, path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
