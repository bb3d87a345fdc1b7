"""WARC archives: revisit resolution by payload digest, deduplicated writing, reading back.

Headers (digest, size, id) are shuffled by payload digest, payloads are not: of records with equal payloads the one with the
largest id is the response, the others become revisit records that refer to it and carry no payload. Digests held by several
records are few beside all records; their table is broadcast only if it has at most ``BROADCAST_ROWS`` rows (some 10 MB),
otherwise headers alone are joined by a shuffle that deals the rows of hot digests over many tasks, and records then take their
answer by id and digest, a key that no group of copies makes hot. Archives are written by Spark's text writer, whose line separator is
the end of a WARC record, so they land on whatever store the path names. The reader takes archives of any number of gzip
members (one for the whole file, or one for each record, as most crawlers write them) and inflates them piece by piece.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import skew_join
from millrace.runtime import scratch_path

from .common import picked, quoted, written

LEAST = 1000
BROADCAST_ROWS = 100_000
#: Records of one archive file.
RECORDS = 1_000
#: Bytes that the reader inflates at a time, and bytes of payload that it passes on at a time.
PIECE = 1 << 20
END = "\r\n\r\n"


def headers(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """(_id, _url, _body, _bytes, _digest); a NULL payload reads as empty."""
    body = F.coalesce(F.col(quoted(body_col)), F.lit(""))
    url = F.coalesce(F.col(quoted(url_col)), F.lit("")) if url_col else F.lit("")
    rows = picked(pages, id_col, body_col, *([url_col] if url_col else [])).select(F.col(quoted(id_col)).cast("long").alias("_id"), url.alias("_url"), body.alias("_body"))
    return rows.withColumn("_bytes", F.octet_length("_body").cast("long")).withColumn("_digest", F.sha1(F.encode("_body", "UTF-8")))


def resolve(records: DataFrame, least: int = LEAST) -> DataFrame:
    """``records`` with _response: the id of the response that a record refers to, NULL if it is a response itself.

    Of the records with equal payloads of at least ``least`` bytes the one with the largest id is the response; rows that
    repeat its id are responses too (a repeated row stays what it is). NULL ids count as the smallest.
    """
    groups = records.where(F.col("_bytes") >= least).groupBy("_digest", "_id").agg(F.lit(1).alias("_one")).groupBy("_digest").agg(F.max("_id").alias("_largest"), F.count("_one").alias("_ids"))
    shared = written(groups.where("_ids > 1").select("_digest", "_largest"), "warc-shared")
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = records.join(F.broadcast(shared), "_digest", "left")
    else:  # headers alone meet the shared digests; a repeated id and digest has one answer, so it comes back once
        heads = records.where(F.col("_bytes") >= least).select("_digest", "_id")
        known = skew_join(heads, shared, ["_digest"], "inner").distinct()
        own = F.when(F.col("_bytes") >= least, F.struct(F.col("_id"), F.col("_digest")))
        answers = known.select(F.struct("_id", "_digest").alias("_own"), "_largest")
        found = records.withColumn("_own", own).join(answers, "_own", "left").drop("_own")
    return found.withColumn("_response", F.when(F.col("_largest").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_largest")), F.col("_largest"))).drop("_largest")


def record(date: str) -> Column:
    """One WARC/1.1 record without its end. ``_id`` names it; a revisit has an empty block and names what it refers to."""
    one_line = F.regexp_replace("_url", "[\\x00-\\x20\\x7f]", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("_response").isNotNull()
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("_id"))),
        line("WARC-Date", F.lit(date)),
        F.when(one_line != "", line("WARC-Target-URI", one_line)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("_response"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("_bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("_body")),
    )


def write(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records: int = RECORDS) -> None:
    """Archives of at most ``records`` records each, compressed, under ``path``."""
    resolved.select(record(date).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def inflated(data: bytes, piece: int = PIECE):
    """The content of all gzip members of ``data``, one after another, in pieces of at most ``piece`` bytes.

    Empty data has no content. A member that ends too early, and bytes behind the last member that are neither a member nor
    zeros (padding), are errors.
    """
    rest = data
    while rest.strip(b"\0"):
        member = zlib.decompressobj(31)
        while not member.eof:
            got = member.decompress(rest, piece)
            rest = member.unconsumed_tail
            if got:
                yield got
            elif not member.eof and not rest:
                raise ValueError("a gzip member is cut off")
        rest = member.unused_data


def parse(pieces):
    """(type, id, refers to, digest, block) of the records of one archive, in order, from its content in pieces. Blocks are found
    by their length; only the record at hand is held. An archive without content has no records."""
    source, held = iter(pieces), bytearray()

    def filled(enough) -> bool:
        while not enough():
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while filled(lambda: bool(held)):
        if not filled(lambda: b"\r\n\r\n" in held):
            raise ValueError("a WARC header is cut off")
        stop = held.index(b"\r\n\r\n")
        first, *lines = bytes(held[:stop]).split(b"\r\n")
        if first != b"WARC/1.1":
            raise ValueError("not a WARC record")
        fields = {k.lower(): v for k, _, v in (x.partition(b": ") for x in lines)}
        start = stop + 4
        end = start + int(fields[b"content-length"])
        if not filled(lambda: len(held) >= end + 4) or held[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record does not end where its length says")
        yield fields[b"warc-type"].decode(), _page(fields[b"warc-record-id"]), _page(fields.get(b"warc-refers-to")), fields[b"warc-payload-digest"].partition(b":")[2].decode(), bytes(held[start:end])
        del held[: end + 4]


def _page(urn: bytes | None) -> int | None:
    name = urn[len(b"<urn:page:") : -1] if urn else b"none"
    return None if name == b"none" else int(name)


def parts(records):
    """Records in lists of at most 200, closed when their blocks hold ``PIECE`` bytes."""
    part, held = [], 0
    for row in records:
        part.append(row)
        held += len(row[4])
        if len(part) == 200 or held >= PIECE:
            yield part
            part, held = [], 0
    if part:
        yield part


def read(spark, path: str, glob: str = "*.gz") -> DataFrame:
    """(record_type, id, refers_to, digest, payload, payload_bytes, payload_digest) of all records under ``path``.

    A response's payload size and digest are those of the bytes read; a revisit's are NULL until ``expand`` finds its response.
    A folder without archives, and empty archives, give no rows; what is no WARC/1.1 record, or is cut off, is an error.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                for part in parts(parse(inflated(content.as_py()))):
                    own = [r[0] == "response" for r in part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()),
                            pa.array([r[3] for r in part], pa.string()), pa.array([r[4] if o else None for r, o in zip(part, own)], pa.binary()),
                            pa.array([len(r[4]) if o else None for r, o in zip(part, own)], pa.int64()), pa.array([hashlib.sha1(r[4]).hexdigest() if o else None for r, o in zip(part, own)], pa.string()),
                        ],
                        ["record_type", "id", "refers_to", "digest", "payload", "payload_bytes", "payload_digest"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content")
    return files.mapInArrow(run, "record_type string, id long, refers_to long, digest string, payload binary, payload_bytes long, payload_digest string")


def expand(archive: DataFrame) -> DataFrame:
    """Headers of all records, without payloads: a revisit gets size and digest from the response with its digest."""
    rows = archive.drop("payload")
    originals = rows.where("record_type = 'response'").join(rows.where("record_type = 'revisit'").select("digest").distinct(), "digest", "left_semi")
    originals = originals.groupBy("digest").agg(F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_sha1"))
    found = rows.join(originals, "digest", "left")
    return found.select("id", "record_type", "refers_to", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "_sha1").alias("payload_digest"))


def op10(spark, pages: DataFrame) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(resolve(headers(pages)), path)
    stored = written(read(spark, path).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "warc-headers")
    out = expand(stored)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
