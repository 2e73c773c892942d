"""WARC archives as a chunked record table.

Writing: a record's payload comes to the writer as rows (record, chunk_no, bytes) of at most CHUNK bytes, one after the
other, and each task streams its rows into one archive in the shared folder and reports it in a manifest; a lost task is
run again under another file name, and only files of the manifest are ever read. Reading: a record's block becomes such
rows again, each with the digest of the payload up to there. Neither side's Python holds more of a record than one chunk
and what Spark puts into one Arrow batch.

Archives are opened with pyarrow.fs, which takes the shared folder's own scheme.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

CHUNK = 256 * 1024
#: Payloads of fewer bytes are never deduplicated.
MIN_BYTES = 0
#: Digests of repeated payloads that may be broadcast (some 20 MB), the most frequent first; more are joined by a shuffle.
KNOWN_ROWS = 100_000
#: Bits of the filter that tells which rows that join is for (8 MB, whatever there is of digests), and bits of a digest.
BLOOM_BITS, HASHES = 1 << 26, 4
_RECORD, _NO_RECORD = "<urn:page:%s>", "<urn:page-without-id>"
_VERSION = b"WARC/1.1\r\n"
#: Fixed date: a rewritten archive is the same, byte for byte.
_DATE = "2024-01-31T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = (
    "page_id string, record_type string, refers_to string, chunk_no int, last boolean, payload_bytes long, "
    "payload_digest string, data binary"
)


def _clean(value: str | None) -> str:
    """A header value has no line breaks."""
    return "".join(c for c in (value or "") if c >= " " and c != "\x7f")


def _open(uri: str, write: bool) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None) if write else system.open_input_stream(path, compression=None)


def _record_id(page_id: str | None) -> str:
    """An id may hold anything; a null id is not an empty one."""
    return _NO_RECORD if page_id is None else _RECORD % quote(page_id, safe="")


def _page_id(record_id: str) -> str | None:
    return None if record_id == _NO_RECORD else unquote(record_id[len("<urn:page:") : -1])


def _head(page_id: str | None, url: str | None, size: int, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind, body = ("response", size) if refers_to is None else ("revisit", 0)
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + body}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    return _VERSION + "".join(f"{h}\r\n" for h in head).encode() + b"\r\n" + http


def _sha1_32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _positions(sha1: Column, bits: int) -> list[Column]:
    return [F.conv(F.substring(sha1, 1 + 8 * k, 8), 16, 10).cast("long") % bits for k in range(HASHES)]


def _maybe_among(digests: DataFrame, sha1: Column) -> Column:
    """False for a digest that is none of digests(q_sha1), by a Bloom filter of BLOOM_BITS, which is all that is gathered."""
    at = digests.select(F.explode(F.array(*_positions(F.col("q_sha1"), BLOOM_BITS))).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    table = np.zeros(BLOOM_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = digests.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    @F.pandas_udf("boolean")
    def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = shared.value
        for hexadecimal in batches:
            raw = np.frombuffer(bytes.fromhex("".join(hexadecimal)), ">u4").reshape(-1, 5)[:, :HASHES]
            places = raw.astype(np.uint64) % np.uint64(64 * len(words))
            yield pd.Series((words[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)).all(axis=1))

    return maybe(sha1)


def _marked(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows(page_id, number, url, payload, sha1) with refers_to, and without the payloads of those that refer.

    again(r_sha1, first, n): the digests that repeat. The most frequent are broadcast. If there are more, only rows whose
    digest may be one of these, by a Bloom filter, are joined by a shuffle; all others, those of unique payloads first,
    stay where they are read."""
    total = again.count()
    most = again if total <= KNOWN_ROWS else materialise(again.orderBy(F.desc("n"), "r_sha1").limit(KNOWN_ROWS), "most-repeated")
    rows = rows.join(F.broadcast(most.select("r_sha1", "first")), F.col("sha1") == F.col("r_sha1"), "left")

    def refer(rows: DataFrame) -> DataFrame:
        revisits = F.col("r_sha1").isNotNull() & ~F.col("number").eqNullSafe(F.col("first"))
        rows = rows.withColumn("refers_to", F.when(revisits, F.col("first").cast("string")))
        return rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))

    rows = refer(rows)
    if total > KNOWN_ROWS:
        rest = again.join(F.broadcast(most.select("r_sha1")), "r_sha1", "left_anti")
        rest = materialise(rest.select(F.col("r_sha1").alias("q_sha1"), F.col("first").alias("q_first")), "less-repeated")
        rows = rows.withColumn("_maybe", F.col("r_sha1").isNull() & _maybe_among(rest, F.col("sha1")))
        found = rows.where("_maybe").join(rest, F.col("sha1") == F.col("q_sha1"), "left")
        found = refer(found.withColumns({"r_sha1": F.col("q_sha1"), "first": F.col("q_first")})).drop("q_sha1", "q_first")
        rows = rows.where("not _maybe").unionByName(found).drop("_maybe")
    return rows


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html); returns the manifest (uri, records, bytes).

    Of records whose payloads (html in UTF-8, null: empty) are equal and have min_bytes or more, that with the smallest
    page_id is the response and the others revisit it. Equal payloads are found by their digests: a count per digest
    with partial sums, of slim (page_id, digest) rows. Payloads stay where they are read, but for those of digests that
    repeat less than the KNOWN_ROWS most frequent do (and one in some hundreds that a Bloom filter takes for one).
    """
    rows = pages.select(
        F.col("page_id").cast("string").alias("page_id"),
        F.col("page_id").alias("number"),
        "url",
        F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"),
    ).withColumns({"sha1": F.sha1("payload"), "size": F.length("payload").cast("long")})
    slim = rows.where(F.col("size") >= min_bytes).select("number", "sha1")
    again = slim.groupBy("sha1").agg(F.count("*").alias("n"), F.min("number").alias("first")).where("n > 1")
    again = materialise(again.select(F.col("sha1").alias("r_sha1"), "first", "n"), "repeated")
    last = F.greatest(F.ceil(F.length("payload") / CHUNK) - 1, F.lit(0))
    rows = _marked(rows, again).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.coalesce(last, F.lit(0)).cast("int"))))
    piece = F.substring(F.col("payload"), F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))
    rows = rows.select("page_id", "url", "size", "sha1", "refers_to", "chunk_no", piece.alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, records = f"{folder}/{uuid.uuid4().hex}.warc", None, 0
        stated, digest = "", None

        def end() -> None:
            if digest is not None and digest.hexdigest() != stated:
                raise ValueError(f"a payload's digest is {digest.hexdigest()}, not {stated}")
            out.write(b"\r\n\r\n")

        for batch in batches:
            out = out or _open(uri, True)
            for row in zip(*(batch.column(i) for i in range(7)), strict=True):
                chunk_no, data = row[5].as_py(), row[6].as_py()
                if chunk_no == 0:
                    if records:
                        end()
                    page_id, url, size, stated, refers_to = (x.as_py() for x in row[:5])
                    out.write(_head(page_id, url, size, _sha1_32(stated), refers_to))
                    digest = hashlib.sha1() if refers_to is None else None
                    records += 1
                if data:
                    digest.update(data)
                    out.write(data)
        if out is not None:
            end()
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [records], "bytes": [size]})

    return materialise(rows.mapInArrow(run, "uri string, records long, bytes long"), "manifest")


def _line(stream: BinaryIO, buffer: bytearray) -> bytes | None:
    """Up to and without CRLF; None at the end."""
    while (at := buffer.find(b"\r\n")) < 0:
        more = stream.read(65536)
        if not more:
            return None
        buffer += more
    line = bytes(buffer[:at])
    del buffer[: at + 2]
    return line


def _headers(stream: BinaryIO, buffer: bytearray) -> tuple[dict[str, str], int]:
    """The fields up to an empty line, and the bytes that they took."""
    found, size = {}, 0
    while line := _line(stream, buffer):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
        size += len(line) + 2
    return found, size + 2


def _pieces(stream: BinaryIO, buffer: bytearray, size: int) -> Iterator[bytes]:
    """The next size bytes in chunks of CHUNK, the last one smaller."""
    while size:
        n = min(size, CHUNK)
        while len(buffer) < n:
            more = stream.read(n - len(buffer))
            if not more:
                raise ValueError("the archive ends within a record")
            buffer += more
        piece = bytes(buffer[:n])
        del buffer[:n]
        size -= n
        yield piece


def read_records(stream: BinaryIO) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA from one archive. An empty payload is one chunk of no bytes. A revisit has the length and
    digest that its headers state; a response's digest is computed and must be the stated one."""
    buffer = bytearray()
    while (version := _line(stream, buffer)) is not None:
        if not version:
            continue
        head, _ = _headers(stream, buffer)
        http, taken = _headers(stream, buffer)
        left = int(head["content-length"]) - taken
        page_id = _page_id(head["warc-record-id"])
        kind, stated = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "revisit":
            yield page_id, kind, _page_id(head["warc-refers-to"]), 0, True, int(http["content-length"]), stated, b""
        else:
            sha1, n, done = hashlib.sha1(), 0, 0
            for piece in _pieces(stream, buffer, left) if left else [b""]:
                sha1.update(piece)
                done += len(piece)
                digest = base64.b32encode(sha1.digest()).decode()
                if done == left and digest != stated:
                    raise ValueError(f"page {page_id}: the payload's digest is {digest}, not {stated}")
                yield page_id, kind, None, n, done == left, done, digest, piece
                n += 1


def read_chunks(manifest: DataFrame, data: bool = True) -> DataFrame:
    """The chunk table of the archives: CHUNK_SCHEMA. payload_bytes and payload_digest are of the payload up to the end
    of the chunk, so of the whole payload in a record's last row. Without data, the bytes stay in the reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "refers_to", "chunk_no", "last", "payload_bytes", "payload_digest", "data"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for uri in batch.column("uri"):
                rows, size = [], 0
                with _open(uri.as_py(), False) as stream:
                    for row in read_records(stream):
                        rows.append(row if data else (*row[:-1], None))
                        size += len(row[-1]) if data else 0
                        if len(rows) == 4096 or size > 8 * CHUNK:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    # One archive a task: a shuffle of names alone.
    n = max(manifest.count(), 1)
    return manifest.select("uri").repartition(n, "uri").mapInArrow(run, CHUNK_SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return folder


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: what reading back the archives of
    pages(page_id, url, html) gives, one row per row.

    Null html: an empty payload (equal to other empty ones). Null url: an empty target. Null page_id: a record without
    a number, null in the result; it is never the first of equal payloads that have one. Rows that repeat a page_id
    with one payload: each is a response if it has the smallest id, so rows that repeat give rows that repeat. Other
    columns are not read. Empty table: no archives, an empty result.
    """
    kind = pages.schema["page_id"].dataType
    manifest = write_archives(pages, archive_folder(pages.sparkSession), min_bytes)
    chunks = read_chunks(manifest, data=False).where("last")
    return chunks.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
