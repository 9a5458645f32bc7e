"""Content-addressed WARC archive.

``archive`` splits records into two tables: ``headers`` keeps the exact header bytes of every record
with the SHA-256 digest of its payload, ``store`` keeps every payload once, by digest.
``reconstruct`` joins them into the original bytes.  Digests are verified: the payloads that share one
must agree in length and in a second hash, and a payload taken from the store must have the digest
that it is stored under; what fails is reported in ``verified``, never dropped.

``read`` takes WARC files apart, plain or compressed by record, ``page_records`` makes records of a
table of pages.

Records carry the WARC-Date that they are given, by default the epoch's begin: a table of pages has
none, and an archive of the same pages should have the same bytes.

Defined cases: a null page has no payload and no digest, and a record of length 0; null urls and ids
leave their header lines out.  Repeated rows are records of their own that share a payload.  An
empty table gives empty tables.  Other columns are kept in headers; digest and length are replaced.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import BATCH_BYTES

END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
_RECORD = "record_id string, header binary, payload binary"


def page_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, url, record_id, header, payload): one resource record per page.  The header ends
    with its blank line; after the payload every record has two line ends."""
    payload = F.encode(F.col("html").cast("string"), "UTF-8")
    page, url = F.col("page_id").cast("bigint"), F.col("url").cast("string")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    record = F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\n"), line("WARC-Record-ID", record), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(payload, 256))),
        line("Content-Length", F.coalesce(F.octet_length(payload), F.lit(0)).cast("string")), F.lit("\r\n"),
    )
    return pages.select(page.alias("page_id"), url.alias("url"), record.alias("record_id"), F.encode(header, "UTF-8").alias("header"), payload.alias("payload"))


def archive(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, store) of records with header and payload: headers has all other columns, with
    digest and length; store has (digest, payload, copies, verified)."""
    digest = F.sha2("payload", 256)
    headers = records.withColumns({"digest": digest, "length": F.octet_length("payload").cast("bigint")}).drop("payload")
    size, second = F.octet_length("payload"), F.xxhash64("payload")
    store = (
        records.where("payload is not null").select(digest.alias("digest"), "payload", size.alias("size"), second.alias("second"))
        .groupBy("digest").agg(
            F.first("payload").alias("payload"), F.count("*").alias("copies"),
            ((F.min("size") == F.max("size")) & (F.min("second") == F.max("second"))).alias("verified"),
        )
    )
    return headers, store


def reconstruct(headers: DataFrame, store: DataFrame) -> DataFrame:
    """headers with record, the original bytes, and verified."""
    joined = headers.join(store.select("digest", "payload", F.col("verified").alias("__agree")), "digest", "left")
    same = F.col("digest").isNull() | (F.col("__agree") & (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("length")))
    return joined.withColumns(
        {"record": F.concat("header", F.coalesce("payload", F.lit(b"")), F.lit(END)), "verified": F.coalesce(same, F.lit(False))}
    ).drop("payload", "__agree")


def _plain(stream: BinaryIO, size: int) -> Iterator[bytes]:
    """The bytes of a file in pieces; a compressed file is inflated member by member, and breaks off
    where it can't be inflated any more."""
    rest, inflate = stream.read(max(size, 2)), None
    packed = rest[:2] == b"\x1f\x8b"
    while rest:
        if not packed:
            yield rest
        while packed and rest:
            inflate = inflate or zlib.decompressobj(31)
            try:
                yield inflate.decompress(rest)
            except zlib.error:
                return
            rest = inflate.unused_data
            inflate = None if inflate.eof else inflate
        rest = stream.read(size)


def split(stream: bytes | BinaryIO, size: int = 1 << 20) -> Iterator[tuple[str | None, bytes, bytes]]:
    """(record id, header with its blank line, payload) of the records of a WARC file, plain or
    compressed, of which one record at a time is held.  A file that breaks off gives what is whole."""
    pieces = _plain(io.BytesIO(stream) if isinstance(stream, bytes) else stream, size)
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while len(held) < 2 and more():
            pass
        if held[:2] == b"\r\n":
            del held[:2]
            continue
        seen = 0
        while (end := held.find(END, seen)) < 0:
            seen = max(len(held) - 3, 0)
            if not more():
                return
        header = bytes(held[: end + 4])
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in header.split(b"\r\n")[1:])}
        try:
            length = int(fields.get(b"content-length", b"0"))
        except ValueError:
            return
        while len(held) < end + 4 + length:
            if not more():
                return
        name = fields.get(b"warc-record-id")
        yield name.decode("utf-8", "replace") if name is not None else None, header, bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, record_id, header, payload) of the WARC files under path, which the executors open
    and read record by record; place counts the records of a file."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "place", "record_id", "header", "payload"])

        for batch in batches:
            for name in batch.column("path").to_pylist():
                # of local files Spark gives one slash, and escapes
                local = re.match(r"file:/+(.*)", name)
                system, inside = fs.FileSystem.from_uri(f"/{unquote(local[1])}" if local else name)
                with system.open_input_file(inside) as stream:
                    rows, held = [], 0
                    for place, record in enumerate(split(stream)):
                        rows.append((name, place, *record))
                        held += len(record[1]) + len(record[2])
                        if held >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(records, f"path string, place bigint, {_RECORD}")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, length, record, verified) of every page: archived, and
    reconstructed from the archive."""
    headers, store = archive(page_records(pages))
    rows = reconstruct(headers, store)
    return rows.select("page_id", "url", "digest", "length", F.decode("record", "UTF-8").alias("record"), "verified")


ROUND_TRIP_SQL = r"""
SELECT page_id, url, sha256(html) AS digest, CAST(octet_length(encode(html)) AS BIGINT) AS length,
       'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
       || coalesce('WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10), '')
       || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
       || coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), '')
       || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
       || coalesce('WARC-Payload-Digest: sha256:' || sha256(html) || chr(13) || chr(10), '')
       || 'Content-Length: ' || coalesce(octet_length(encode(html)), 0) || chr(13) || chr(10) || chr(13) || chr(10)
       || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record,
       true AS verified
FROM pages
"""
