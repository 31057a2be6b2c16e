"""WARC archives with resolved revisits.

Headers (id, url, payload digest, size) are shuffled by digest without payloads; the largest page_id of each
digest is the original, the others become revisit records out of their headers alone. Payloads of responses stay where
they are read: a bitmap of fixed size tells which pages cannot be revisits, a second one finds the responses among
the rest, and only what passes that one too is joined by id (with many millions of revisits the bitmaps let
everything through, and the join is an ordinary one). Records are put together as column expressions and written by Spark's
text writer as gzip files in the shared folder, records closed by two CRLF. Files are bounded by bytes:
`SMALL_BYTES` divides records into two writes, each with a number of records per file that keeps a file below
`FILE_BYTES` before compression, or to one record. A file is one gzip stream, so a single record is read by reading
its file. Reading takes each file as bytes,
walks the records by Content-Length and recomputes every response's digest; revisit records then join the
response with their digest, which gives payload size and the fresh reference.

A null html is an empty payload. A null page_id counts below every number; where all are null, each is a
response. Rows that repeat page_id and payload are responses each. Control characters of a url (up to 0x1F, and
0x7F) are percent-encoded in the header; a null url gives an empty target. WARC-Date is the time given to
`write_archives`, as pages hold none; each file starts with no warcinfo record of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.llm.prefilter import split_members
from surveyframe.llm.storage import shared_path, stored

_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits pairs at a time, 40 bits are eight characters."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), _HEX32, _BASE32)


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"),
        base32_sha1(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"),
    )


def revisits_of(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Stored headers of the records that revisit an original, with its id."""
    originals = stored(
        headers.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("o_digest")).agg(F.max("page_id").alias("original"))
    )
    joined = headers.join(originals, F.col("payload_digest") == F.col("o_digest")).drop("o_digest")
    return stored(joined.where(F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))))


def responses_of(read: DataFrame, headers: DataFrame, revisits: DataFrame) -> DataFrame:
    """The rows of `read` that are no revisits."""
    ids = revisits.select(F.col("page_id").alias("v_page"), F.col("payload_digest").alias("v_digest"))

    def others(rows: DataFrame) -> DataFrame:
        return rows.join(ids, F.col("page_id").eqNullSafe(F.col("v_page")) & (F.col("payload_digest") == F.col("v_digest")), "left_anti")

    known = read.where(F.col("page_id").isNotNull())
    maybe, sure = split_members(known, "page_id", ids, "v_page")
    left = others(split_members(headers.where(F.col("page_id").isNotNull()), "page_id", ids, "v_page")[0])
    left = stored(left.select(F.col("page_id").alias("l_page")))
    maybe, _ = split_members(maybe, "page_id", left, "l_page")
    return sure.unionByName(others(maybe)).unionByName(others(read.where(F.col("page_id").isNull())))


def records(roles: DataFrame, date: str) -> DataFrame:
    """The text of one WARC record per row, without the closing CRLFs."""
    target = F.coalesce(F.col("url"), F.lit(""))
    for code in (*range(32), 127):
        target = F.replace(target, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit(_HTTP + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(
        F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("original")), F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\n"))
    ).otherwise(F.lit(""))
    return roles.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")),
            F.lit("\r\nWARC-Target-URI: "), target, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
            F.lit("\r\n"), refers, F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
            F.octet_length(block).cast("string"), F.lit(END), block,
        ).alias("value")
    )


#: Bytes of a file before compression, unless one record is longer; and of a record's payload in the first write.
FILE_BYTES = 128 << 20
SMALL_BYTES = 64 << 10


def write_archives(pages: DataFrame, path: str | None = None, date: str = "2020-01-01T00:00:00Z", min_bytes: int = 0) -> str:
    """Write deduplicated archives; returns the folder."""
    path = path or shared_path(pages.sparkSession, "warc")
    read = read_pages(pages)
    headers = stored(read.drop("payload"))
    revisits = revisits_of(headers, min_bytes)
    longest = headers.agg(F.max("payload_bytes")).first()[0] or 0

    def write(rows: DataFrame, size: int) -> None:
        out = records(rows, date).write.mode("append").option("lineSep", END).option("compression", "gzip")
        out.option("maxRecordsPerFile", max(1, FILE_BYTES // max(size, 1))).text(path)

    responses = responses_of(read, headers, revisits).withColumns({"original": F.lit(None).cast("long"), "revisit": F.lit(False)})
    small = F.col("payload_bytes") <= SMALL_BYTES
    again = revisits.withColumns({"payload": F.lit(None).cast("string"), "revisit": F.lit(True)})
    write(responses.where(small).unionByName(again), SMALL_BYTES)
    if longest > SMALL_BYTES:
        write(responses.where(~small), longest)
    return path


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse(data: bytes):
    """(page_id, url, record_type, payload digest, payload bytes or None, refers_to, payload or None) per record."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)), 1 << 20)
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != END.encode():
            raise ValueError(f"record {head.get('warc-record-id')} does not end where its length says")
        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
        payload = None
        if kind == "response":
            payload = block.partition(END.encode())[2]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"record {head.get('warc-record-id')} does not match its digest")
        yield (
            _page(head.get("warc-record-id")), head.get("warc-target-uri"), kind, digest,
            None if payload is None else len(payload), _page(head.get("warc-refers-to")), payload,
        )


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives in a folder."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    width = len(names) if payloads else len(names) - 1

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                found = []
                held = 0
                for record in parse(content.as_py()):
                    found.append(record)
                    held += record[4] or 0
                    if len(found) >= 5000 or payloads and held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[k]) for k in range(width)], names=names[:width])
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[k]) for k in range(width)], names=names[:width])

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, schema)


def resolve(found: DataFrame) -> DataFrame:
    """Revisits get size and reference of the response that holds their digest."""
    originals = found.where(F.col("record_type") == "response").groupBy("payload_digest").agg(
        F.max("page_id").alias("o_page"), F.max("payload_bytes").alias("o_bytes")
    ).withColumnRenamed("payload_digest", "o_digest")
    revisit = F.col("record_type") == "revisit"
    return found.join(originals, F.col("payload_digest") == F.col("o_digest"), "left").select(
        "page_id", F.coalesce("payload_bytes", "o_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.when(revisit, F.col("o_page")).alias("refers_to"),
    )
