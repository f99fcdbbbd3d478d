"""WARC archives without repeated payloads: write, read back, resolve revisits.

Headers alone are grouped by payload digest: the smallest id of each digest becomes a ``response``,
every other record with that digest a ``revisit`` that refers to it. Joining these verdicts back moves each
payload once. The archive is written by Spark's
own text writer (payloads are UTF-8, so a record is text), whose commit protocol leaves no halves of lost
or repeated tasks, in any store Spark reaches. Files are gzipped. Reading takes each as bytes and cuts it by
Content-Length, so nothing in a payload can be mistaken for a record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 16 << 20
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"


def sha1_base32(payload: Column) -> Column:
    """Five hex digits are 20 bits, so four letters of base 32."""
    digest = F.sha1(payload)
    part = lambda i: F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda v, k: F.substring(F.lit(ALPHABET), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(letter(part(i), k) for i in range(8) for k in range(4)))


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    NULL html is an empty payload. Payloads under ``min_bytes`` are all responses. Rows that repeat the
    smallest id of a digest are responses as well; a NULL id never gives the response of others, and is
    one itself only where all ids of its digest are NULL. Counts per digest combine before the shuffle, and only the
    digests that repeat are joined, so a digest with a third of all rows costs the join narrow rows
    which Spark splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload"))
    marked = pages.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload"))})
    headers = marked.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
    firsts = headers.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = marked.join(firsts.withColumnRenamed("payload_digest", "d"), (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= min_bytes), "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to"),
    )


def record(marked: DataFrame) -> Column:
    """The whole record but its last line end: fresh headers, then the HTTP head and, in a response, the payload."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    is_revisit = F.col("record_type") == "revisit"
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"),
    )
    block = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(is_revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"),
    )
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    return F.concat(head, http, body, F.lit("\r\n")).alias("value")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archive files of ``pages`` under ``path``, each with the rows that fill ``ARCHIVE_BYTES`` at the mean size."""
    size = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    rows_per_file = max(1, int(ARCHIVE_BYTES // (size + 600)))
    marked = mark_revisits(pages, min_bytes)
    marked.select(record(marked)).write.option("lineSep", "\r\n").option("maxRecordsPerFile", rows_per_file).option("compression", "gzip").text(path)


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Header fields and block of each record of an archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields, view[start:stop]
        at = stop + 4


def number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; ``digest_ok`` tells whether a response's payload has the digest of its header."""

    def work(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in records_in(gzip.decompress(content.as_py())):
                    head = bytes(block[:200]).split(b"\r\n\r\n", 1)[0]
                    body = block[len(head) + 4 :]
                    length = int(head.rsplit(b"Content-Length: ", 1)[1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    is_revisit = fields["WARC-Type"] == "revisit"
                    ok = None if is_revisit else base64.b32encode(hashlib.sha1(body).digest()).decode() == digest and length == len(body)
                    rows.append((
                        number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"],
                        number(fields["WARC-Refers-To"]) if is_revisit else None, length, digest, ok,
                        None if is_revisit or not payloads else bytes(body),
                    ))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(work, SCHEMA)


ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary()),
])
NAMES = ARROW.names


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with ``original_id`` and ``original_bytes``: of the response that a revisit refers to, found by digest.

    A response has its own. A revisit whose response is in no archive keeps NULL there.
    """
    responses = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d"))
    originals = responses.agg(F.min("page_id").alias("original_id"), F.first("payload_bytes").alias("original_bytes"))
    revisits = records.where("record_type = 'revisit'")
    found = revisits.join(originals, F.col("payload_digest") == F.col("d"), "left").drop("d")
    own = records.where("record_type <> 'revisit'")
    return found.unionByName(own.withColumns({"original_id": F.col("page_id"), "original_bytes": F.col("payload_bytes")}))
