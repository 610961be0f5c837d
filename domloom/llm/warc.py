"""WARC archives: writing, reading, and resolution of repeated payloads to revisit records.

Archives are WARC/1.1 files, gzip-compressed as a whole, written by Spark's text writer with
the record end as the line separator, so that they go to whatever store the path names.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom.llm.text import or_empty

# Fixed values of the WARC 1.1 format and of RFC 4648.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_END = "\r\n\r\n"

#: Characters that ``conv`` writes for the digits 0 to 31.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_id", pa.string()), ("payload", pa.binary()),
])


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1. 20 bits at a time: five hex digits are four of base32."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32)


def record_headers(pages: DataFrame) -> DataFrame:
    """``page_id, target_uri, payload_digest, payload_bytes`` of ``pages`` (``page_id, url, html``)."""
    payload = or_empty(F.col("html")).cast("binary")
    return pages.select(
        "page_id", F.col("url").alias("target_uri"), payload_digest(payload).alias("payload_digest"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
    )


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, payload_digest, payload_bytes, refers_to, refers_to_uri`` of the records that
    repeat an earlier payload.

    Of records with equal digest and length the one with the largest ``page_id`` is the
    response. Headers are shuffled by digest with partial maxima; payloads are not moved, and a
    digest may have any share of the records. Records below ``min_bytes`` are all responses.

    Rows that repeat a page id and its payload are one row here; those that repeat the
    response's are responses too. Rows with a null page id revisit nothing and are not revisited
    unless no row with the payload has an id; then all are responses.
    """
    large = headers.where(F.col("payload_bytes") >= min_bytes)
    first = large.groupBy("payload_digest", "payload_bytes").agg(
        F.max(F.struct("page_id", "target_uri")).alias("original"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").drop("n")
    return large.join(first, ["payload_digest", "payload_bytes"]).where("page_id <> original.page_id").select(
        "page_id", "payload_digest", "payload_bytes",
        F.col("original.page_id").alias("refers_to"), F.col("original.target_uri").alias("refers_to_uri"),
    ).distinct()


def write_archives(pages: DataFrame, revisits: DataFrame, path: str, date: str, records_per_file: int = 2_000) -> None:
    """Archives with fresh headers: a response or revisit record for each of ``pages``.

    A file holds at most ``records_per_file`` records, which bounds what a reading task loads.
    Revisits are found by id and payload, so pages that share an id keep their own payloads. A
    page with a null id is a response whose record id is named by its URL and digest. Line ends
    in a URL would end its header line and are written as percent codes.
    """
    payload = F.col("__html").cast("binary")
    base = pages.select("page_id", "url", or_empty(F.col("html")).alias("__html")).withColumns({
        "payload_digest": payload_digest(payload), "payload_bytes": F.octet_length(payload).cast("bigint"),
    }).join(revisits, ["page_id", "payload_digest", "payload_bytes"], "left")
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(RECORD_END))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("__html")))

    def line(name: str, *value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), *value)

    record = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), _named_urn(or_empty(F.col("url")), F.col("payload_digest")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("payload_digest")),
        F.when(is_revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", _urn(F.col("refers_to"))),
            line("WARC-Refers-To-Target-URI", _one_line(F.col("refers_to_uri"))),
            line("WARC-Refers-To-Date", F.lit(date)),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit(RECORD_END), block,
    )
    base.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: one row each, with its headers and payload.

    Files are read whole, one at a time, and cut by their Content-Length headers, so a payload
    may hold anything. ``payload_bytes`` is what the HTTP header announces, which a revisit
    states too, though it has no payload.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse_batches, "record_id string, record_type string, page_id bigint, target_uri string, payload_digest string, payload_bytes bigint, refers_to_id string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Records with ``refers_to``: the page of the response a revisit points to, by its record id.

    Responses that repeat a record id count once here, so no record is multiplied.
    """
    originals = records.where("record_type = 'response' AND page_id IS NOT NULL").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    ).distinct()
    revisits = records.where("record_type = 'revisit'").join(originals, ["refers_to_id"], "left")
    responses = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint"))
    return responses.unionByName(revisits)


def _urn(page_id: Column) -> Column:
    """A UUID in the layout of version 8 (free use) that holds the page id."""
    digits = F.lpad(F.lower(F.hex(page_id.cast("bigint"))), 16, "0")
    part = lambda start, n: F.substring(digits, start, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8000-"), part(16, 1), F.lit("00000000000>"))


def _named_urn(*names: Column) -> Column:
    """A UUID in the layout of version 3 (named by an MD5)."""
    digits = F.md5(F.concat_ws("\n", *names))
    part = lambda start, n: F.substring(digits, start, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _one_line(uri: Column) -> Column:
    return F.replace(F.replace(or_empty(uri), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows: list[dict] = []
            size = 0
            for record in parse_records(content.as_buffer().to_pybytes()):
                rows.append(record)
                size += len(record["payload"] or b"")
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, RECORD)


def parse_records(content: bytes) -> Iterator[dict]:
    """Records of one archive, compressed as a whole, by record, or not at all."""
    stream = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = _fields(stream)
        block = io.BytesIO(stream.read(int(head["content-length"])))
        row = {
            "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"),
            "page_id": _page_of(head.get("warc-record-id", "")), "target_uri": head.get("warc-target-uri"),
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
            "refers_to_id": head.get("warc-refers-to"), "payload": None,
        }
        http = {}
        if head.get("content-type", "").startswith("application/http"):
            block.readline()
            http = _fields(block)
        payload = block.read()
        row["payload_bytes"] = int(http.get("content-length", len(payload)))
        if row["record_type"] != "revisit":
            row["payload"] = payload
        yield row


def _fields(stream) -> dict[str, str]:
    fields = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.partition(b":")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields


def _page_of(record_id: str) -> int | None:
    digits = record_id.removeprefix("<urn:uuid:").removesuffix(">").replace("-", "")
    if len(digits) != 32 or digits[12] != "8":
        return None
    number = int(digits[:12] + digits[13:16] + digits[20], 16)
    return number - (1 << 64) if number >> 63 else number
