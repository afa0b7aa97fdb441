"""WARC: archives written from captures, read back and assembled into one row per capture.

Writing: each page gives a request, a response (or, for a payload that an earlier page
has, a revisit without the payload) and a metadata record; the latter two name the first
through WARC-Concurrent-To. Records are UTF-8 text, so Spark's text writer with the
record end as line separator lays down valid gzipped archives on any store Spark writes to.
Reading: every archive is unpacked and parsed piece by piece by Content-Length (payloads may hold any separator), the
records of a capture are joined through the concurrent-to ids and revisits through
WARC-Refers-To.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import salted_join
from .store import materialize

CRLF = "\r\n"
#: Fixed value: what ends a record.
RECORD_END = "\r\n\r\n"
#: Fixed value: base 32 digits as conv() writes them, and as RFC 4648 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload bytes of an archive on average, and records of one without payloads; one archive is parsed by one task at a time.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 100_000
#: Bytes unpacked at once.
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

PARSED = (
    "record_id string, record_type string, concurrent_to string, refers_to_record string, target_uri string, "
    "payload_digest string, block_bytes long, payload_bytes long, computed_digest string, page_id long, payload binary"
)


def base32_sha1(column):
    """Bare upper-case base32 SHA-1 of a text or binary column."""
    hexed = F.sha1(column)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def record_id(kind: str, capture: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), capture))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _capture(page_id: Column, url: Column, digest: Column, nth: Column) -> Column:
    """Text that names a capture; rows that are equal throughout differ in ``nth``."""
    return F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest, nth.cast("string"), F.coalesce(F.concat(F.lit("u"), url), F.lit("-")))


def _record(kind: str, rid: Column, url: Column, extra: list[Column], block: Column, media: str) -> Column:
    """Text of a record; line breaks in urls become %0D and %0A."""
    safe = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), safe, F.lit(CRLF)), F.lit(""))
    head = [F.lit("WARC/1.1" + CRLF + f"WARC-Type: {kind}" + CRLF + "WARC-Record-ID: "), rid, F.lit(CRLF + f"WARC-Date: {DATE}" + CRLF), target]
    tail = [F.lit(f"Content-Type: {media}" + CRLF + "Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block]
    return F.concat(*head, *extra, *tail)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files under ``path``: a capture of three records for every row.

    Null html is an empty payload; a null url leaves WARC-Target-URI out, a null id the metadata's page-id.
    Of rows with equal payloads the first by page id (null last), then url (null last) has the
    response; the others, rows that repeat it throughout included, revisit it. A payload meets its equals map-side
    and is written once; nothing but digests and urls is joined.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", base32_sha1(F.col("html")))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    payloads = p.groupBy("digest").agg(F.min(order).alias("first"), F.any_value("html").alias("html"))
    payloads = materialize(payloads.withColumn("bytes", F.octet_length("html").cast("long")), "warc-payloads")
    rows = p.groupBy("digest", "page_id", "url").agg(F.count("*").cast("int").alias("copies")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    rows = rows.join(payloads.select("digest", "first"), "digest")

    own, url = _capture(F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth")), F.col("url")
    first = _capture(F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(1))
    concurrent = lambda c: [F.lit("WARC-Concurrent-To: "), record_id("request", c), F.lit(CRLF)]
    digest = [F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF)]
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(""))
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "^[^:]+://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF))
    refers = [F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "), record_id("response", first), F.lit(CRLF)]
    request = _record("request", record_id("request", own), url, [], get, "application/http;msgtype=request")
    metadata = _record("metadata", record_id("metadata", own), url, concurrent(own), about, "application/warc-fields")
    revisit = _record("revisit", record_id("response", own), url, [*concurrent(own), *refers, *digest], F.lit(HTTP_OK), "application/http;msgtype=response")
    response = _record("response", record_id("response", first), F.col("first.url"), [*concurrent(first), *digest], F.concat(F.lit(HTTP_OK), F.col("html")), "application/http;msgtype=response")

    size = payloads.agg(F.avg("bytes")).head()[0] or 1
    archive = lambda df, records: df.write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(records))).text(path)
    archive(payloads.select(response.alias("value")), ARCHIVE_BYTES / max(1, size))
    archive(rows.select(F.explode(F.array_compact(F.array(request, F.when(own != first, revisit), metadata))).alias("value")), ARCHIVE_RECORDS)


def unpacked(data: memoryview) -> Iterator[bytes]:
    """The content of a plain or gzipped archive (of one or many members), ``PIECE`` bytes at once at most."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + PIECE]) for i in range(0, len(data), PIECE))
        return
    at = 0
    while at < len(data):
        member, left = zlib.decompressobj(31), b""
        while not member.eof and (left or at < len(data)):
            if not left:
                left = data[at : at + PIECE]
                at += len(left)
            yield member.decompress(left, PIECE)
            left = member.unconsumed_tail
        at -= len(member.unused_data)


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record; a record that the archive cuts off is left out."""
    held, need, headers = bytearray(), -1, {}
    for piece in pieces:
        held += piece
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                lines = held[:end].decode("utf-8", "replace").split("\r\n")
                headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                need = int(headers.get("content-length", "0"))
                del held[: end + 4]
            if len(held) < need + 4:
                break
            yield headers, bytes(held[:need])
            del held[: need + 4]
            need = -1


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per WARC record of the archives under ``path``, digests computed over whole payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            *[(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to_record", "target_uri", "payload_digest")],
            ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for h, block in parse_records(unpacked(memoryview(data.as_buffer()))):
                    kind, page, payload = h.get("warc-type"), None, b""
                    if kind in ("response", "revisit"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    if kind == "metadata" and b"page-id: " in block:
                        page = int(block.partition(b"page-id: ")[2].split(b"\r\n")[0])
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    stated = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), stated, len(block), len(payload), digest, page, payload if with_payload else None))
                    held += len(payload)
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, PARSED)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id`` and the structs ``request``, ``response``, ``metadata``.

    Records belong together if they name the same record through concurrent-to, or are it. A
    capture that lacks a record has a null struct there; of repeated records with one id and type one stays.
    """
    nested = F.struct(*[c for c in records.columns if c != "record_type"])
    pick = lambda *kinds: F.max(F.when(F.col("record_type").isin(*kinds), F.struct("record_type", nested.alias("r"))))
    return (
        records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id"))
        .agg(pick("request").alias("q"), pick("response", "revisit").alias("p"), pick("metadata").alias("m"))
        .select("capture_id", F.col("q.r").alias("request"), F.col("p.r").alias("response"), F.col("p.record_type").alias("response_type"), F.col("m.r").alias("metadata"))
    )


def resolve(captures: DataFrame) -> DataFrame:
    """Per page: payload size and digest, record type and the page that a revisit refers to.

    A revisit takes its payload's size from the response it refers to; the digest of a response is
    computed from the archive, that of a revisit is what its record states.
    """
    c = captures.select(
        F.col("metadata.page_id").alias("page_id"), F.col("response_type").alias("record_type"), F.col("response.record_id").alias("rid"),
        F.col("response.refers_to_record").alias("ref"), F.col("response.payload_bytes").alias("bytes"),
        F.when(F.col("response_type") == "response", F.col("response.computed_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.target_uri").alias("target_uri"),
    )
    c = materialize(c, "warc-captures")
    whole = c.filter("record_type = 'response'").select(F.col("rid").alias("ref"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("payload_bytes"))
    # only revisits look for a response, and those of one response lie in many tasks
    revisit = F.col("record_type").eqNullSafe("revisit")
    again = salted_join(c.filter(revisit).drop("bytes"), whole, ["ref"], F.xxhash64("rid"), "left")
    once = c.filter(~revisit).withColumn("refers_to", F.lit(None).cast("long")).withColumnRenamed("bytes", "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    return once.select(*columns).unionByName(again.select(*columns))
