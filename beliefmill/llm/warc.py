"""WARC archives: a writer in Spark and a salvage reader.

The writer makes one record per page: a response with the payload, or a revisit that names
the response with the same payload. Records are written by Spark's own text writer, whose
line end closes a record, so archives can go to any store that Spark writes to.

The reader checks every record (version line, headers, length, closing line ends, block
digest if stated) and gzip members (checksum). After a failed check it searches for the next
version line or member that passes, and logs the bytes between as a gap. Records that a
broken member holds whole before its fault are kept if their own digest holds.

Defined results: a null html is an empty payload; a null url or page_id is written without the
header or as ``null``; repeated rows of a page are separate records; an empty table makes
archives without records; line ends in a url are escaped. Only page_id, url, html are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beliefmill.session import prepare_checkpoints

REVISIT_BYTES = 1000
FILE_RECORDS = 2000  # keeps an archive to a size that one task reads
PIECE = 1 << 14
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
NEXT = re.compile(rb"WARC/\d+\.\d+\r\n|\x1f\x8b\x08")


def records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses). Of equal payloads of at least
    ``least`` bytes the one with the largest page_id is the response. Only narrow rows are
    grouped by payload; the html itself stays dealt by page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = rows.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = long.join(first, "digest").where("page_id <> refers_to").distinct()
    return rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write(pages: DataFrame, path: str, least: int = REVISIT_BYTES, compression: str = "none") -> None:
    """Write archives below ``path``; with ``gzip`` each archive is one member, smaller, but lost
    from the first fault on if damaged."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    rows = records(pages, least).withColumn("block", block)
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(again, F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("block").cast("binary")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, "block", F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", compression).text(path)


def _matches(digest: str, data: bytes) -> bool:
    """Whether ``algorithm:value`` (hex or base 32) is the digest of data; unknown ones pass."""
    name, _, value = digest.partition(":")
    if name.lower() not in ("sha1", "md5", "sha256"):
        return True
    found = hashlib.new(name.lower(), data, usedforsecurity=False).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _record(data, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and end of the record at ``at``, or what is wrong with it."""
    if not VERSION_LINE.match(data, at):
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "headers do not end"
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return "no length"
    begin = end + 4
    stop = begin + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n" or stop + 4 > len(data):
        return "length does not fit"
    block = data[begin:stop]
    if "warc-block-digest" in headers and not _matches(headers["warc-block-digest"], block):
        return "digest differs"
    return headers, block, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    """Content and end of the gzip member at ``at``, fed in pieces so that what lies behind a
    small member is not copied."""
    inflate, view, parts = zlib.decompressobj(31), memoryview(data), []
    try:
        while at < len(data) and not inflate.eof:
            parts.append(inflate.decompress(view[at : at + PIECE]))
            at = min(at + PIECE, len(data))
    except zlib.error as e:
        return f"bad member: {e}"
    return (b"".join(parts), at - len(inflate.unused_data)) if inflate.eof else "member does not end"


def _before_fault(data: bytes, at: int) -> bytes:
    """What a broken gzip member holds before its fault, to the byte."""
    inflate, view, parts = zlib.decompressobj(31), memoryview(data), []
    while at < len(data) and not inflate.eof:
        before = inflate.copy()
        try:
            parts.append(inflate.decompress(view[at : at + PIECE]))
        except zlib.error:
            try:
                for i in range(at, at + PIECE):
                    parts.append(before.decompress(view[i : i + 1]))
            except zlib.error:
                break
        at += PIECE
    return b"".join(parts)


def salvage(data: bytes, base: int = 0, packed: bool = True, partial: bool = False) -> Iterator[tuple]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason, None) in
    order, together covering all bytes. Offsets of records in a member are the member's.
    ``partial`` also gives, at the place of their gap, the whole records that a broken member
    holds before its fault, if they state a digest of their block and it is theirs."""
    at, bad, reason = 0, -1, ""
    saved: list[tuple] = []

    def gap(end: int) -> Iterator[tuple]:
        place = base + bad, end - bad
        yield from (("record", *place, *x) for x in saved)
        yield "gap", *place, reason + (f"; {len(saved)} records before the fault kept" if saved else ""), None
        saved.clear()

    while at < len(data):
        member = packed and data[at : at + 3] == b"\x1f\x8b\x08"
        found = _member(data, at) if member else _record(data, at)
        if member and not isinstance(found, str) and not VERSION_LINE.match(found[0]):
            found = "member without a record"
        if isinstance(found, str):
            if bad < 0:
                bad, reason = at, found
            if member and partial and VERSION_LINE.match(content := _before_fault(data, at)):
                saved += [x[3:] for x in salvage(content, packed=False) if x[0] == "record" and "warc-block-digest" in x[3]]
            hit = NEXT.search(data, at + 1)
            at = hit.start() if hit else len(data)
            continue
        if bad >= 0:
            yield from gap(at)
            bad = -1
        if member:
            content, end = found
            for kind, lo, n, head, block in salvage(content, packed=False):
                yield (kind, base + at, end - at, head, block) if kind == "record" else (kind, base + at, end - at, f"{head} (bytes {lo} to {lo + n} of the member)", None)
        else:
            headers, block, end = found
            yield "record", base + at, end - at, headers, block
        at = end
    if bad >= 0:
        yield from gap(len(data))


TEXTS, NUMBERS = T.StringType(), T.LongType()
RECORD = [T.StructField(n, NUMBERS if n in ("offset", "length", "payload_bytes") else TEXTS) for n in ("path", "kind", "offset", "length", "reason", "record_type", "record_id", "refers_to", "target", "payload_bytes", "payload_digest", "stated_digest")]


def read(spark, path: str, payloads: bool = False) -> DataFrame:
    """Records and gaps of all archives below ``path``. The payload is the block after its http
    headers (the whole block of other records); ``payloads`` adds it as bytes. Digests are bare
    lower-case hex of the payload read; ``stated_digest`` is the header's. An archive is read
    by one task, so archives should be of bounded size, as written here."""
    schema = T.StructType(RECORD + ([T.StructField("payload", T.BinaryType())] if payloads else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() if f.name == "payload" else pa.string() for f in schema]
        for batch in batches:
            for i in range(batch.num_rows):
                name, out = batch.column("path")[i].as_py(), []

                def full(out=out) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

                for kind, at, n, head, block in salvage(batch.column("content")[i].as_py(), partial=True):
                    if kind == "gap":
                        out.append((name, kind, at, n, head, *[None] * (7 + payloads)))
                        continue
                    payload = block
                    if "http" in head.get("content-type", "") and (cut := block.find(b"\r\n\r\n")) >= 0:
                        payload = block[cut + 4 :]
                    stated = head.get("warc-payload-digest")
                    row = (name, kind, at, n, None, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri"), len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest(), stated and stated.partition(":")[2])
                    out.append(row + (payload,) * payloads)
                    if len(out) >= 1000:
                        yield full()
                        out.clear()
                if out:
                    yield full()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back, and resolve revisits:
    page_id, payload_bytes, payload_digest, record_type, refers_to. Of a damaged
    archive the reader keeps the records before the fault."""
    spark = pages.sparkSession
    prepare_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write(pages, path, compression="gzip")
    number = lambda c: F.expr(rf"try_cast(regexp_extract({c}, r'^<urn:page:(-?\d+)>$', 1) as bigint)")
    rows = read(spark, path).where("kind = 'record'").select(number("record_id").alias("page_id"), "record_type", number("refers_to").alias("refers_to"), "payload_bytes", "payload_digest", "stated_digest")
    full = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"), F.col("payload_bytes").alias("full_bytes")).distinct()
    again = rows.where("record_type = 'revisit'").join(full, ["refers_to", "stated_digest"], "left")
    again = again.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to")
    return rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(again)


ARCHIVE_SQL = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT payload_digest AS d, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN top <> page_id THEN top END AS refers_to
    FROM p LEFT JOIN m ON m.d = p.payload_digest AND p.payload_bytes >= 1000"""
