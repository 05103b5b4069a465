"""WARC archives: writing, reading, and revisit resolution by payload digest.

write_archives() puts one record for each page into gzip members, one member a record as the format recommends.
resolved() shuffles headers (digest, length, id; no payloads) to find the response of each group of equal payloads, and
joins the revisits to it. read_archives() parses the files and joins each revisit to the response it refers to.
Files are written and read by Spark's text and binary sources, so any store that Spark reaches will do.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlight.llm.storage import stored

REVISIT_BYTES = 1000                 # smaller payloads are always written whole
DATE = "2024-01-01T00:00:00Z"        # of the fresh headers; a parameter, so that equal input makes equal archives
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20                # of payload in a file, about
FIRST_PIECE, LARGEST_PIECE = 1 << 10, 1 << 20   # bytes fed to a decompressor at once
#: an empty gzip member stands between records, as the text source wants something between rows
BETWEEN = gzip.compress(b"", mtime=0).decode("latin-1")


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, bytes) of pages (page_id, url, html); a null html is an empty payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))


def resolved(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """`records` with refers_to: the largest page_id of equal payloads of at least `least` bytes, null for that record itself.

    Only (page_id, digest, bytes) is shuffled by digest, and only groups of several ids come back as revisits, which
    then meet the payloads by (page_id, digest): a payload that a third of all pages share is spread over all tasks.
    Records that repeat the largest page_id and its payload are all responses. A null page_id is never referred to; in
    a group of null ids only, all are responses.
    """
    headers = records.where(F.col("bytes") >= least).select("page_id", "digest", "bytes")
    originals = headers.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    revisits = (headers.join(originals.drop("n"), ["digest", "bytes"]).where("page_id is null or page_id <> refers_to")
                .select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "refers_to").distinct())
    same = F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest"))
    return records.join(revisits, same, "left").drop("revisit_id", "revisit_digest")


def record_id(page_id: Column, digest: Column) -> Column:
    """A name for the record of a page and payload: an md5 in the form of a UUID."""
    h = F.md5(F.concat_ws(" ", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def header(kind: str, row: dict, length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {row['record']}", f"WARC-Date: {row['date']}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~"))
    lines.append(f"WARC-Payload-Digest: sha1:{row['digest']}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {row['target']}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A gzip member for each record; a revisit keeps the HTTP header and drops the payload."""
    for batch in batches:
        out, size = [], 0
        names = [c for c in batch.schema.names if c != "payload"]
        for *values, payload in zip(*(batch.column(c).to_pylist() for c in names), batch.column("payload")):
            row = dict(zip(names, values))
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
            kind = "response" if row["refers_to"] is None else "revisit"
            block = http + (payload.as_py() if kind == "response" else b"")
            out.append(gzip.compress(header(kind, row, len(block)) + block + b"\r\n\r\n", 6, mtime=0))
            size += len(out[-1])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_archives(records: DataFrame, folder: str, date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Archives of resolved records (page_id, url, payload, digest, bytes, refers_to) in a new folder, with fresh headers.

    Each task writes files of at most about `file_bytes` of average payloads.
    """
    average = records.agg(F.avg(F.col("bytes") + 500)).first()[0] or 1
    named = records.select(
        "page_id", "url", "digest", "bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        record_id(F.col("page_id"), F.col("digest")).alias("record"), record_id(F.col("refers_to"), F.col("digest")).alias("target"), F.lit(date).alias("date"))
    rows = named.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN).option(
        "maxRecordsPerFile", max(1, int(file_bytes / average))).text(folder)


def inflated(content: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one by one; empty ones are skipped.

    A member is fed in pieces that grow with it, so what a decompressor leaves unused is less than about a member's length.
    """
    view, at = memoryview(content), 0
    while at < len(view):
        z, out, size = zlib.decompressobj(31), [], FIRST_PIECE
        while not z.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a gzip member")
            piece = view[at:at + size]
            out.append(z.decompress(piece))
            at += len(piece)
            size = min(2 * size, LARGEST_PIECE)
        at -= len(z.unused_data)
        member = b"".join(out)
        if member:
            yield member


def parsed(member: bytes) -> dict:
    """Named fields and block of a record; the block is cut at its Content-Length."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise ValueError("not a WARC record")
    named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return named | {"block": rest[:int(named["content-length"])]}


def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    names = ["record", "page_id", "record_type", "url", "target", "stated", "digest", "bytes"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for member in inflated(content.as_buffer()):
                x = parsed(member)
                payload = x["block"].partition(b"\r\n\r\n")[2] if x["warc-type"] == "response" else None
                page = x.get("x-page-id")
                rows.append((x["warc-record-id"], None if page is None else int(page), x["warc-type"], x.get("warc-target-uri"), x.get("warc-refers-to"),
                             x["warc-payload-digest"].removeprefix("sha1:"), None if payload is None else hashlib.sha1(payload).hexdigest(),
                             None if payload is None else len(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, digest_ok) of each record in the folder.

    Digest and length are taken from the payload; a revisit has those of the response it refers to, and null where that
    is missing. digest_ok compares with the header's digest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder).select("content")
    found = stored(files.mapInArrow(records_of, "record string, page_id long, record_type string, url string, target string, stated string, digest string, bytes long"), "headers")
    responses = found.where("record_type = 'response'")
    originals = responses.groupBy(F.col("record").alias("target")).agg(
        F.max("page_id").alias("refers_to"), F.max("digest").alias("full_digest"), F.max("bytes").alias("full_bytes"))
    whole = responses.select("page_id", "bytes", "digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "url", "stated")
    again = found.where("record_type = 'revisit'").drop("digest", "bytes").join(originals, "target", "left").select(
        "page_id", F.col("full_bytes").alias("bytes"), F.col("full_digest").alias("digest"), "record_type", "refers_to", "url", "stated")
    return whole.unionByName(again).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url",
        F.coalesce(F.col("digest") == F.col("stated"), F.lit(False)).alias("digest_ok"))


def deduplicated_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html; other columns are ignored) as deduplicated archives and reads them back.

    One record for each row: null ids, urls and texts are kept as such (an empty payload for a null text), repeated rows
    are repeated records, an empty table gives an empty result. Characters that a URI may not hold are percent-encoded.
    """
    write_archives(resolved(payloads(pages)), folder)
    return read_archives(pages.sparkSession, folder)
