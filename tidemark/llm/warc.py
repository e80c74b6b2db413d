"""WARC archives: writing, reading back and segment reassembly.

Writing: a record per page; of equal payloads one is a response, the others
revisit it. Blocks longer than ``SEGMENT`` bytes go into continuation records.
Spark's text writer lays the records down, each ended by the two line breaks
that WARC asks for, so a lost executor leaves no partial archive behind.

Reading: archives are parsed by Content-Length; whole records are decoded where
they are read, and only segments are shuffled: grouped by the origin record,
put in order of segment number, held against the total length, and their
chunked transfer framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, scratch_path, slices, table, written

#: Longest block of one record, longest chunk of the transfer framing, and records of one file:
#: a file holds at most RECORDS * (SEGMENT + 1 KB), about 37 MB before compression.
SEGMENT = 8_192
CHUNK = 4_096
RECORDS = 4_096
DATE = "2026-01-01T00:00:00Z"
CRLF = b"\r\n"
GZIP = b"\x1f\x8b"
#: Longest head of a record.
MOST_HEADER = 1 << 16


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over. Broken framing raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size line has no end")
        size = int(body[at:end].split(b";")[0].strip() or b"-", 16)
        if size == 0:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != CRLF:
            raise ValueError("chunk is not ended by a line break")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record without the two line breaks after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"Content-Length: %d\r\n\r\n" % len(block) + block


def page_records(record_id: str, url: str | None, payload: bytes, refers_to: str | None, segment: int):
    """The records of one page: a revisit, a response, or a response and its continuations."""
    common = [("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url) if url is not None else None), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), *common, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{refers_to}>"), ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    one = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *common, one, ("Content-Type", "application/http; msgtype=response")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT, least: int = 0) -> None:
    """Writes a record per row of pages into gzip files below path.

    Of equal payloads of at least ``least`` bytes, the row with the smallest id is
    the response (a null id comes last; of repeated rows, the first) and the others
    revisit it; shorter payloads are always responses. Null payloads are empty;
    a null url leaves its header out. Repeated rows are records of their own;
    other columns are ignored; an empty table gives no record.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.monotonically_increasing_id().cast("string"))
    # Names are given once and written: two branches of the plan below read them.
    rows = written(pages.select(F.col(id_col).alias("page"), name.alias("name"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload")), "named_pages")
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("page").isNull(), "page", "name"))["name"].alias("first"))
    # Of a digest that holds a third of all pages, one row comes from each task; on the other side AQE splits it.
    told = rows.select("name", "url", "payload", "digest").join(first, "digest")
    refers = F.when((F.octet_length("payload") >= least) & (F.col("name") != F.col("first")), F.col("first"))

    def lay(batches):
        for batch in slices(batches, 256):
            c = [x.to_pylist() for x in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([r for row in zip(*c, strict=True) for r in page_records(*row, segment)], pa.binary())], names=["record"])

    laid = told.select("name", "url", "payload", refers.alias("refers")).mapInArrow(lay, "record binary")
    laid.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    drop_written(rows)


def parse(pieces):
    """(headers by lower-case name, block, None) of every record of an archive's bytes, which come in pieces; at what is no whole record (None, None, what is wrong), and on with the next record.

    Only the record at hand is held, and the pieces it lies in.
    """
    pieces, held, over = iter(pieces), bytearray(), False

    def reach(n: int) -> bool:
        nonlocal over
        while len(held) < n and not over:
            piece = next(pieces, None)
            over = piece is None
            held.extend(piece or b"")
        return len(held) >= n

    def skipped(why: str):
        """Passes over bytes up to the next line that begins a record."""
        at = 1
        while True:
            at = held.find(b"\nWARC/", max(0, at - 1))
            if at >= 0:
                del held[: at + 1]
                return None, None, why
            at = len(held) - 6
            if not reach(len(held) + 1):
                held.clear()
                return None, None, why

    while reach(1):
        if held[0] in b"\r\n\0":
            head = bytes(held[:64])
            del held[: len(head) - len(head.lstrip(b"\r\n\0"))]
            continue
        end = held.find(b"\r\n\r\n", 0, MOST_HEADER)
        if end < 0:
            reach(MOST_HEADER)
            end = held.find(b"\r\n\r\n", 0, MOST_HEADER)
        version, *lines = bytes(held[: max(0, end)]).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = headers.get("content-length", "")
        if not version.startswith("WARC/"):
            yield skipped("no record begins here")
        elif not (length.isascii() and length.isdigit()):
            yield skipped("no content length")
        elif not reach(end + 4 + int(length)):
            yield skipped("record is cut off")
        else:
            yield headers, bytes(held[end + 4 : end + 4 + int(length)]), None
            del held[: end + 4 + int(length)]


def gunzipped(data: bytes, size: int = 1 << 20):
    """Pieces of about size bytes of all members of gzip bytes, whatever stands between them; other bytes as they are. A broken member ends where it breaks."""
    view, at = memoryview(data), 0
    if bytes(view[:2]) != GZIP:
        yield from (bytes(view[i : i + size]) for i in range(0, len(view), size))
        return
    while at >= 0:
        d, rest = zlib.decompressobj(31), at
        try:
            while not d.eof and rest < len(view):
                piece = bytes(view[rest : rest + size])
                rest += len(piece)
                yield d.decompress(piece, size)
                while d.unconsumed_tail:
                    yield d.decompress(d.unconsumed_tail, size)
            at = data.find(GZIP, rest - len(d.unused_data)) if d.eof else -1
        except zlib.error:
            at = data.find(GZIP, at + 2)


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head) else body


RECORD = "record_id string, type string, url string, digest string, refers_to string, origin string, segment long, total long, block binary, file string, error string"
#: A worker sends records on when their blocks have so many bytes.
SEND = 8 << 20


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, gzip or not and whatever their names, as they are.

    What is no whole record (cut off, without a length, foreign bytes) is a row
    with error and file only; reading goes on with the next record. An archive
    comes to a worker as one row of compressed bytes; it is unpacked in pieces,
    and its records leave in batches of about SEND bytes. No archive gives no rows.
    """

    def row(file, h, block, error):
        if error:
            return (*[None] * 9, file, error)
        bare = lambda k: h[k].strip("<>") if k in h else None
        whole = lambda k: int(h[k]) if h.get(k, "").isdigit() else None
        return bare("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), (h.get("warc-payload-digest") or "").partition(":")[2] or None, bare("warc-refers-to"), bare("warc-segment-origin-id"), whole("warc-segment-number"), whole("warc-segment-total-length"), block, file, None

    def sent(rows):
        kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary()] + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    def take(batches):
        for batch in slices(batches, 1):
            rows, size = [], 0
            for h, block, error in parse(gunzipped(batch.column(1)[0].as_py())):
                rows.append(row(batch.column(0)[0].as_py(), h, block, error))
                size += len(block or b"") + 512
                if size >= SEND:
                    yield sent(rows)
                    rows, size = [], 0
            if rows:
                yield sent(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(take, RECORD)


PAGE = "record_id string, url string, digest string, refers_to string, payload binary, whole boolean"


def reassembled(records: DataFrame) -> DataFrame:
    """A row per page: record_id, url, digest (as its header says), refers_to, payload (null for revisits) and
    whole: all segments are there, the total length holds, the framing can be decoded and the digest fits.

    A page with a missing or repeated segment, another total length or broken
    framing is kept, with whole false and a null payload. Rows that are errors
    are passed over. No records give no rows; other columns are ignored.
    """

    def opened(block):
        try:
            return payload_of(block)
        except ValueError:
            return None

    def single(batches):
        for batch in slices(batches, 256):
            names = batch.schema.names
            c = {k: batch.column(i) for i, k in enumerate(names)}
            payload = [None if r is not None else opened(b) for r, b in zip(c["refers_to"].to_pylist(), c["block"].to_pylist(), strict=True)]
            whole = [r is not None or (p is not None and digest_of(p) == d) for r, p, d in zip(c["refers_to"].to_pylist(), payload, c["digest"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c["record_id"], c["url"], c["digest"], c["refers_to"], pa.array(payload, pa.binary()), pa.array(whole, pa.bool_())], names=[x.split()[0] for x in PAGE.split(", ")])

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("segment")
        head = parts.iloc[0]
        block = b"".join(parts["block"])
        total = parts["total"].dropna()
        complete = parts["segment"].tolist() == list(range(1, len(parts) + 1)) and len(total) == 1 and int(total.iloc[0]) == len(block)
        payload = opened(block) if complete else None
        return pd.DataFrame([{"record_id": head["origin"], "url": head["url"], "digest": head["digest"], "refers_to": None, "payload": payload, "whole": payload is not None and digest_of(payload) == head["digest"]}])

    records = records.where("record_id is not null").drop("file", "error")
    segments = records.where("segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    return records.where("segment is null").mapInArrow(single, PAGE).unionByName(segments.groupBy("origin").applyInPandas(joined, PAGE))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page whose segments are broken would have whole false and a null payload_bytes."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    pages = reassembled(read_records(spark, path))
    pages = pages.select("record_id", "refers_to", "whole", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    # A revisit's length is its response's. Only digests and lengths are kept, so that both sides of the join read the archives once.
    pages = written(pages, "warc_pages")
    of = pages.where("refers_to is null").select(F.col("record_id").alias("response"), F.col("payload_bytes").alias("response_bytes"))
    rows = pages.join(of, pages["refers_to"] == of["response"], "left")
    page_id = lambda name: F.split_part(F.col(name), F.lit(":"), F.lit(3)).try_cast("long")
    return rows.select(
        page_id("record_id").alias("page_id"),
        F.coalesce("payload_bytes", "response_bytes").alias("payload_bytes"),
        "payload_digest",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        page_id("refers_to").alias("refers_to"),
        "whole",
    )


QUERIES = {"op2_warc": op2_warc}

#: Base32 by hand: five hexadecimal digits of the digest are four letters.
ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h,
             min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, (5 * i + 1)::BIGINT, 5))::BIGINT) AS words FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(words, lambda w: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w >> s) & 31) + 1, 1)), '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       true AS whole
FROM b
"""
}
