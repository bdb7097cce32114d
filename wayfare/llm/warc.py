"""WARC archives: a writer with payload deduplication, and a splittable reader.

Writer: of records with equal payloads of at least ``least`` bytes the one of the largest ``page_id`` is the
response; the others are revisits that name it and carry no payload.  Every record is a gzip member of its own;
a task writes one file, and rolls it by size.

Reader: a split is a byte range of a file.  A task looks for gzip's magic bytes in its range, tries each candidate
by decoding its first bytes and asking for a WARC header, and owns the records that start inside the range, also
where they end beyond it.

Defined results: a null page is an empty payload; pages that share the largest ``page_id`` of their payload are
all responses; a null ``page_id`` is the largest only where there is no other; a null or missing url has no
target header; an empty table writes no archive and reads as no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.files import get, open_fs
from wayfare.llm.text import small_batches
from wayfare.plans.scratch import new_path

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Payload-Length: {size}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _with_originals(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, refers_to (the response's page for rows that revisit it), revisit."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha1(html).alias("sha"))
    sums = rows.select("page_id", "sha", F.octet_length("html").alias("size")).where(F.col("size") >= least)
    groups = sums.groupBy("sha", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null")
    again = sums.join(groups.select("sha", "original"), "sha").where("page_id is null or page_id <> original").select("page_id", "sha", "original").distinct()
    joined = rows.alias("p").join(again.alias("g"), F.expr("p.page_id <=> g.page_id and p.sha = g.sha"), "left")
    return joined.select("p.page_id", "p.url", "p.html", F.col("g.original").alias("refers_to"), F.col("g.original").isNotNull().alias("revisit"))


def write_warc(pages: DataFrame, folder: str, least: int = 0, roll_bytes: int = 128 << 20) -> DataFrame:
    """Write archives to ``folder``; returns their manifest: path, size, records (of the attempts that count)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        out, size, count, name = None, 0, 0, ""

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "size", "records"])

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(path, recursive=True)
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                payload = html.encode()
                member = record(page_id, url, payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), refers_to, revisit)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= roll_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    small_batches(pages.sparkSession)
    schema = "path string, size long, records long"
    _with_originals(pages, least).mapInArrow(write, schema).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(schema).parquet(f"{folder}/manifest")


def members(path: str, start: int, stop: int, read: int = 1 << 20) -> Iterator[bytes]:
    """The decoded records of a file that start in ``start <= position < stop``."""
    held, at = bytearray(), start  # bytes from position ``at`` on; they grow in place

    def more() -> bool:
        nonlocal held
        new = get(path, at + len(held), read)
        held += new
        return bool(new)

    pos = start
    while pos < stop:
        if pos > at:
            held, at = held[pos - at :], pos
        k = held.find(MAGIC)
        if k < 0:
            pos = max(pos, at + len(held) - len(MAGIC) + 1)
            if pos >= stop or not more():
                return
            continue
        pos = at + k
        if pos >= stop:
            return
        held, at = held[k:], pos
        unpack, text, fed, ended = zlib.decompressobj(31), [], 0, False
        begun = False  # the text so far begins like a record
        try:
            while True:
                text.append(unpack.decompress(held[fed:]))
                fed = len(held)
                if unpack.eof:
                    ended = True
                    break
                if not begun and sum(map(len, text)) >= 8:
                    begun = b"".join(text).startswith(b"WARC/1.")
                    if not begun:
                        break
                if not more():
                    break
        except zlib.error:
            ended = False
        whole = b"".join(text)
        if ended and whole.startswith(b"WARC/1."):
            yield whole
            pos += fed - len(unpack.unused_data)
        else:
            pos += 1


def parse(whole: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a decoded record; the digest of a payload is checked."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "revisit":
        return _page(fields["warc-record-id"]), int(fields["x-payload-length"]), digest, kind, _page(fields["warc-refers-to"])
    payload = block.partition(b"\r\n\r\n")[2]
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if found != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
    return _page(fields["warc-record-id"]), len(payload), found, kind, None


def read_warc(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """All records of the archives in a table with their ``path`` and ``size``."""
    spark = manifest.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    splits = manifest.select("path", "size", starts.alias("start")).select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("stop"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [parse(x) for x in members(path, start, stop)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return splits.repartition(parts, "path", "start").mapInArrow(read, RECORD)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and return the records as read back."""
    return read_warc(write_warc(pages, new_path(pages.sparkSession, "warc"), least))
