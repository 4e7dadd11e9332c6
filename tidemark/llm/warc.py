"""WARC archives: a writer with one gzip member a record, and a splittable reader.

The writer puts each partition into one archive in a shared folder, through the file system of the folder's URI.
A task writes under a name of its own and reports it when the file is closed; the manifest of reported files is
written down, and only those are read, so a lost or repeated task leaves no record twice.

The reader deals byte ranges to tasks. A task scans its range for the gzip magic, takes a place for a record's start
if the member's first bytes decode and begin with a WARC version line, and owns the records that start inside its
range, reading past the range's end to finish the last. Bytes that only look like a member fail the test, and a
member that is owned is skipped as a whole.

Ids may be of any type that has a string form; archives hold that form, and the reader casts it back. Null html is an
empty payload, a null url leaves the record without a target, and a row with a null id is a response. Payloads are
written whole, one at a time. Rows that repeat an id each get a record; repeats of a response are responses. Other
columns are not read, whatever their names. An empty table gives no archive, and an empty result when it is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, shuffle_partitions, stash

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LEVEL = 6
#: Bytes of one range, of one read, and of the decoded bytes that show whether a place is a record's start.
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
PROBE_BYTES = 16


def _filesystem(uri: str):
    """pyarrow's file system for a URI, and the path in it: local folders and the stores that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9]+:", uri) else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def _id(name: str | None) -> str | None:
    """The id in a record's name; null for the name of none."""
    return unquote(name.removeprefix("<urn:page:").removesuffix(">")) if name and name.startswith("<urn:page:") else None


def record_bytes(page_id: str | None, url: str | None, payload: bytes, kind: str, refers_to: str | None, payload_bytes: int, payload_digest: str) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header only; its full payload's length and digest are named."""
    body = HTTP + (payload if kind == "response" else b"")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-X-Payload-Length: {payload_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head + body + b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> dict:
    """Headers of one decoded record and its payload; a response's length and digest are those of its payload."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": _id(fields["WARC-Record-ID"]),
        "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "record_type": fields["WARC-Type"],
        "refers_to": _id(fields.get("WARC-Refers-To")),
        "payload_bytes": len(payload) if response else int(fields["WARC-X-Payload-Length"]),
        "payload_digest": digest(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": payload if response else None,
    }


def assign_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """(id, sha1, response_id) of the rows that are revisits: of equal payloads of at least ``min_revisit_bytes`` the
    smallest id is the response, and smaller payloads are all responses.

    Only hashes are shuffled; groups of copies are pre-aggregated.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    hashed = stash(pages.select(F.col(id_col).alias("id"), F.unhex(F.sha1(html)).alias("sha1"), F.octet_length(html).alias("n")), "payloads")
    first = stash(hashed.filter(F.col("n") >= min_revisit_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("sha1", "first"), "first-payloads")
    return hashed.join(first, "sha1").filter("id <> first").select("id", "sha1", F.col("first").alias("response_id")).distinct()


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write every row as a record, and return the manifest (path, bytes, records) of the archives.

    Rows learn of revisits by a join with those rows' ids and hashes. They are written down first, so Spark knows their
    size: below its limit they are broadcast and pages are written where they stand, beyond it pages are shuffled.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    revisits = stash(assign_records(pages, id_col, html_col, min_revisit_bytes), "revisits")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"), F.unhex(F.sha1(F.coalesce(pages[html_col], F.lit("")))).alias("sha1"))
    rows = rows.join(revisits, ["id", "sha1"], "left").select(F.col("id").cast("string"), "url", "html", F.col("response_id").cast("string"))

    def write(batches):
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, out, records = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                for page_id, url, html, response in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "response_id")), strict=True):
                    payload = (html or "").encode()
                    out = out or fs.open_output_stream(name, compression=None)
                    out.write(record_bytes(page_id, url, payload, "response" if response is None else "revisit", response, len(payload), digest(payload)))
                    records += 1
        finally:
            if out:
                out.close()
        if out:
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [fs.get_file_info(name).size], "records": [records]})

    return stash(rows.mapInArrow(write, "path string, bytes bigint, records bigint"), "warc-manifest")


def owned_members(read, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decoded records that start in [start, end); ``read(offset, n)`` gives bytes of an archive of ``size`` bytes."""
    at = start
    held, base = b"", start  # bytes from base on
    while at < end:
        if at < base or at + len(MAGIC) > base + len(held):
            held, base = read(at, min(READ_BYTES, size - at)), at
        found = held.find(MAGIC, at - base)
        if found < 0:
            step = max(at + 1, base + len(held) - len(MAGIC) + 1)
            if step >= end or step + len(MAGIC) > size:
                return
            at = step
            continue
        at = base + found
        if at >= end:
            return
        data, length = _member(read, size, at, held[found:])
        if data is None:
            at += 1
        else:
            yield data
            at += length


def _member(read, size: int, at: int, first: bytes) -> tuple[bytes | None, int]:
    """The whole member at a place and its length in the archive; None if no record starts there."""
    inflate, parts, taken, chunk = zlib.decompressobj(31), [], 0, first
    try:
        while True:
            parts.append(inflate.decompress(chunk))
            taken += len(chunk)
            if len(parts) == 1 and len(parts[0]) >= PROBE_BYTES and not parts[0].startswith(b"WARC/1."):
                return None, 0
            if inflate.eof:
                data = b"".join(parts)
                return (data, taken - len(inflate.unused_data)) if data.startswith(b"WARC/1.") else (None, 0)
            if at + taken >= size:
                return None, 0
            chunk = read(at + taken, min(READ_BYTES, size - at - taken))
    except zlib.error:
        return None, 0


def read_archives(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = True, id_type: str = "bigint") -> DataFrame:
    """All records of the manifest's archives, by byte ranges; ids are cast to ``id_type``."""
    spark = manifest.sparkSession
    ranges = manifest.filter("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("start")
    )
    dealt = ranges.repartition(shuffle_partitions(spark), "path", "start")
    fields = [("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    if payloads:
        fields.append(("payload", pa.binary()))
    schema = pa.schema(fields)

    def run(batches):
        fs, _ = _filesystem(folder)
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                with fs.open_input_file(path) as f:
                    held, count = [], 0
                    for data in owned_members(lambda at, n, f=f: (f.seek(at), f.read(n))[1], size, start, min(size, start + range_bytes)):
                        row = parse_record(data)
                        held.append({k: row[k] for k in schema.names})
                        count += len(data)
                        if count > 8 * READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, count = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    read = dealt.mapInArrow(run, "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string" + ", payload binary" * payloads)
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
