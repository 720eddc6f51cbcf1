"""WARC archives of pages: written with one gzip member per record, read back by a sequential reader.

Writing moves no page unless it must: equal payloads are found by grouping SHA-1 digests, and only digests that occur more than
once are joined to the pages (Spark broadcasts that table if its size allows, else pages are joined by a shuffle that
splits a hot digest). Each task writes archives of about ``ARCHIVE_BYTES`` into a folder all executors share. The names are unique to the
attempt, and the list of archives is a table whose rows count only once their task committed, so what a lost executor or a repeated
task leaves behind is never read.

Of equal payloads of at least ``least_bytes`` bytes, that of the smallest page_id is a ``response`` record, the others are ``revisit``
records without payload that name the response; smaller payloads are all responses. The page a record belongs to stands in its record
id, ``<urn:x-page:PAGE:DIGEST>``.

The reader takes an archive block by block: it inflates one member at a time, cuts the record by its content length and checks both
digests, so a task holds one record and a block, however long the archive. A damaged record raises an error under
``strict`` and is a row with an ``error`` otherwise; where the compressed stream itself is broken, the rest of that archive cannot be read.

Null html is an empty payload; a null url is left out. Rows without page_id come after all others and are responses only of payloads
that no page with an id has. Of repeated rows all that bear the smallest page_id are responses. Very long pages are one record each. An empty table
gives no archive and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize

ARCHIVE_BYTES = 1 << 30
BLOCK_BYTES = 1 << 18
HEAD_BYTES = 1 << 20  # longest header of a record
BATCH_BYTES, BATCH_RECORDS = 1 << 22, 1000
LEVEL = 6
VERSION = b"WARC/1.1"
# Fixed value: name of the profile in the WARC standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = pa.schema(
    [
        ("archive", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()),
        ("page", pa.string()), ("refers_to_page", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
    ]
)
RECORD_DDL = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in RECORD)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page: str | None, digest: str) -> str:
    """Record id that carries the page; a missing page differs from an empty name."""
    return f"<urn:x-page:{'none' if page is None else 'is-' + quote(page, safe='')}:{digest}>"


def page_of(urn: str) -> str | None:
    parts = urn.strip("<>").split(":")
    known = len(parts) == 4 and parts[1] == "x-page" and parts[2].startswith("is-")
    return unquote(parts[2][3:]) if known else None


def record(kind: str, headers: dict[str, str | None], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION.decode(), f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None)]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return pack.compress(whole) + pack.flush()


def page_record(page: str | None, url: str | None, payload: bytes, original: str | None, revisit: bool, date: str, level: int = LEVEL) -> bytes:
    """The record of a page: its payload, or a reference to the page ``original`` that has the same one."""
    digest = base32_sha1(payload)
    headers = {
        "WARC-Record-ID": page_urn(page, digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": page_urn(original, digest)}
        return record("revisit", headers, http, level)
    return record("response", headers, http + payload, level)


def _put(folder: str, date: str, archive_bytes: int, level: int):
    def put(batches):
        out = path = None
        records = size = 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page", "url", "original", "revisit")]
            payloads = batch.column("html").cast(pa.binary())
            for i in range(batch.num_rows):
                if out is None:
                    path, records, size = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, inner = fs.FileSystem.from_uri(folder)
                    store.create_dir(inner, recursive=True)
                    out = store.open_output_stream(f"{inner}/{path.rpartition('/')[2]}", compression=None)
                    info = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
                    size += out.write(record("warcinfo", info, b"format: WARC File Format 1.1\r\n"))
                page, url, original, revisit = (c[i].as_py() for c in columns)
                size += out.write(page_record(page, url, payloads[i].as_py() or b"", original, revisit, date, level))
                records += 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return put


def write_warc(
    pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, date: str | None = None
) -> DataFrame:
    """Write a record per row of (page_id, url, html) to archives below ``folder``; returns archive, records, bytes.

    ``folder`` must be a path or URI of a shared store that ``pyarrow.fs`` opens: a mounted folder, HDFS, S3, GCS, ABFS.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").alias("id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    copied = F.octet_length("html") >= least_bytes
    several = rows.where(copied).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    several = materialize(several, "warc-copies")
    joined = rows.join(several, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    records = joined.select(
        F.col("id").cast("string").alias("page"), "url", "html", F.col("first").cast("string").alias("original"), revisit.alias("revisit")
    )
    written = records.mapInArrow(_put(folder, date, archive_bytes, level), "archive string, records bigint, bytes bigint")
    return materialize(written, "warc-archives")


class Damaged(ValueError):
    """A record or member that is not what its headers say."""


def _members(source) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member of a stream, one member after the other."""
    rest = source.read(BLOCK_BYTES)

    def pieces():
        nonlocal rest
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not rest and not (rest := source.read(BLOCK_BYTES)):
                raise Damaged("archive ends within a member")
            try:
                data = inflate.decompress(rest, BLOCK_BYTES)
            except zlib.error as e:
                raise Damaged(f"member cannot be inflated: {e}") from e
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if data:
                yield data

    while rest or (rest := source.read(BLOCK_BYTES)):
        yield pieces()


def _sha1_matches(stated: str | None, data: bytes) -> bool:
    if stated is None:
        return True
    name, _, value = stated.partition(":")
    return name.lower() == "sha1" and value == base32_sha1(data)


def parse_record(member: Iterator[bytes]) -> dict:
    """One record from the pieces of its member: framed by its content length, digests checked."""
    data = bytearray()
    for piece in member:
        data += piece
        if (end := data.find(b"\r\n\r\n")) >= 0:
            break
        if len(data) > HEAD_BYTES:
            raise Damaged("header of a record does not end")
    else:
        raise Damaged("record without header")
    version, *lines = bytes(data[:end]).decode("utf-8", "replace").split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    row = dict.fromkeys(RECORD.names) | {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id")}
    row |= {"refers_to_id": head.get("warc-refers-to"), "uri": head.get("warc-target-uri")}
    if not version.startswith("WARC/"):
        raise Damaged("record does not start with a version")
    if not head.get("content-length", "").isdecimal():
        raise Damaged("record without content length")
    begin, length = end + 4, int(head["content-length"])
    for piece in member:
        data += piece
        if len(data) > begin + length + 4:
            break
    if bytes(data[begin + length :]) != b"\r\n\r\n":
        raise Damaged("record is not as long as stated")
    block = bytes(data[begin : begin + length])
    if not _sha1_matches(head.get("warc-block-digest"), block):
        raise Damaged("block digest differs")
    if row["record_type"] in ("response", "revisit"):
        row |= {"page": page_of(row["record_id"] or ""), "refers_to_page": page_of(row["refers_to_id"] or "")}
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        stated = head.get("warc-payload-digest")
        row["payload_digest"] = stated.partition(":")[2] if stated else base32_sha1(payload)
        row["payload_bytes"] = int(fields.get(b"content-length", len(payload)))
        if row["record_type"] == "response":
            if row["payload_bytes"] != len(payload):
                raise Damaged("payload is not as long as stated")
            if not _sha1_matches(stated, payload):
                raise Damaged("payload digest differs")
            row["payload"] = payload
    return row


def read_archive(path: str) -> Iterator[dict]:
    """The records of an archive in order; a damaged one is a row with ``error``."""
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner, compression=None) as source:
        for member in _members(source):
            try:
                row = parse_record(member)
            except Damaged as e:
                row = dict.fromkeys(RECORD.names) | {"error": str(e)}
            row["archive"] = path
            yield row
            try:
                for _ in member:  # what a damaged record left of its member
                    pass
            except Damaged as e:
                if row["error"] is None or row["error"] != str(e):
                    yield dict.fromkeys(RECORD.names) | {"archive": path, "error": str(e)}
                return
            if row["error"] and ("inflated" in row["error"] or "within" in row["error"]):
                return


def _get(strict: bool, payloads: bool):
    def get(batches):
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows, size = [], 0
                for row in read_archive(path):
                    if strict and row["error"]:
                        raise Damaged(f"{path}: {row['error']}")
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    return get


def read_warc(archives: DataFrame, strict: bool = True, payloads: bool = True) -> DataFrame:
    """All records of the archives named in column ``archive``, warcinfo records included; an archive is read by one task."""
    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(_get(strict, payloads), RECORD_DDL)


def page_records(archives: DataFrame, page_type: str = "bigint", strict: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records of pages."""
    rows = read_warc(archives, strict, payloads=False).where(F.col("record_type").isin("response", "revisit"))
    return rows.select(
        F.col("page").cast(page_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_page").cast(page_type).alias("refers_to"),
    )
