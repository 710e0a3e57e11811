"""WARC archives: a writer with payload de-duplication and a salvage reader.

Archives are ``.warc.gz`` files with one gzip member per record. The reader
checks every record (member, version line, header, length, end of record,
digests). After a failed check it searches for the next valid member or
version line, goes on with the records from there and logs the byte gap that
it left out; a damaged record costs itself alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paymatch.llm.store import drop, new_path, save

#: Payloads of fewer bytes are never written as a revisit.
REVISIT_BYTES = 100
#: A new archive begins once one has this many (compressed) bytes.
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_END = b"\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = ("archive string, start long, stop long, kind string, reason string, record_type string, record_id string, "
           "target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary")
_SCHEMA = pa.schema([
    ("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()),
    ("reason", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
    ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("payload", pa.binary())])


# ---- writing


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record: a response, or a revisit of page ``first`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
            f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_urn(first, digest)}", f"X-Refers-To-Page: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def member(record: bytes) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        part, number, sink, name, temp, size, records = TaskContext.get().partitionId(), 0, None, "", "", 0, 0

        def close() -> pa.RecordBatch:
            sink.close()
            store.move(temp, name)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]})

        for batch in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    # rows come sorted, so every attempt makes the same archives; the move is atomic
                    name = f"{root}/part-{part:06d}-{number:04d}.warc.gz"
                    temp = f"{root}/_{uuid.uuid4().hex}"
                    sink, size, records, number = store.open_output_stream(temp), 0, 0, number + 1
                packed = member(record_bytes(page_id, url, (html or "").encode(), digest, first))
                sink.write(packed)
                size += len(packed)
                records += 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return run


def digest_of(html: Column) -> Column:
    """Lower-case hex SHA-256 of the payload in UTF-8 (null: empty)."""
    return F.sha2(F.coalesce(html, F.lit("")), 256)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below ``folder``.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes, the one
    with the smallest page_id is a response and the others revisit it (rows that
    repeat that page_id are responses too; rows without an id revisit it, or
    are all responses if no row has one). Null html is an empty payload, a null
    url is left out. No rows write no archive. Returns a manifest: archive,
    records, bytes. ``folder`` must be a place that executors reach by URI.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).withColumn("digest", digest_of(F.col("html")))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    narrow = save(rows.where(size >= REVISIT_BYTES).select("page_id", "digest"), "payloads")
    firsts = save(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                  .where("n > 1 and first is not null").select(F.col("digest").alias("same"), "first"), "firsts")
    revisits = save(narrow.join(firsts, F.col("digest") == F.col("same"))
                    .where("page_id is null or page_id != first")
                    .select(F.col("page_id").alias("at"), "same", "first").distinct(), "revisits")
    # whole payloads move once, spread by id, so that equal payloads don't meet
    joined = rows.join(revisits.hint("merge"), F.col("page_id").eqNullSafe(F.col("at"))
                       & (F.col("digest") == F.col("same")), "left")
    ordered = (joined.select("page_id", "url", "html", "digest", "first")
               .sortWithinPartitions("page_id", "digest", "url"))
    spark = pages.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    manifest = save(ordered.mapInArrow(_writer(folder if "://" in folder else f"file://{folder}"),
                                       "archive string, records long, bytes long"), "manifest")
    for used in (narrow, firsts, revisits):
        drop(used)
    return manifest


# ---- reading


@dataclass
class Record:
    start: int
    stop: int
    fields: dict[str, str]
    block: bytes


class Damaged(ValueError):
    """A record that fails a check."""


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at ``at``, all checks made."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    # a header of any length, but never into the next record
    top, later = data.find(_END, at), _VERSION.search(data, at + 1)
    if top < 0 or later and later.start() < top:
        raise Damaged("no end of header")
    fields: dict[str, str] = {}
    for line in data[at:top].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("bad header line")
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("bad content length")
    begin = top + len(_END)
    stop = begin + int(fields["content-length"])
    if data[stop:stop + 4] != _END:
        raise Damaged("no end of record")
    block = data[begin:stop]
    wanted = fields.get("warc-block-digest", "")
    if wanted.startswith("sha256:") and hashlib.sha256(block).hexdigest() != wanted[7:]:
        raise Damaged("block digest differs")
    if fields.get("warc-type") == "response" and fields.get("warc-payload-digest", "").startswith("sha256:"):
        if hashlib.sha256(payload_of(fields, block)).hexdigest() != fields["warc-payload-digest"][7:]:
            raise Damaged("payload digest differs")
    return fields, block, stop + 4


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP header, if it has one."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(_END)[2]
    return block


def _unpack(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at ``at`` unpacks to, the place behind it, and what is wrong with it (empty: nothing).

    Of a damaged member, everything before the damage is unpacked.
    """
    unpacker = zlib.decompressobj(31)
    view = memoryview(data)
    out, place = [], at
    while not unpacker.eof and place < len(data):
        before = unpacker.copy()
        try:
            out.append(unpacker.decompress(view[place:place + (1 << 16)]))
            place += 1 << 16
        except zlib.error:
            # byte by byte up to the damage
            try:
                while place < len(data):
                    out.append(before.decompress(view[place:place + 1]))
                    place += 1
            except zlib.error:
                pass
            return b"".join(out), min(place, len(data)), "bad gzip member"
    if not unpacker.eof:
        return b"".join(out), len(data), "gzip member is cut off"
    return b"".join(out), min(place, len(data)) - len(unpacker.unused_data), ""


def _within(inner: bytes, start: int, stop: int) -> Iterator[Record | tuple[int, int, str]]:
    """Valid records of a member's unpacked bytes; gaps are those of the member, with the inner bytes as part of the reason."""
    at, gap, reason = 0, -1, ""
    while at < len(inner):
        try:
            fields, block, to = parse_record(inner, at)
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            later = _VERSION.search(inner, at + 1)
            at = later.start() if later else len(inner)
            continue
        if gap >= 0:
            yield start, stop, f"{reason} at unpacked bytes {gap} to {at}"
            gap = -1
        yield Record(start, stop, fields, block)
        at = to
    if gap >= 0:
        yield start, stop, f"{reason} at unpacked bytes {gap} to {len(inner)}"


def _step(data: bytes, at: int) -> tuple[list[Record | tuple[int, int, str]], int, str]:
    """The record (or the member's records and gaps) at ``at``, the place behind, and what is wrong with the member."""
    if data[at:at + 3] == b"\x1f\x8b\x08":
        inner, stop, wrong = _unpack(data, at)
        found = list(_within(inner, at, stop))
        if not any(isinstance(f, Record) for f in found) and (found or wrong):
            raise Damaged(wrong or found[0][2])
        return found, stop, wrong
    fields, block, stop = parse_record(data, at)
    return [Record(at, stop, fields, block)], stop, ""


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """All valid records of an archive, and a (start, stop, reason) for each byte gap between them.

    A bad record costs itself alone, also inside a gzip member of several: the search for the next version line goes
    on in what the member unpacks to, before damage to the compressed bytes and, if they still unpack, behind
    it. Such a gap has the bytes of the member and, in its reason, those of what it unpacks to. A member whose compressed
    bytes are damaged is a gap itself after the records in front of the damage.
    """
    at, gap, reason = 0, -1, ""
    while at < len(data):
        try:
            found, stop, wrong = _step(data, at)
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            later = _NEXT.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap >= 0:
            yield gap, at, reason
            gap = -1
        yield from found
        if wrong:
            # what the unpacker read may already belong to the next member: look for that from the start
            gap, reason = at, wrong
            later = _NEXT.search(data, at + 1)
            at = later.start() if later else len(data)
        else:
            at = stop
    if gap >= 0:
        yield gap, len(data), reason


def _number(text: str | None) -> int | None:
    """A number in the range of a long, else none."""
    number = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return number if number is not None and -1 << 63 <= number < 1 << 63 else None


def _row(archive: str, item: Record | tuple[int, int, str], keep_payload: bool) -> dict:
    if isinstance(item, tuple):
        return {"archive": archive, "start": item[0], "stop": item[1], "kind": "gap", "reason": item[2]}
    fields, payload = item.fields, payload_of(item.fields, item.block)
    revisit = fields.get("warc-type") == "revisit"
    if revisit:  # the full payload's length is in the HTTP header that a revisit keeps
        length = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", item.block)
        size, digest = int(length[1]) if length else None, fields.get("warc-payload-digest", "").removeprefix("sha256:")
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return {"archive": archive, "start": item.start, "stop": item.stop, "kind": "record",
            "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
            "target_uri": fields.get("warc-target-uri"), "page_id": _number(fields.get("x-page-id")),
            "refers_to": _number(fields.get("x-refers-to-page")), "payload_bytes": size, "payload_digest": digest,
            "payload": payload if keep_payload else None}


def _reader(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for item in salvage(content.as_py() or b""):
                    rows.append(_row(archive, item, keep_payload))
                    size += len(rows[-1].get("payload") or b"") + 1000
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``folder`` (plain or gzip members), see ``RECORDS``.

    ``kind`` is ``record`` or ``gap``; a gap has its byte range and the reason
    of the first failed check. For a revisit, payload_bytes and payload_digest
    are those of the full payload as its header states. Empty archives give no
    rows. An archive is read whole, so it should fit a task's memory a few times.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select("path", "content").mapInArrow(_reader(keep_payload), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read their records back."""
    folder = new_path(pages.sparkSession, "archives")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder, keep_payload=False).where("kind = 'record'")
