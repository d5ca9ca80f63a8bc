"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

* ``write_archives`` lays records out in archives, each one gzip stream over all
  its records, as many tools leave them.
* ``normalise`` inflates such a stream once, from start to end, rewrites every
  record as a gzip member of its own, and writes a sidecar index of offsets.
* ``read_archives`` reads each record by its offset and length alone.

Archives are rows (archive, content) of at most about ``ARCHIVE_BYTES`` of
records (one larger record makes a larger archive), so tables in any store that
Spark reaches can hold them; ``read_files`` takes ``.warc.gz`` files in through
Spark's reader and ``export_files`` writes archives and indexes as files.

Of records whose payloads are equal and have at least ``MIN_DEDUP`` bytes, the one
with the largest page_id is a response; the others are ``revisit`` records that
name it and carry no payload, only its digest and length.

Edge cases: a null html is an empty payload; a null url is written as an empty
target; a null page_id is written as an empty id, never chosen to be revisited,
and always a response; repeated rows give repeated records, equal ones of the
largest page_id are all responses; an empty table gives no archive and no row.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, maybe_in, ship

ARCHIVE_BYTES, MIN_DEDUP, LEVEL = 8 << 20, 1000, 3
#: Bits that tell which digests can occur twice.
DIGEST_BITS = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "array<struct<offset:long,length:long,record_id:string>>"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_id(page_id: int | None) -> str:
    return "<urn:page:>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(record: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record or "")
    return int(m[1]) if m else None


def target_uri(url: str | None) -> bytes:
    """A URL as a header value: blanks and controls, which would end it, as percent codes."""
    return re.sub(rb"[\x00-\x20\x7f%]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())


def url_of(value: bytes) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value).decode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: " + record_id(page_id).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + target_uri(url),
        b"Content-Type: text/html; charset=utf-8",
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"X-Payload-Length: %d" % len(payload),
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: " + record_id(refers_to).encode()]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(body), b"", b""]) + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, bytes], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.decode().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of one or more gzip streams, inflated once in order."""
    buffer, inflate = bytearray(), zlib.decompressobj(31)

    def cut(last: bool) -> Iterator[bytes]:
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) >= 0:
            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", bytes(buffer[at : end + 2]))
            if not length:
                raise ValueError("a record without Content-Length")
            to = end + 8 + int(length[1])
            if to > len(buffer):
                break
            yield bytes(buffer[at:to])
            at = to
        del buffer[:at]
        if last and buffer.strip():
            raise ValueError(f"{len(buffer)} bytes after the last whole record")

    for chunk in chunks:
        while chunk:
            buffer += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            yield from cut(False)
    yield from cut(True)


def member(raw: bytes) -> bytes:
    """A gzip member of its own."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def normalised(content: bytes, step: int = 1 << 20) -> tuple[bytes, list[dict]]:
    """A monolithic archive with one member per record, and its offset index."""
    out, index = bytearray(), []
    for raw in records_of(content[i : i + step] for i in range(0, len(content), step)):
        packed = member(raw)
        headers, _ = parse(raw)
        index.append({"offset": len(out), "length": len(packed), "record_id": headers["warc-record-id"].decode()})
        out += packed
    return bytes(out), index


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) for a table (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"))
    # Only payloads that occur more than once need a partner.  Their digests, light rows, come first;
    # a bitmap of them tells which records can be among them, and all others pass without a shuffle.
    large = (F.length("payload") >= MIN_DEDUP) & F.col("page_id").isNotNull()
    kept = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    kept = materialize(kept.select(F.col("digest").alias("_d"), "kept"), "kept")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(DIGEST_BITS)) + 1
    maybe = large & maybe_in(kept.select(bit(F.col("_d")).alias("b")), bit(F.col("digest")), DIGEST_BITS)
    found = rows.where(maybe).join(kept, F.col("digest") == F.col("_d"), "left")
    found = found.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("kept"), F.col("kept")).alias("refers_to"))
    return rows.where(~maybe | maybe.isNull()).select("*", F.lit(None).cast("long").alias("refers_to")).union(found)


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): monolithic gzip archives of the records of ``plan_records``."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([b"".join(parts)], pa.large_binary()).cast(pa.binary())], ["archive", "content"])

        size, parts, pack = 0, [], zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for b in batches:
            for page, url, payload, digest, refers in zip(*(b.column(i) for i in range(5)), strict=True):
                raw = record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())
                if size and size + len(raw) > archive_bytes:
                    yield row([*parts, pack.flush()])
                    size, parts, pack = 0, [], zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                parts.append(pack.compress(raw))
                size += len(raw)
        if size:
            yield row([*parts, pack.flush()])

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, content binary")


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, content, index) of archives (archive, content): a member per record and their offsets."""
    ship(archives.sparkSession)
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                out, index = normalised(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([out], pa.binary()), pa.array([index], kind)], ["archive", "content", "index"])

    return archives.select("archive", "content").mapInArrow(run, f"archive string, content binary, index {_INDEX}")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives, each read by its index entry."""
    ship(archives.sparkSession)
    names = [f.split()[0] for f in _RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, index in zip(b.column(0), b.column(1), strict=True):
                view, rows = memoryview(content.as_buffer()), []
                for e in index.as_py():
                    raw = zlib.decompress(view[e["offset"] : e["offset"] + e["length"]], 31)
                    headers, block = parse(raw)
                    kind = headers["warc-type"].decode()
                    digest = headers["warc-payload-digest"].decode().removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(block).hexdigest() != digest:  # noqa: S324
                        raise ValueError(f"payload of {e['record_id']} doesn't match its digest")
                    size = len(block) if kind == "response" else int(headers["x-payload-length"])
                    refers = page_of(headers.get("warc-refers-to", b"").decode())
                    rows.append((page_of(e["record_id"]), url_of(headers["warc-target-uri"]), kind, size, digest, refers, block))
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return archives.select("content", "index").mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives, and read every record back."""
    archives = materialize(write_archives(plan_records(pages)), "monolithic")
    return read_archives(materialize(normalise(archives), "normalised"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of ``.warc.gz`` files, monolithic or not, in any store Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def export_files(archives: DataFrame, to: str) -> DataFrame:
    """Write normalised archives as ``.warc.gz`` with ``.idx`` sidecars below ``to``; returns (archive, file).

    ``to`` is a URI of a store that pyarrow reaches from every executor.
    """
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, content, index in zip(*(b.column(i) for i in range(3)), strict=True):
                store, base = fs.FileSystem.from_uri(to)
                stem = f"{base}/{re.sub(r'[^A-Za-z0-9_-]', '_', name.as_py())}"
                store.create_dir(base)
                with store.open_output_stream(f"{stem}.warc.gz", compression=None) as f:
                    f.write(content.as_buffer())
                with store.open_output_stream(f"{stem}.idx", compression=None) as f:
                    f.write("".join(f"{e['offset']}\t{e['length']}\t{e['record_id']}\n" for e in index.as_py()).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([f"{stem}.warc.gz"])], ["archive", "file"])

    return archives.select("archive", "content", "index").mapInArrow(run, "archive string, file string")
