"""WARC: write pages as records of monolithic gzip archives, normalise those to one member per record with an offset index, read back.

An archive is a row of a table (``archive``, ``data``), so that Spark's writers place it on whatever file system the cluster shares; its
sidecar index is a second table (``archive``, ``offset``, ``length``, ``record_id``, ``record_type``). Records are read back by the index:
each member is cut out of its archive at its offset and opened alone. ``export_archives`` writes an archive's bytes as a file that any WARC
reader opens.

Defined cases: null html is an empty payload; a null url leaves out WARC-Target-URI; control characters in a url are percent-encoded;
a null page_id is below every other id; repeated rows of the largest page_id are all responses; an empty table gives no records;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .runtime import Scratch, durable, join_hot

#: Bytes of uncompressed records after which a new archive begins.
ARCHIVE_BYTES = 16 << 20
_ID = "urn:dialogmill:page:"
_ARCHIVES = "archive string, data binary"
_NORMAL = "archive string, data binary, members array<struct<offset:bigint,length:bigint,record_id:string,record_type:string>>"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def plan_records(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """page_id, url, html, and ``keeper``: the largest page_id of an equal payload that also occurs elsewhere (else null).

    Digests are grouped without the payloads (partial sums first, so a hot payload costs one row a task); the result joins back by
    broadcast if counted small, else by digest and a salt.
    """
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    repeated = (
        own.filter(F.octet_length("html") >= at_least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("digest", "keeper")
    )
    repeated = durable(repeated, "repeated")
    return join_hot(own, repeated, ["digest"], "page_id", at_most=repeated.count(), how="left").select("page_id", "url", "html", "keeper")


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str) -> bytes:
    """One WARC 1.1 record; a revisit (``keeper`` is another page) carries the HTTP header alone."""
    revisit = keeper is not None and page_id != keeper
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{keeper}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(records: DataFrame, date: str = "2024-01-01T00:00:00Z", level: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Monolithic archives: each row is one gzip stream over many records, as older crawlers wrote them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = TaskContext.get().partitionId(), 0, 0
        pack, out = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:05d}"]), pa.array([b"".join(out) + pack.flush()], pa.binary())], ["archive", "data"])

        for batch in batches:
            for page_id, url, html, keeper in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "keeper"))):
                if pack is None:
                    pack, out, size = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
                raw = record(page_id, url, html.encode(), keeper, date)
                out.append(pack.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield row()
                    pack, n = None, n + 1
        if pack is not None:
            yield row()

    return records.mapInArrow(write, _ARCHIVES)


def _inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's bytes, piece by piece; further members in it are read on."""
    at, view = 0, memoryview(data)
    unpack = zlib.decompressobj(31)
    while at < len(view):
        out = unpack.decompress(view[at : at + step])
        at += step
        if unpack.eof:
            at -= len(unpack.unused_data)
            unpack = zlib.decompressobj(31)
        if out:
            yield out


def _split(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of each record of a WARC stream, without holding the stream; a record's bytes are looked at once."""
    held, head, need, seen = bytearray(), None, 0, 0
    for piece in pieces:
        held += piece
        at = 0
        while True:
            if head is None:
                end = held.find(b"\r\n\r\n", max(at, seen))
                if end < 0:
                    seen = max(at, len(held) - 3)
                    break
                head = dict(x.split(": ", 1) for x in held[at:end].decode().split("\r\n")[1:])
                need = end - at + 4 + int(head["Content-Length"]) + 4
            if len(held) - at < need:
                break
            yield head, bytes(held[at : at + need])
            at, head, seen = at + need, None, 0
        if at:
            del held[:at]
            seen = max(0, seen - at)
    if held:
        raise ValueError("the archive ends inside a record")


def normalise(archives: DataFrame, level: int = 1) -> DataFrame:
    """Inflate each archive's stream once and rewrite every record as a gzip member of its own: (archive, data, members), where ``members``
    tells each one's place in ``data``, record id and type."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]))
        for batch in batches:
            for i in range(batch.num_rows):
                out, members = bytearray(), []
                for head, raw in _split(_inflate(batch.column(1)[i].as_buffer())):
                    member = gzip.compress(raw, level, mtime=0)
                    members.append({"offset": len(out), "length": len(member), "record_id": head["WARC-Record-ID"], "record_type": head["WARC-Type"]})
                    out += member
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([bytes(out)], pa.binary()), pa.array([members], kind)], ["archive", "data", "members"])

    return archives.mapInArrow(rewrite, _NORMAL)


def sidecar_index(normal: DataFrame) -> DataFrame:
    """archive, offset, length, record_id, record_type."""
    return normal.select("archive", F.inline("members"))


def read_records(archives: DataFrame, index: DataFrame) -> DataFrame:
    """Read every record that ``index`` names: cut it out of its archive at its offset, gunzip it alone, check its id and a response's payload
    against its digest header, resolve revisits. An archive meets its part of the index, which its size bounds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for archive, data, members in zip(batch.column("archive").to_pylist(), batch.column("data"), batch.column("members").to_pylist()):
                view, rows = memoryview(data.as_buffer()), []
                for m in members:
                    ((head, raw),) = _split(_inflate(view[m["offset"] : m["offset"] + m["length"]]))
                    if head["WARC-Record-ID"] != m["record_id"]:
                        raise ValueError(f"the index of {archive} names another record at {m['offset']}")
                    body = raw[raw.index(b"\r\n\r\n") + 4 : -4]
                    http, payload = body.split(b"\r\n\r\n", 1)
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"record {head['WARC-Record-ID']} of {archive} is damaged")
                    ids = [None if (x := head.get(k, "null").removeprefix(f"<{_ID}").rstrip(">")) == "null" else int(x) for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    rows.append((ids[0], head.get("WARC-Target-URI"), length, digest, head["WARC-Type"], ids[1], archive, m["offset"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in _RECORDS.split(", ")])

    members = index.groupBy("archive").agg(F.collect_list(F.struct("offset", "length", "record_id")).alias("members"))
    return archives.select("archive", "data").join(members, "archive").mapInArrow(read, _RECORDS)


def export_archives(normal: DataFrame, folder: str) -> None:
    """Write normalised archives as ``<archive>.warc.gz`` into a folder that this process can open (tests, small exports)."""
    for row in normal.select("archive", "data").toLocalIterator():
        with open(f"{folder}/{row.archive}.warc.gz", "wb") as f:
            f.write(row.data)


def warc_round_trip(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Pages → monolithic archives → normalised archives and their sidecar index (two written tables) → records, read by the index."""
    with Scratch() as scratch:
        archives = durable(write_archives(plan_records(pages, at_least)), "warc-monolithic")
        normal = scratch.keep(durable(normalise(archives), "warc-normalised"))
    index = durable(sidecar_index(normal), "warc-index")
    return read_records(normal, index)
