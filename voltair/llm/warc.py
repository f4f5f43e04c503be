"""WARC archives: writing, normalising whole-file gzip into one member a record, reading by a sidecar index.

A `.warc.gz` compressed as one stream can only be read from its start. The
normaliser inflates it once, in pieces, cuts the stream into records as they
complete, writes every record as a gzip member of its own, and lists each member's
offset and length in a sidecar index, with which any record is read alone.

Archives are rows (archive, data) of a table in the shared folder, some megabytes
each: Spark writes and reads them wherever that folder is.

Revisits: of pages with equal payloads (SHA-1 and length) the smallest page_id is
the response and the others refer to it. Which id that is, is found by a grouped
minimum that is pre-aggregated and stored, for digests that occur more than once, and
joined back on the digest; a digest that fills the corpus is one row on that side, and
as no aggregate stands under the join, adaptive execution splits the other side.

Defined cases: null html is an empty payload; a null page_id orders after all
others, and pages that have no other id are all responses; repeated rows of the
smallest id are all responses; a null url has no target; line breaks in urls are
percent-coded; a very long page is one record of an archive that ends with it; empty
tables give no archives; other columns of the pages are left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bytes of records after which a new archive begins.
ARCHIVE_BYTES = 4 << 20
GZIP, LEVEL, PIECE = 31, 6, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ARCHIVES = "archive string, data binary"
NORMALISED = "archive string, data binary, entries array<struct<offset: long, length: long, record_id: string, record_type: string>>"
ENTRIES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]))
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    pass


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    return int(name[10:-1]) if len(name) > 11 else None


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """The WARC record of a page; first: the page_id of the response it revisits, or None."""
    revisit = first is not None
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    fields += [f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        fields += [f"WARC-Refers-To: {record_id(first)}", f"WARC-Profile: {PROFILE}"]
    body = HTTP if revisit else HTTP + payload
    return ("\r\n".join([*fields, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("no record begins here")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def split(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) as they complete, from a stream in pieces."""
    held = bytearray()
    fields, need, body_at = None, 0, 0
    for piece in pieces:
        held += piece
        while True:
            if fields is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                fields = fields_of(bytes(held[:end]))
                body_at = end + 4
                need = body_at + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            if held[need - 4 : need] != b"\r\n\r\n":
                raise WarcError("a record doesn't end where its length says")
            yield fields, bytes(held[:need])
            del held[:need]
            fields = None
    if held:
        raise WarcError("the archive is cut off")


def inflate(data: bytes) -> Iterator[bytes]:
    """A gzip file of one or more members, in pieces."""
    d = zlib.decompressobj(GZIP)
    rest = data
    while rest:
        for a in range(0, len(rest), PIECE):
            out = d.decompress(rest[a : a + PIECE])
            if out:
                yield out
            if d.eof:
                rest = d.unused_data + rest[a + PIECE :]
                d = zlib.decompressobj(GZIP)
                break
        else:
            raise WarcError("the gzip stream is cut off")


def deflate(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return c.compress(data) + c.flush()


def with_first(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, first): the response each page revisits; null for responses."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html"))
    smallest = rows.groupBy("digest", "size").agg(F.min("page_id").alias("smallest"), F.count("*").alias("n")).where("n > 1").drop("n")
    smallest = materialise(smallest, "warc-firsts")
    other = F.coalesce(F.col("page_id") != F.col("smallest"), F.col("smallest").isNotNull())
    return rows.join(smallest, ["digest", "size"], "left").select("page_id", "url", "html", F.when(other, F.col("smallest")).alias("first"))


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives, each compressed as one gzip stream, of the rows of with_first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size = TaskContext.get().partitionId(), 0, 0
        c, out = zlib.compressobj(1, zlib.DEFLATED, GZIP), []
        for b in batches:
            for page_id, url, html, first in zip(*(b[n].to_pylist() for n in ("page_id", "url", "html", "first")), strict=True):
                data = record(page_id, url, html.encode(), first)
                out.append(c.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield pa.record_batch([pa.array([f"pages-{part:06d}-{count:06d}"]), pa.array([b"".join([*out, c.flush()])], pa.binary())], names=["archive", "data"])
                    c, out, count, size = zlib.compressobj(1, zlib.DEFLATED, GZIP), [], count + 1, 0
        if size:
            yield pa.record_batch([pa.array([f"pages-{part:06d}-{count:06d}"]), pa.array([b"".join([*out, c.flush()])], pa.binary())], names=["archive", "data"])

    return pages.mapInArrow(run, ARCHIVES)


def normalise(archives: DataFrame) -> DataFrame:
    """Archives with one gzip member a record, and their index entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b["archive"].to_pylist(), b["data"].to_pylist(), strict=True):
                members, entries, at = [], [], 0
                for fields, whole in split(inflate(data)):
                    member = deflate(whole)
                    entries.append({"offset": at, "length": len(member), "record_id": fields["warc-record-id"], "record_type": fields["warc-type"]})
                    members.append(member)
                    at += len(member)
                yield pa.record_batch([pa.array([name]), pa.array([b"".join(members)], pa.binary()), pa.array([entries], ENTRIES)], names=["archive", "data", "entries"])

    return archives.mapInArrow(run, NORMALISED)


def index(normalised: DataFrame) -> DataFrame:
    """The sidecar index, written as a table of its own: archive, offset, length, record_id, record_type."""
    return materialise(normalised.select("archive", F.inline("entries")), "warc-index")


def fetch(normalised: DataFrame, entries: DataFrame) -> DataFrame:
    """(record_id string, record binary): records at some entries of the index; only their bytes of an archive are handed on and inflated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b["record_id"], pa.array([zlib.decompress(x, GZIP) for x in b["member"].to_pylist()], pa.binary())], names=["record_id", "record"])

    place = F.col("offset").cast("int") + 1, F.col("length").cast("int")  # an archive is far below 2 GB
    found = normalised.select("archive", "data").join(entries, "archive").select("record_id", F.substring("data", *place).alias("member"))
    return found.mapInArrow(run, "record_id string, record binary")


def read(normalised: DataFrame) -> DataFrame:
    """PAGES from normalised archives, each record inflated alone at its index entry; digests are verified."""

    def rows_of(data: bytes, entries: list[dict]) -> Iterator[tuple]:
        for e in entries:
            whole = zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], GZIP)
            head, _, body = whole.partition(b"\r\n\r\n")
            fields = fields_of(head)
            payload = body[len(HTTP) : -4]
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            revisit = fields["warc-type"] == "revisit"
            if not revisit and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(fields["x-payload-length"])):
                raise WarcError(f"payload of {fields['warc-record-id']} is damaged")
            yield page_of(fields["warc-record-id"]), int(fields["x-payload-length"]), digest, fields["warc-type"], page_of(fields["warc-refers-to"]) if revisit else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, entries in zip(b["data"].to_pylist(), b["entries"].to_pylist(), strict=True):
                if entries:
                    columns = zip(*rows_of(data, entries), strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return normalised.mapInArrow(run, PAGES)


def archive(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Normalised archives of pages(page_id, url, html), stored in the shared folder."""
    return materialise(normalise(write(with_first(pages), archive_bytes)), "warc")
