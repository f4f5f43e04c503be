"""Shared pieces of the text operators: sessions, shared folders, byte-level numpy helpers.

Everything here works on one Arrow batch or one chunk of documents at a time, so
memory is bounded by the batch and by the longest single document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Fixed odd multipliers of the rolling and mixing hashes.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Smallest long; stands for a null doc_id inside joins, so null ids order first.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; where it is unset, one of our own in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def doc_key(column: str = "doc_id") -> Column:
    """`doc_id` as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_tag(column: str = "text") -> Column:
    """A 64-bit tag of the text, which tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that clash with names an operator is about to add."""
    clash = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in clash])


def fresh(columns: list[str], name: str) -> str:
    """`name`, with underscores put before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ---------------------------------------------------------------- numpy helpers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(MIX_1)
    x = (x ^ (x >> U64(27))) * U64(MIX_2)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            factors = np.full(size, base, U64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the polynomial of codes[i:j]."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of codes[start:stop], the same wherever the span stands. It only brings candidates together: bytes are compared before anything rests on it."""
    down = powers(len(prefix))[1]
    return mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(U64))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w], by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], target: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `target` bytes; a longer document is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > target:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


WORD_TABLES: dict[str, np.ndarray] = {}


def word_table(kind: str) -> np.ndarray:
    """Which bytes belong to words: 'space' splits at white space; 'alnum' keeps a-z, A-Z, digits and non-ASCII."""
    if kind not in WORD_TABLES:
        table = np.ones(256, bool)
        if kind == "space":
            table[list(SPACE_BYTES)] = False
        else:
            ascii_bytes = np.arange(128)
            keep = ((ascii_bytes >= 0x30) & (ascii_bytes <= 0x39)) | ((ascii_bytes >= 0x41) & (ascii_bytes <= 0x5A)) | ((ascii_bytes >= 0x61) & (ascii_bytes <= 0x7A))
            table[:128] = keep
        WORD_TABLES[kind] = table
    return WORD_TABLES[kind]


class Words:
    """The words of a run of documents: byte spans in `raw`, one hash each, and each document's first word.

    raw: the documents' bytes (A-Z lowered on request), a line feed after each.
    """

    def __init__(self, texts: list[bytes], kind: str = "space", lower: bool = False):
        self.raw = b"\n".join(texts) + b"\n"
        if lower:
            self.raw = self.raw.lower()  # bytes.lower() touches A-Z only
        self.buf = np.frombuffer(self.raw, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_at = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = word_table(kind)[self.buf]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.stop = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.doc_at)  # per document, and the end
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(BYTE_CODE[self.buf]), self.start, self.stop)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task's copies of texts are bounded by few rows; Arrow hands back the memory of batches that are done."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
        del b
        pa.default_memory_pool().release_unused()


def sized(batches: Iterator[pa.RecordBatch], target: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of texts of about `target` bytes, or of one longer text."""
    for b in batches:
        at, most = 0, max(1, int(target * b.num_rows / max(1, b.nbytes)))
        while at < b.num_rows:
            yield b.slice(at, most)
            at += most
        del b
        pa.default_memory_pool().release_unused()


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
