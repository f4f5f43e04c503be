"""MAT files of level 5 as a Spark data source and sink, variable by variable.

A file is a head and tagged elements, maybe compressed one by one; a task reads a file and
holds one variable at a time. Fields of structs and members of cells are variables of their
own, named by their paths. Numbers are read in the file's byte order and written little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .recordings import DraftWriter
from .stores import direct, files_under, opened, put_groups, shared_path

#: Fixed values of the format: element types, and classes of arrays.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED, HEAD = 14, 15, 128
CLASSES = {1: "cell", 2: "struct", 4: "char", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}
ROWS = "file string, name string, class string, dims array<long>, x array<double>, text string"
ARROW = pa.schema([("file", pa.string()), ("name", pa.string()), ("class", pa.string()), ("dims", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("text", pa.string())])


def element(raw: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """(type, content, where the next element begins) of an element; content of up to four bytes may stand in its tag."""
    (tag,) = struct.unpack_from(order + "I", raw, at)
    if tag >> 16:
        return tag & 0xFFFF, raw[at + 4 : at + 4 + (tag >> 16)], at + 8
    kind, size = struct.unpack_from(order + "II", raw, at)
    stop = at + 8 + size
    return kind, raw[at + 8 : stop], stop if kind == COMPRESSED else -(-stop // 8) * 8


def numbers(raw: bytes, at: int, order: str) -> tuple[np.ndarray, int]:
    kind, content, at = element(raw, at, order)
    return np.frombuffer(content, order + KINDS[kind]), at


def variables(raw: bytes, order: str, path: str = "") -> Iterator[tuple[str, str, list[int], np.ndarray, str | None]]:
    """(name, class, dims, values column by column, text) of the arrays in the content of a matrix element."""
    if not raw:  # an empty member
        yield path, "double", [0, 0], np.zeros(0), None
        return
    flags, at = numbers(raw, 0, order)
    kind = CLASSES.get(int(flags[0]) & 0xFF, "other")
    dims, at = numbers(raw, at, order)
    _, name, at = element(raw, at, order)
    path = path or name.decode("ascii", "replace")
    count = int(np.prod(dims, dtype=np.int64))
    if kind == "struct":
        (width,), at = numbers(raw, at, order)
        _, names, at = element(raw, at, order)
        fields = [names[i : i + width].split(b"\0")[0].decode("ascii", "replace") for i in range(0, len(names), width)]
        places = [f"{path}{f'({k + 1})' if count > 1 else ''}.{f}" for k in range(count) for f in fields]
    elif kind == "cell":
        places = [f"{path}{{{k + 1}}}" for k in range(count)]
    elif kind == "other":
        return
    else:
        x, at = numbers(raw, at, order)
        text = "".join(map(chr, x.tolist())) if kind == "char" else None
        yield path, kind, dims.tolist(), x.astype(float), text
        return
    for place in places:
        _, content, at = element(raw, at, order)
        yield from variables(content, order, place)


def parsed(raw: bytes) -> Iterator[tuple[str, str, list[int], np.ndarray, str | None]]:
    if len(raw) < HEAD or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order = "<" if raw[126:128] == b"IM" else ">"
    at = HEAD
    while at + 8 <= len(raw):
        kind, content, at = element(raw, at, order)
        if kind == COMPRESSED:
            kind, content, _ = element(zlib.decompress(content), 0, order)
        if kind == MATRIX:
            yield from variables(content, order)


def tagged(kind: int, content: bytes) -> bytes:
    return struct.pack("<II", kind, len(content)) + content + bytes(-len(content) % 8)


def matrix_bytes(name: str, dims: list[int], x: np.ndarray, compressed: bool = True) -> bytes:
    """An element of doubles."""
    body = tagged(6, struct.pack("<II", 6, 0)) + tagged(5, np.array(dims, "<i4").tobytes()) + tagged(1, name.encode("ascii")) + tagged(9, np.asarray(x, "<f8").tobytes())
    whole = tagged(MATRIX, body)
    if not compressed:
        return whole
    packed = zlib.compress(whole)
    return struct.pack("<II", COMPRESSED, len(packed)) + packed


def file_bytes(elements: list[bytes]) -> bytes:
    return b"MATLAB 5.0 MAT-file".ljust(124, b" ") + struct.pack("<H", 0x0100) + b"IM" + b"".join(elements)


def batches(path: str, raw: bytes) -> Iterator[pa.RecordBatch]:
    """A row a variable."""
    for name, kind, dims, x, text in parsed(raw):
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip((path, name, kind, dims, x, text), ARROW, strict=True)], schema=ARROW)


@dataclass
class File(InputPartition):
    path: str

    def __post_init__(self) -> None:
        super().__init__(None)


class MatReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[File]:
        return [File(path) for path, _ in files_under(self.path) if path.endswith(".mat")]

    def read(self, part: File | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's one task where there is no file
            return
        system, place = opened(part.path)
        with system.open_input_file(place) as f:
            raw = f.read()
        yield from batches(part.path, raw)


class MatWriter(DraftWriter):
    """Files from rows (file, name, dims, x)."""

    def build(self, rows: pa.Table) -> bytes:
        parts = zip(rows["name"].to_pylist(), rows["dims"].to_pylist(), rows["x"].to_pylist(), strict=True)
        return file_bytes([matrix_bytes(name, dims, np.array(x, float)) for name, dims, x in parts])


class MatFiles(DataSource):
    """Options: path (a file or folder)."""

    @classmethod
    def name(cls) -> str:
        return "mat5"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MatReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return MatWriter(dict(self.options))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, class, dims, x array<double>, text): a row a variable, values column by column."""
    path = shared_path(spark, path)
    if direct(path):
        spark.dataSource.register(MatFiles)
        return spark.read.format("mat5").load(path)

    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in files:
            for name, raw in zip(b["path"].to_pylist(), b["content"], strict=True):
                yield from batches(name, raw.as_py())

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(path).select("path", "content").mapInArrow(run, ROWS)


def write(variables_: DataFrame, folder: str) -> None:
    """Files of doubles from (file, name, dims array<long>, x array<double>), all of them or none."""
    spark = variables_.sparkSession
    folder = shared_path(spark, folder)
    rows = variables_.select(F.concat("file", F.lit(".mat")).alias("file"), "name", F.col("dims").cast("array<long>").alias("dims"), F.col("x").cast("array<double>").alias("x"))
    if not direct(folder):
        writer = MatWriter({"path": folder})
        put_groups(rows, "file", folder, lambda _, group: writer.build(group.sort_by("name")))
        return
    spark.dataSource.register(MatFiles)
    rows.repartition("file").sortWithinPartitions("file", "name").write.format("mat5").mode("append").save(folder)


def write_spiketrains(trains: DataFrame, folder: str) -> None:
    """A file a cell from (cell, ts_ms array<double>, spike_form array<array<double>>): `timestamps`, a row, and `spikeForm`, channels by samples."""
    times = trains.select(F.col("cell").alias("file"), F.lit("timestamps").alias("name"), F.array(F.lit(1).cast("long"), F.size("ts_ms").cast("long")).alias("dims"), F.col("ts_ms").alias("x"))
    samples = F.size(F.get("spike_form", F.lit(0)))
    by_column = F.flatten(F.transform(F.sequence(F.lit(0), samples - 1), lambda i: F.transform("spike_form", lambda c: F.get(c, i))))
    forms = trains.select(F.col("cell").alias("file"), F.lit("spikeForm").alias("name"), F.array(F.size("spike_form").cast("long"), samples.cast("long")).alias("dims"), by_column.alias("x"))
    write(times.union(forms), folder)
