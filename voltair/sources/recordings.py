"""Recordings as a Spark data source with range scans and commits, and sinks that write files from tasks.

The source plans from headers alone: each file becomes partitions of so many samples,
and a task reads only its bytes; predicates on file, channel and time narrow the plan.
The sink writes drafts, which become files when all tasks are done and vanish otherwise.
Paths are of any file system that Spark reaches and all executors share; outside local
mode they need a scheme; viewfs is followed to the store it mounts. Where pyarrow doesn't
open a store, Spark's own readers and writers move the files (`stores`).
Layouts are fixed values of the file formats, little-endian.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from . import CHUNK, signal_bytes, signal_header, sync_bytes, waveform_bytes
from .stores import direct, files_under, heads, listed, opened, put_groups, shared_path

#: Sample types by the code in an Npt header.
NPT_TYPES = {1: "u1", 2: "u1", 3: "i1", 4: "i2", 5: "i4", 6: "i8", 7: "u1", 8: "u2", 9: "u4", 10: "u8", 11: "f2", 12: "f4", 13: "f8", 14: "f8"}
#: A rate that the recorder states and the one it has.
UEI_RATE = {30_000: 29_990}
HEAD = 512


@dataclass(frozen=True)
class Header:
    size: int
    rate: int
    channels: int
    kind: str
    low: float = 0.0
    high: float = 0.0
    bits: int = 0


def header_of(raw: bytes, layout: str) -> Header:
    if layout == "npt":
        size, channels, rate, code = struct.unpack_from("<iBIb", raw)
        return Header(size, rate, channels, NPT_TYPES[code])
    if layout == "uei":
        size, rate, channels, low, high, bits = struct.unpack_from("<iIBddB", raw)
        return Header(size, UEI_RATE.get(rate, rate), channels, "i2", low, high, bits)
    return Header(*signal_header(raw), "i2")


def npt_bytes(x: np.ndarray, rate: int, code: int) -> bytes:
    return struct.pack("<iBIb", 10, x.shape[1], rate, code) + x.astype("<" + NPT_TYPES[code]).tobytes()


def uei_bytes(x: np.ndarray, rate: int, low: float, high: float, bits: int) -> bytes:
    channels = x.shape[1]
    head = struct.pack("<iIBddB", 26 + channels, rate, channels, low, high, bits) + bytes(range(channels))
    return head + x.astype("<i2").tobytes()


@dataclass
class Stretch(InputPartition):
    """Samples start .. stop of a file; of some channels, or of all."""

    path: str
    head: Header
    start: int
    stop: int
    channels: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        super().__init__(None)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict, fields: StructType):
        self.path, self.layout = options["path"], options.get("layout", "signal")
        self.only_headers = options.get("headers", "false") == "true"
        self.start, self.stop = int(options.get("start", 0)), options.get("stop")
        self.per_task = int(options.get("samplespertask", 16 * CHUNK))
        self.by_sample = options.get("samples", "false") == "true"
        self.low, self.high = 0, None  # samples that pushed predicates leave
        self.channels: set[int] | None = None
        self.files: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of `t` (of `t0`: none, a chunk begins before), values of `ch` and `file`. Spark checks all rows again."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else ""
            if isinstance(f, EqualTo | In) and name in ("ch", "file"):
                values = set(f.value) - {None} if isinstance(f, In) else {f.value}
                known = self.channels if name == "ch" else self.files
                values = values if known is None else known & values
                self.channels, self.files = (values, self.files) if name == "ch" else (self.channels, values)
            elif name == "t" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    stop = f.value + (not isinstance(f, LessThan))
                    self.high = stop if self.high is None else min(self.high, stop)
        return filters

    def headed(self, file: tuple[str, int]) -> list[Stretch]:
        """The stretches of one file, from its header alone."""
        path, size = file
        system, place = opened(path)
        with system.open_input_file(place) as f:
            return self.stretches(path, size, f.read(HEAD))

    def stretches(self, path: str, size: int, raw: bytes) -> list[Stretch]:
        """raw: the file's first bytes."""
        head = header_of(raw.ljust(HEAD, b"\0"), self.layout)
        samples = (size - head.size) // (np.dtype(head.kind).itemsize * head.channels)
        if self.only_headers:
            return [Stretch(path, head, 0, samples)]
        stop = samples if self.stop is None else int(self.stop)
        if not 0 <= self.start <= stop <= samples:
            raise ValueError(f"{path} has {samples} samples, none of them {self.start} to {stop}")
        start, stop = max(self.start, self.low), stop if self.high is None else min(stop, self.high)
        channels = None if self.channels is None else tuple(sorted(c for c in self.channels if 0 <= c < head.channels))
        if start >= stop or channels == ():
            return []
        edges = [*range(start, stop, self.per_task), stop]
        return [Stretch(path, head, a, b, channels) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def partitions(self) -> list[Stretch]:
        found = [f for f in files_under(self.path) if self.files is None or f[0] in self.files]
        with ThreadPoolExecutor(16) as pool:  # a small read a file
            return [part for parts in pool.map(self.headed, found) for part in parts]

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's one task where the plan has no part
            return
        h = part.head
        if self.only_headers:
            yield pa.record_batch([pa.array([part.path]), pa.array([h.rate]), pa.array([h.channels]), pa.array([part.stop])], names=["file", "rate", "channels", "samples"])
            return
        system, place = opened(part.path)
        with system.open_input_file(place) as f:
            yield from self.rows(part, f)

    def rows(self, part: Stretch, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        h = part.head
        width = np.dtype(h.kind).itemsize * h.channels
        chosen = list(range(h.channels)) if part.channels is None else list(part.channels)
        for t in range(part.start, part.stop, CHUNK):
            n = min(CHUNK, part.stop - t)
            x = np.frombuffer(f.read_at(n * width, h.size + t * width), "<" + h.kind).reshape(-1, h.channels)[:, chosen].astype(float)
            if self.by_sample:
                for c, column in zip(chosen, x.T, strict=True):
                    yield pa.record_batch([pa.repeat(pa.scalar(part.path), n), pa.array(np.full(n, h.rate, np.int64)), pa.array(np.full(n, c, np.int32)), pa.array(t + np.arange(n)), pa.array(np.ascontiguousarray(column))], names=["file", "rate", "ch", "t", "x"])
                continue
            many = len(chosen)
            columns = {
                "file": pa.array([part.path] * many),
                "rate": pa.array(np.full(many, h.rate, np.int64)),
                "ch": pa.array(np.array(chosen, dtype=np.int32)),
                "t0": pa.array(np.full(many, t, np.int64)),
                "x": pa.array(list(x.T), pa.list_(pa.float64())),
                "low": pa.array(np.full(many, h.low)),
                "high": pa.array(np.full(many, h.high)),
                "bits": pa.array(np.full(many, h.bits, np.int32)),
            }
            yield pa.record_batch(list(columns.values()), names=list(columns))


@dataclass
class Drafts(WriterCommitMessage):
    """(draft, name) of the files a task has written."""

    files: list[tuple[str, str]]


class DraftWriter(DataSourceArrowWriter):
    """One file a value of `file` from rows in order of file. Drafts stand in a folder of the job's own and are moved when all tasks are done; otherwise the folder goes."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.job = f"_drafts-{uuid.uuid4().hex}"

    def build(self, rows: pa.Table) -> bytes:
        """The bytes of a file from all its rows."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafts:
        system, place = opened(self.folder)
        drafts, now, held = [], None, []

        def flush() -> None:
            if now is None:
                return
            data = self.build(pa.Table.from_batches(held))
            system.create_dir(f"{place}/{self.job}", recursive=True)
            draft = f"{place}/{self.job}/{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(data)
            drafts.append((draft, now))

        for b in iterator:
            names = b["file"].to_pylist()
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a < z:
                    if names[a] != now:
                        flush()
                        now, held = names[a], []
                    held.append(b.slice(a, z - a))
        flush()
        return Drafts(drafts)

    def commit(self, messages: list[Drafts | None]) -> None:
        system, place = opened(self.folder)
        system.create_dir(place, recursive=True)
        for m in messages:
            for draft, name in m.files if m else ():
                system.move(draft, f"{place}/{name}")
        self.clear()

    def abort(self, messages: list[Drafts | None]) -> None:
        self.clear()

    def clear(self) -> None:
        from pyarrow import fs

        system, place = opened(self.folder)
        if system.get_file_info(f"{place}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{place}/{self.job}")  # drafts of this job: those of attempts that failed


class RecordingWriter(DraftWriter):
    """Recordings from rows (file, ch, t, x)."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.layout, self.rate = options.get("layout", "signal"), int(options["rate"])
        self.channels = int(options["channels"]) if "channels" in options else None
        self.code, self.low, self.high, self.bits = int(options.get("code", 4)), float(options.get("low", -1)), float(options.get("high", 1)), int(options.get("bits", 14))

    def build(self, rows: pa.Table) -> bytes:
        ch, t, x = (rows[c].to_numpy() for c in ("ch", "t", "x"))
        t = t - t.min()
        out = np.zeros((int(t.max()) + 1, self.channels or int(ch.max()) + 1))
        out[t, ch] = x
        kind = NPT_TYPES[self.code] if self.layout == "npt" else "i2"
        if kind[0] != "f":
            out = np.clip(np.rint(out), np.iinfo(kind).min, np.iinfo(kind).max)
        if self.layout == "npt":
            return npt_bytes(out, self.rate, self.code)
        return uei_bytes(out, self.rate, self.low, self.high, self.bits) if self.layout == "uei" else signal_bytes(out, self.rate)


class Recordings(DataSource):
    """Options: path (a file or folder), layout (signal, npt, uei), headers, samples (a row a sample), start and stop (samples), samplesPerTask. Of sinks: path, layout, rate, channels, code, low, high, bits."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        if self.options.get("headers", "false") == "true":
            return "file string, rate long, channels long, samples long"
        if self.options.get("samples", "false") == "true":
            return "file string, rate long, ch int, t long, x double"
        return "file string, rate long, ch int, t0 long, x array<double>, low double, high double, bits int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordingReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordingWriter(dict(self.options))


def reader(spark: SparkSession) -> DataFrameReader:
    """Of the source of recordings. It switches Spark's pushdown into Python sources on, as sources that take predicates need it."""
    spark.dataSource.register(Recordings)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("recording")


def loaded(spark: SparkSession, path: str, **options) -> DataFrame:
    """The source's rows. Where pyarrow doesn't open the store, Spark reads whole files (each below 2 GB), and predicates hold after that."""
    path = shared_path(spark, path)
    if direct(path):
        return reader(spark).options(**options).load(path)
    given = {"path": path} | {k.lower(): str(v) for k, v in options.items()}
    source = RecordingReader(given, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b["path"].to_pylist(), b["content"], strict=True):
                buffer = raw.as_buffer()
                for part in source.stretches(name, buffer.size, buffer[:HEAD].to_pybytes()):
                    yield from source.rows(part, pa.BufferReader(buffer))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, Recordings(given).schema())


def samples(spark: SparkSession, path: str, layout: str = "signal", per_task: int = 16 * CHUNK) -> DataFrame:
    """(file, rate, ch int, t, x), a row a sample; predicates on file, ch and t become byte ranges of the files."""
    return loaded(spark, path, layout=layout, samples="true", samplesPerTask=per_task)


def scan(spark: SparkSession, path: str, layout: str = "signal", start: int = 0, stop: int | None = None, per_task: int = 16 * CHUNK) -> DataFrame:
    """(file, rate, ch, t0, x array<double>, low, high, bits): samples start .. stop of each file, in chunks."""
    return loaded(spark, path, layout=layout, start=start, samplesPerTask=per_task, **({} if stop is None else {"stop": stop}))


def headers(spark: SparkSession, path: str, layout: str = "signal") -> DataFrame:
    """(file, rate, channels, samples) without reading the bodies."""
    path = shared_path(spark, path)
    if direct(path):
        return reader(spark).option("layout", layout).option("headers", "true").load(path)
    given = {"path": path, "layout": layout, "headers": "true"}
    source = RecordingReader(given, None)
    found = [source.stretches(*file)[0] for file in heads(spark, path, HEAD)]
    return spark.createDataFrame([(part.path, part.head.rate, part.head.channels, part.stop) for part in found], Recordings(given).schema())


def uei(spark: SparkSession, path: str, channels: list[int] | None = None, unit: str = "volts", start: int = 0, stop: int | None = None) -> DataFrame:
    """(file, ch, t, x) of chosen channels in volts, millivolts, microvolts or counts ('daq')."""
    from ..operators.channels import PER_VOLT

    rows = scan(spark, path, "uei", start, stop)
    rows = rows if channels is None else rows.where(F.col("ch").isin(channels))
    volts = F.col("x") * ((F.col("high") - F.col("low")) / F.pow(F.lit(2.0), F.col("bits") + 2)) + (F.col("low") + F.col("high")) / 2
    each = rows.select("file", "ch", "low", "high", "bits", F.posexplode("x").alias("i", "x"), "t0")
    return each.select("file", "ch", (F.col("t0") + F.col("i")).alias("t"), (F.col("x") if unit == "daq" else volts * PER_VOLT[unit]).alias("x"))


def triggers(recording: DataFrame, descriptor: DataFrame) -> DataFrame:
    """The chunks of the channels whose type is `presenter`. recording: chunks (ch); descriptor: (nr, type) of its channels, in order, from 1."""
    which = descriptor.where("type = 'presenter'").select((F.col("nr") - 1).cast("int").alias("ch"))
    return recording.join(F.broadcast(which), "ch", "left_semi")  # a row a channel


def write_files(df: DataFrame, key: str, folder: str, build: Callable[[str, pa.Table], bytes]) -> DataFrame:
    """(name, bytes): one file a group, written by its task under another name and then moved, so that a repeated task does no harm; empty groups have none. A group is a file's worth of rows. Where pyarrow doesn't open the store, Spark writes them at once."""
    folder = shared_path(df.sparkSession, folder).rstrip("/")
    if not direct(folder):
        return put_groups(df, key, folder, build)

    def run(rows: pa.Table) -> pa.Table:
        name = str(rows[key][0].as_py())
        data = build(name, rows)
        system, place = opened(folder)
        system.create_dir(place, recursive=True)
        draft = f"{place}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(data)
        system.move(draft, f"{place}/{name}")
        return pa.table({"name": [name], "bytes": [len(data)]})

    return df.groupBy(key).applyInArrow(run, "name string, bytes long")


def write_signals(samples: DataFrame, folder: str, rate: int, layout: str = "signal", channels: int | None = None, **options) -> DataFrame:
    """Recording files from (file, ch int, t, x), a file at most in a task's memory, all of them or none; (name, bytes) of those in the folder.

    channels: of every file (default: up to the last one that has samples); instants without
    a sample are zero. options: code (npt), low, high and bits (uei).
    """
    spark, folder = samples.sparkSession, shared_path(samples.sparkSession, folder)
    spark.dataSource.register(Recordings)
    rows = samples.select(F.col("file").cast("string").alias("file"), F.col("ch").cast("int").alias("ch"), F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"))
    given = {"layout": layout, "rate": rate, **options} | ({} if channels is None else {"channels": channels})
    if not direct(folder):
        writer = RecordingWriter({"path": folder, **given})
        put_groups(rows, "file", folder, lambda _, group: writer.build(group))
        return spark.createDataFrame(listed(spark, folder), "name string, bytes long")
    rows.repartition("file").sortWithinPartitions("file", "t").write.format("recording").mode("append").options(**given).save(folder)
    return spark.createDataFrame([(path.rsplit("/", 1)[-1], size) for path, size in files_under(folder)], "name string, bytes long")


def write_waveforms(spikes: DataFrame, folder: str, conversion: int = 10_000) -> DataFrame:
    """Waveform files, one a group, from (grp, ts, w array<array<short>>)."""

    def build(name: str, rows: pa.Table) -> bytes:
        order = np.argsort(rows["ts"].to_numpy(), kind="stable")
        return waveform_bytes(np.array(rows["w"].to_pylist())[order], rows["ts"].to_numpy()[order], conversion)

    return write_files(spikes, "grp", folder, build)


def write_syncs(syncs: DataFrame, folder: str) -> DataFrame:
    """Sync files from (name, idx, sync)."""

    def build(name: str, rows: pa.Table) -> bytes:
        body = rows["sync"].to_numpy()[np.argsort(rows["idx"].to_numpy(), kind="stable")]
        return sync_bytes(name, body, float(body.mean()), float(body.std()))

    return write_files(syncs, "name", folder, build)


def write_trains(trains: DataFrame, path: str) -> None:
    """Spike trains (cell, ts_ms, ...) as Parquet, a folder a cell."""
    trains.repartition("cell").sortWithinPartitions("cell", "ts_ms").write.mode("overwrite").partitionBy("cell").parquet(path)


def write_decoded(path: str, states: DataFrame, templates: DataFrame, stats: DataFrame) -> None:
    """The tables of a decoding: states, templates, and log-likelihoods."""
    for name, df in (("states", states), ("templates", templates), ("decode_stats", stats)):
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_decoded(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("states", "templates", "decode_stats")}


def split_samples(samples: DataFrame, size: int) -> DataFrame:
    """Samples (file, ch, t, x) as numbered parts of `size` samples: `file` ends with the part's number, t begins anew."""
    part = F.floor(F.col("t") / size).cast("long")
    number = F.lpad(part.cast("string"), F.greatest(F.length(part.cast("string")), F.lit(4)), "0")  # lpad cuts what is longer
    return samples.select(F.concat_ws(".", "file", number).alias("file"), "ch", (F.col("t") - part * size).alias("t"), "x")


def assemble(parts: DataFrame) -> DataFrame:
    """Parts put together again in the order of their numbers: t goes on where the part before ends."""
    from pyspark.sql import Window

    from ..functions import numeric_suffix

    lengths = parts.groupBy("file").agg((F.max("t") + 1).alias("n"))
    lengths = lengths.select("file", F.regexp_replace("file", "[.][0-9]+$", "").alias("whole"), numeric_suffix(F.col("file")).alias("k"), "n")
    before = Window.partitionBy("whole").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0))
    return parts.join(lengths.select("file", "whole", offset.alias("offset")), "file").select(F.col("whole").alias("file"), "ch", (F.col("t") + F.col("offset")).alias("t"), "x")



