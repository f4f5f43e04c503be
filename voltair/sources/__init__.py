"""Binary recordings as DataFrames. Files are read by Spark (`binaryFile`), so any store Spark reads will do.

All numbers are little-endian. Layouts are fixed values of the file formats.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Samples per row of a signal.
CHUNK = 1 << 16
#: Header sizes: signals written here, waveforms, syncs.
SIGNAL_HEADER, WAVE_HEADER, SYNC_HEADER = 90, 100, 300


def signal_header(raw: bytes) -> tuple[int, int, int]:
    """(header size, rate, channels); a rate above 1e5 means that channels stand before the rate."""
    size, rate = struct.unpack_from("<II", raw)
    wide = size in (74, SIGNAL_HEADER)
    channels = struct.unpack_from("<H" if wide else "<B", raw, 8)[0]
    if rate > 100_000:
        channels = struct.unpack_from("<H" if wide else "<B", raw, 4)[0]
        rate = struct.unpack_from("<I", raw, 6 if wide else 5)[0]
    return size, rate, channels


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """(file, rate, ch, t0, x array<short>): chunks of each channel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                size, rate, channels = signal_header(raw)
                x = np.frombuffer(raw, "<i2", offset=size)
                x = x[: len(x) // channels * channels].reshape(-1, channels)
                for t in range(0, len(x), CHUNK):
                    yield pd.DataFrame({"file": name, "rate": rate, "ch": np.arange(channels), "t0": t, "x": [x[t : t + CHUNK, c] for c in range(channels)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, rate long, ch int, t0 long, x array<short>")


def samples(chunks: DataFrame) -> DataFrame:
    """(file, ch, t, x) from chunks."""
    return chunks.select("file", "ch", "t0", F.posexplode("x").alias("i", "x")).select("file", "ch", (F.col("t0") + F.col("i")).alias("t"), "x")


def signal_bytes(x: np.ndarray, rate: int) -> bytes:
    """A signal file from samples (time, channel)."""
    head = struct.pack("<IIH", SIGNAL_HEADER, rate, x.shape[1])
    return head.ljust(SIGNAL_HEADER, b"\0") + x.astype("<i2").tobytes()


def read_waveforms(spark: SparkSession, path: str, time_factor: float = 0.001) -> DataFrame:
    """(file, spike, ts_ms, w array<array<short>>)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                size, spikes, channels, _, points = struct.unpack_from("<iIBII", raw)
                w = np.frombuffer(raw, "<i2", spikes * channels * points, size).reshape(spikes, channels, points)
                ts = np.frombuffer(raw, "<u8", spikes, size + w.nbytes)
                yield pd.DataFrame({"file": name, "spike": np.arange(spikes), "ts_ms": ts * time_factor, "w": [list(v) for v in w]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, spike long, ts_ms double, w array<array<short>>")


def waveform_bytes(w: np.ndarray, ts: np.ndarray, conversion: int = 10_000) -> bytes:
    """A waveform file from (spikes, channels, points); stamps become microseconds by 1e6 / conversion."""
    head = struct.pack("<iIBII", WAVE_HEADER, *w.shape[:2], conversion, w.shape[2]).ljust(WAVE_HEADER, b"\0")
    return head + w.astype("<i2").tobytes() + (ts * (1e6 / conversion)).astype("<u8").tobytes()


def read_syncs(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, sync)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                size, records = struct.unpack_from("<i260xi", raw)
                body = np.frombuffer(raw, "<i4", records, size)
                yield pd.DataFrame({"file": name, "idx": np.arange(len(body)), "sync": body})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, idx long, sync int")


def sync_bytes(name: str, syncs: np.ndarray, mean: float, sd: float) -> bytes:
    head = struct.pack("<i260sidd", SYNC_HEADER, name.encode(), len(syncs), mean, sd).ljust(SYNC_HEADER, b"\0")
    return head + syncs.astype("<i4").tobytes()


def read_descriptor(spark: SparkSession, path: str) -> DataFrame:
    """(file, ch_nr, gr_nr, type, active, missing): channel rows; later channels move down past missing ones, which have no number."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.rtrim("value"), "\n")).alias("row", "line"))
    part = F.split(F.trim("line"), "\\s+")
    rows = lines.where("row >= 6 AND trim(line) <> ''").select("file", "row", F.get(part, 0).cast("int").alias("nr"), F.get(part, 1).alias("type"), F.get(part, 2).cast("int").alias("gr_nr"), F.element_at(part, -1).alias("status"))
    missing = F.col("status") == "missing"
    before = F.sum(missing.cast("int")).over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("file", F.when(~missing, F.col("nr") - before).alias("ch_nr"), "gr_nr", "type", (F.col("status") == "Active").alias("active"), missing.alias("missing"), "nr")
