"""Files in stores: by pyarrow where it opens them, else by Spark's own readers and writers, so that any store that Spark reaches will do."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import located


def opened(path: str):
    """(file system, path on it). Local paths are taken as Spark takes them, without escapes."""
    from pyarrow import fs

    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:(//[^/]*)?", "", path)
    return fs.FileSystem.from_uri(path)


def direct(path: str) -> bool:
    """Whether pyarrow opens the store of `path`."""
    try:
        opened(path)
    except (OSError, ValueError, NotImplementedError, ImportError):  # no library, an unknown scheme, a part that wasn't built
        return False
    return True


def files_under(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file or of all files in a folder, in order."""
    from pyarrow import fs

    system, place = opened(path)
    info = system.get_file_info(place)
    found = system.get_file_info(fs.FileSelector(place)) if info.type == fs.FileType.Directory else [info]
    lead = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted((lead + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def shared_path(spark: SparkSession, path: str) -> str:
    """`path`, which must name its file system where executors don't share a local one; mounts that only Spark knows (viewfs) are followed to the store behind them."""
    if ":" not in path and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{path} has no scheme: executors would each write to their own disk")
    return located(spark, path) if path.startswith("viewfs:") else path


def seen(spark: SparkSession, path: str):
    """(Hadoop's file system, what it says of a file or of all files in a folder)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [x for x in system.listStatus(place) if x.isFile() and not x.getPath().getName().startswith((".", "_"))]


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a file or of all files in a folder, in order."""
    return sorted((x.getPath().getName(), x.getLen()) for x in seen(spark, path)[1])


def heads(spark: SparkSession, path: str, size: int) -> list[tuple[str, int, bytes]]:
    """(file, bytes, its first `size` bytes) of a file or of all files in a folder, read by 16 threads of the driver."""
    system, found = seen(spark, path)

    def head(status) -> tuple[str, int, bytes]:
        stream = system.open(status.getPath())
        try:
            return status.getPath().toString(), status.getLen(), bytes(stream.readNBytes(size))
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return sorted(pool.map(head, found))


def put_files(files: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write (name, content binary, never empty) as files of these very bytes, by Spark's writer of text; (name, bytes) of them.

    That writer ends each row with a mark, so the mark is the last byte of the content, and
    there is a job for each last byte (few: numbers end with their sign and magnitude).
    Drafts become files when all jobs are done and vanish otherwise. The driver moves names only.
    """
    spark, folder = files.sparkSession, folder.rstrip("/")
    drafts = f"{folder}/_drafts-{uuid.uuid4().hex}"
    Path = spark._jvm.org.apache.hadoop.fs.Path
    system, done = Path(drafts).getFileSystem(spark._jsc.hadoopConfiguration()), []
    try:
        files.select("name", F.expr("substring(content, 1, length(content) - 1)").alias("body"), F.hex(F.expr("substring(content, -1, 1)")).alias("mark")).write.parquet(f"{drafts}/held")
        held = spark.read.schema("name string, body binary, mark string").parquet(f"{drafts}/held")
        marks = [r.mark for r in held.select("mark").distinct().collect()]
        for mark in marks:
            rows = held.where(F.col("mark") == mark).select("name", F.col("body").cast("string").alias("body"))
            rows.write.partitionBy("name").options(lineSep=chr(int(mark, 16)), encoding="ISO-8859-1", compression="none").text(f"{drafts}/{mark}")
        for mark in marks:
            for at in system.listStatus(Path(f"{drafts}/{mark}")):
                if at.isDirectory():
                    name = unquote(at.getPath().getName().removeprefix("name="))
                    (part,) = (f for f in system.listStatus(at.getPath()) if f.getPath().getName().startswith("part-"))
                    target = Path(f"{folder}/{name}")
                    if system.exists(target):
                        system.delete(target, False)
                    if not system.rename(part.getPath(), target):
                        raise OSError(f"{folder}/{name} can't be written")
                    done.append((name, part.getLen()))
    finally:
        system.delete(Path(drafts), True)  # of this job alone
    return sorted(done)


def put_groups(df: DataFrame, key: str, folder: str, build: Callable[[str, pa.Table], bytes]) -> DataFrame:
    """(name, bytes): a file a group, built by one task, through put_files."""

    def run(rows: pa.Table) -> pa.Table:
        name = str(rows[key][0].as_py())
        return pa.table({"name": [name], "content": pa.array([build(name, rows)], pa.binary())})

    done = put_files(df.groupBy(key).applyInArrow(run, "name string, content binary"), folder)
    return df.sparkSession.createDataFrame(done, "name string, bytes long")
