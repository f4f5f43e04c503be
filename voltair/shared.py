"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; where it is unset, one of our own in local mode (tests), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file:///tmp/checkpoints"
    return (found if ":" in found else located(spark, found)).rstrip("/")


def located(spark: SparkSession, path: str) -> str:
    """`path` with the file system that holds it, for readers besides Spark: a path without a scheme is of Hadoop's default one, and mounts (viewfs) are followed. What doesn't exist yet lies where its nearest parent does."""
    if path.startswith("file:"):
        return path
    place, below = spark._jvm.org.apache.hadoop.fs.Path(path), []
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    place = system.makeQualified(place)
    while place.getParent() is not None and not system.exists(place):
        below.append(place.getName())
        place = place.getParent()
    return "/".join([system.resolvePath(place).toString().rstrip("/"), *reversed(below)])


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it back: cuts lineage and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
