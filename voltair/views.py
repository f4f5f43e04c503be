"""Signals, spike trains, waveforms and descriptors as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import micros

#: Microseconds.
DAY = 86_400_000_000
#: The same views for DuckDB.
SQL = {
    "sig": "sig AS (SELECT event_type AS ch, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, -value AS x FROM events)",
    "train": "train AS (SELECT event_type AS unit, epoch_us(ts) AS us, event_id AS spike FROM events)",
    "wave": "wave AS (SELECT vec_id AS spike, label AS unit, i - 1 AS pos, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) r(i))",
    "chan": "chan AS (SELECT n_nationkey AS ch_nr, n_regionkey AS gr_nr, n_nationkey % 7 <> 3 AS active FROM nation)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch, t, x): one channel an event type, numbered by days, so that no task holds a channel."""
    from .operators.ordered import numbered

    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("ch"), "ts", "event_id", (-F.col("value")).alias("x"))
    return numbered(events, "ch", micros(F.col("ts")), ["event_id"], DAY).select("ch", "t", "x")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, us, spike)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("unit"), micros(F.col("ts")).alias("us"), F.col("event_id").alias("spike"))


def wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spike, unit, pos, v)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spike"), F.col("label").alias("unit"), F.posexplode("embedding").alias("pos", "v")).select("spike", "unit", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, v array<double>): a row for each spike of wave."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("unit"), F.col("embedding").cast("array<double>").alias("v"))


def chan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch_nr, gr_nr, active)."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ch_nr"), F.col("n_regionkey").alias("gr_nr"), (F.col("n_nationkey") % 7 != 3).alias("active"))
