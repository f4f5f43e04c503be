"""Choosing, numbering and scaling channels and stretches of signals (ch, t, x), and units of spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channel_list(text: str) -> list[int]:
    """'0-3,7' as numbers, both ends of a range included."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        out += range(int(low), int(high or low) + 1)
    return out


def groups_of(channels: DataFrame, chosen: str) -> DataFrame:
    """(gr_nr): the groups of the channels (ch_nr, gr_nr) that a list such as '0-3,7' names."""
    return channels.where(F.col("ch_nr").isin(channel_list(chosen))).select("gr_nr").distinct()


def reorder(sig: DataFrame, order: DataFrame) -> DataFrame:
    """Channels renamed by order (src, dst); those without a new place go. order: one row a channel."""
    return sig.join(F.broadcast(order.select(F.col("src").alias("ch"), "dst")), "ch").select(F.col("dst").alias("ch"), "t", "x")


def limited(sig: DataFrame, offset: int, size: int) -> DataFrame:
    return sig.where(F.col("t").between(offset, offset + size - 1))


def file_chunk(sig: DataFrame, index: int, chunks: int) -> DataFrame:
    """The index-th of `chunks` equal stretches of each channel; the last may be shorter."""
    size = sig.groupBy("ch").agg(F.ceil((F.max("t") + 1) / chunks).alias("size"))
    return sig.join(F.broadcast(size), "ch").where(F.floor(F.col("t") / F.col("size")) == index).select("ch", "t", "x")


def clipped(sig: DataFrame, k: float) -> DataFrame:
    """Samples below k standard deviations of their channel."""
    sd = sig.groupBy("ch").agg(F.stddev_pop("x").alias("sd"))
    return sig.join(F.broadcast(sd), "ch").where(F.abs("x") < k * F.col("sd")).select("ch", "t", "x")


#: What a volt is in each unit.
PER_VOLT = {"volts": 1.0, "millivolts": 1e3, "microvolts": 1e6}


def scaled(x: Column, low: float, high: float, bits: int, unit: str = "volts") -> Column:
    """Counts of a converter for the range low to high as volts, millivolts or microvolts; 'daq': the counts."""
    if unit == "daq":
        return x
    return (x * ((high - low) / 2 ** (bits + 2)) + (low + high) / 2) * PER_VOLT[unit]


def decimated(sig: DataFrame, factor: int) -> DataFrame:
    """Means of `factor` consecutive samples, numbered anew; the rest at the end counts as one."""
    return sig.groupBy("ch", F.floor(F.col("t") / factor).alias("t")).agg(F.avg("x").alias("x"))


def memberships(spikes: DataFrame) -> DataFrame:
    """(units, instants): how many instants are claimed by so many units of spikes (unit, t)."""
    each = spikes.groupBy("t").agg(F.countDistinct("unit").alias("units"))
    return each.groupBy("units").agg(F.count("*").alias("instants"))


def cut_column(spikes: DataFrame) -> DataFrame:
    """(t, cut) in order of time: the unit of each instant, -1 where several claim it."""
    each = spikes.groupBy("t").agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    return each.select("t", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1).alias("cut"))


def overlap_index(spikes: DataFrame, width: int) -> DataFrame:
    """(unit, spike): which units fire at each of the merged instants, numbered in order of time. Instants are counted by stretches of `width`, so no task holds them all."""
    from .ordered import numbered

    instants = numbered(spikes.select("t", F.lit(0).alias("_all")).distinct(), "_all", F.col("t"), [], width, "spike").select("t", "spike")
    return spikes.select("unit", "t").distinct().join(instants, "t").select("unit", "spike")


def spike_index(spikes: DataFrame) -> DataFrame:
    """Spikes (unit, t) with their ordinal within the unit; positions need no rebasing when files are added."""
    return spikes.withColumn("ordinal", F.row_number().over(Window.partitionBy("unit").orderBy("t")).cast("long") - 1)


def file_number(name: Column) -> Column:
    """The number at the end of a file's name, by which numbered files are ordered; none: null."""
    digits = F.regexp_extract(name, r"(\d+)\D*$", 1)
    return F.when(digits != "", digits.cast("long"))
