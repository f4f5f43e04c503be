"""Point-process analytics of spike trains (unit, us, spike)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bin_of
from .bandjoin import band_join, near_other
from .ordered import beside


#: Microseconds of a train that a task puts in order: a day.
STRETCH = 86_400_000_000


def intervals(train: DataFrame) -> DataFrame:
    """train with `isi`, the time since the spike before; the first spikes go."""
    near = beside(train, "unit", ["us", "spike"], STRETCH, before={"_us": "us"})
    return near.withColumn("isi", F.col("us") - F.col("_us")).where("isi IS NOT NULL").drop("_us")


def isi_stats(train: DataFrame) -> DataFrame:
    return intervals(train).groupBy("unit").agg(F.count("*").alias("n"), F.min("isi").alias("shortest"), F.max("isi").alias("longest"), F.sum("isi").alias("total"))


def isi_histogram(train: DataFrame, bins: int = 100) -> DataFrame:
    """Equal bins over the range of ln(interval in ms), per unit."""
    ln = intervals(train).where("isi > 0").select("unit", F.round(F.ln(F.col("isi") / 1000), 9).alias("v"))
    ends = ln.groupBy("unit").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ln.join(F.broadcast(ends), "unit").select("unit", bin_of(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).groupBy("unit", "bin").agg(F.count("*").alias("n"))


def spike_counts(train: DataFrame, width: int) -> DataFrame:
    """Spikes in each window of `width` µs from a unit's first to its last, empty ones too."""
    ends = train.groupBy("unit").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    windows = ends.select("unit", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - F.col("first")) / width))).alias("w"))
    counted = train.join(F.broadcast(ends), "unit").groupBy("unit", F.floor((F.col("us") - F.col("first")) / width).alias("w")).agg(F.count("*").alias("n"))
    return windows.join(counted, ["unit", "w"], "left").select("unit", F.col("w").cast("long").alias("w"), F.coalesce("n", F.lit(0)).alias("n"))


def count_distribution(train: DataFrame, width: int) -> DataFrame:
    return spike_counts(train, width).groupBy("unit", F.col("n").alias("spikes")).agg(F.count("*").alias("windows"))


#: Distinct points of a side that a task counts at once, instants of them at a time, and widths of a bucket of time.
SLICE, AT_ONCE, WIDTHS = 1 << 19, 1 << 14, 12


def lag_counts(rows: pa.Table, width: int, bin_us: int, auto: bool) -> pa.Table:
    """(unit1, unit2, bin, n) between the points (left, unit, us, n) of two sides: for each edge of a bin, sums of the points on the right at or before it."""
    units = pc.unique(rows["unit"])
    units = units.take(pc.sort_indices(units))
    unit = pc.index_in(rows["unit"], units).to_numpy()
    left, us, n = (rows[c].to_numpy() for c in ("left", "us", "n"))
    order = np.lexsort((us, unit))
    unit, left, us, n = unit[order], left[order], us[order], n[order]
    sides = []
    for side in (left, ~left):
        cuts = np.searchsorted(unit[side], np.arange(len(units) + 1))
        sides.append((us[side], n[side], cuts))
    (at, many, begin), (right, weight, cut) = sides
    low, high = (1 - width) // bin_us, (width - 1) // bin_us
    bins = np.arange(low, high + 1)
    edges = np.append(np.maximum(bins * bin_us, 1 - width), width)
    found = []
    for b in range(len(units)):
        there = right[cut[b] : cut[b + 1]]
        total = np.append(0, np.cumsum(weight[cut[b] : cut[b + 1]]))
        for a in range(b, b + 1) if auto else range(b):
            sums = np.zeros(len(edges), np.int64)
            for k in range(begin[a], begin[a + 1] if len(there) else 0, AT_ONCE):
                stop = min(k + AT_ONCE, begin[a + 1])
                sums += total[np.searchsorted(there, at[k:stop] - edges[:, None], "right")] @ many[k:stop]
            count = sums[:-1] - sums[1:]
            found += [(a, b, x, y) for x, y in zip(bins.tolist(), count.tolist(), strict=True) if y]
    one, two, bin_, count = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.table({"unit1": units.take(pa.array(one, pa.int64())), "unit2": units.take(pa.array(two, pa.int64())), "bin": pa.array(bin_, pa.int64()), "n": pa.array(count, pa.int64())})


def correlogram(train: DataFrame, width: int, bin_us: int, auto: bool = False) -> DataFrame:
    """Histogram of lags below `width` between pairs of units (auto: of a unit with itself, without the spike itself).

    No pairs are made: equal times of a unit are one point with a count, and a bucket of
    time is one search for the edges of the bins. Buckets of more than SLICE points are cut
    into slices, each held against each. auto takes pairs of a spike's own rows off again,
    which are made only for numbers that come at several times.
    """
    rows = train.where("unit IS NOT NULL AND us IS NOT NULL" + (" AND spike IS NOT NULL" if auto else ""))
    points = rows.groupBy("unit", F.col("us").cast("long").alias("us")).agg(F.count("*").alias("n"))
    span = WIDTHS * width
    bucket = lambda at: F.floor(at / span)
    left = points.select(F.lit(True).alias("left"), "unit", "us", "n", bucket(F.col("us")).alias("bucket"))
    right = points.select(F.lit(False).alias("left"), "unit", "us", "n", F.explode(F.sequence(bucket(F.col("us") - width), bucket(F.col("us") + width))).alias("bucket"))
    both = left.union(right)
    size = lambda side: F.ceil(F.count(F.when(side, 1)) / SLICE)
    slices = both.groupBy("bucket").agg(size(F.col("left")).alias("_i"), size(~F.col("left")).alias("_j")).where("_i > 0")
    own = F.pmod(F.xxhash64("unit", "us"), F.when(F.col("left"), F.col("_i")).otherwise(F.col("_j")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("left"), F.col("_j")).otherwise(F.col("_i")) - 1))
    dealt = both.join(slices, "bucket").select("*", own.alias("_own"), others.alias("_other"))
    i, j = F.when(F.col("left"), F.col("_own")).otherwise(F.col("_other")), F.when(F.col("left"), F.col("_other")).otherwise(F.col("_own"))
    kind = train.schema["unit"].dataType.simpleString()
    blocks = dealt.select("bucket", i.alias("i"), j.alias("j"), "left", "unit", "us", "n").groupBy("bucket", "i", "j")
    counts = blocks.applyInArrow(lambda block: lag_counts(block, width, bin_us, auto), f"unit1 {kind}, unit2 {kind}, bin long, n long")
    if auto:
        minus = lambda df, bin_, n: df.select(F.col("unit").alias("unit1"), F.col("unit").alias("unit2"), bin_.cast("long").alias("bin"), (-n).cast("long").alias("n"))
        ids = rows.groupBy("unit", "spike").agg(F.count("*").alias("_n"), F.min("us").alias("_low"), F.max("us").alias("_high"))
        counts = counts.union(minus(ids.where("_low = _high"), F.lit(0), F.col("_n") * F.col("_n")))
        several = rows.join(ids.where("_low < _high").select("unit", "spike"), ["unit", "spike"], "left_semi").select("unit", "us", "spike")
        same = (F.col("l_unit") == F.col("r_unit")) & (F.col("l_spike") == F.col("r_spike"))
        own = band_join(several, several, "us", width, same).select(F.col("l_unit").alias("unit"), F.floor((F.col("l_us") - F.col("r_us")) / bin_us).alias("bin"))
        counts = counts.union(minus(own, F.col("bin"), F.lit(1)))
    return counts.groupBy("unit1", "unit2", "bin").agg(F.sum("n").alias("n")).where("n > 0")


def isolated(train: DataFrame, width: int) -> DataFrame:
    """Spikes without one of another unit closer than width."""
    return near_other(train, "us", width, "unit").where("NOT near").drop("near")


def overlapping(train: DataFrame, width: int) -> DataFrame:
    """The other spikes."""
    return near_other(train, "us", width, "unit").where("near").drop("near")


def merge_units(train: DataFrame, merged: dict[str, str]) -> DataFrame:
    """Times of merged units, each instant once."""
    name = F.coalesce(F.create_map(*[F.lit(x) for p in merged.items() for x in p])[F.col("unit")], F.col("unit"))
    return train.select(name.alias("unit"), "us").distinct()


def missing_numbers(files: DataFrame) -> DataFrame:
    """Numbers absent between present ones of files (series, number)."""
    w = Window.partitionBy("series").orderBy("number")
    gap = files.withColumn("next", F.lead("number").over(w)).where("next - number > 1")
    return gap.select("series", F.explode(F.expr("sequence(number + 1, next - 1)")).alias("number"))


def file_offsets(files: DataFrame) -> DataFrame:
    """First sample of each file (series, number, n): the lengths before it; a missing file counts as long as the one before the gap."""
    w = Window.partitionBy("series").orderBy("number")
    span = F.col("n") * F.coalesce(F.lead("number").over(w) - F.col("number"), F.lit(1))
    spans = files.withColumn("span", span)
    return spans.select("series", "number", "n", F.coalesce(F.sum("span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
