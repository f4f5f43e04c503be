"""Operators over whole sessions: extraction drivers, unit tables, and comparisons between sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import signals, trains, waves
from .bandjoin import near_other
from .ordered import beside, numbered


def extract(sig: DataFrame, k: float = 6.0, before: int = 10, after: int = 21, gap: int | None = None) -> DataFrame:
    """(ch, t, threshold, mean, shape): spikes of each channel with their samples, without instants of positive artifacts.

    gap: greedy suppression across channels within this many samples; None: none, as for a single channel.
    """
    limits = signals.robust_threshold(sig, k)
    found = signals.spikes(sig, k)
    if gap is not None:
        found = signals.refractory(found.withColumn("grp", F.lit(0)), "grp", gap).select("ch", "t", "x")
    bad = signals.positive_artifacts(sig, limits.select("ch", "threshold"))
    shapes = signals.snippets(sig, found.join(bad, "t", "left_anti"), before, after)
    shape = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("shape")
    return shapes.groupBy("ch", "t").agg(shape).join(F.broadcast(limits), "ch").select("ch", "t", "threshold", "mean", "shape")


def session_spikes(sig: DataFrame, k: float = 4.0, before: int = 10, after: int = 32) -> DataFrame:
    """(file, ch, t, x) of a session of files (file, ch, t, x), t counted in each file: troughs below the pooled threshold, their times moved by the length of the files before."""
    limits = signals.session_threshold(sig, k)
    lengths = sig.groupBy("file").agg((F.max("t") + 1).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
    files = lengths.select("file", "n", offset.alias("offset"))
    keyed = sig.withColumn("ch", F.struct("file", "ch"))  # a trough never spans two files
    found = signals.troughs(keyed).select(F.col("ch.file").alias("file"), F.col("ch.ch").alias("ch"), "t", "x")
    near = found.join(F.broadcast(limits), "ch").where(F.col("x") < -F.col("threshold"))
    return near.join(F.broadcast(files), "file").where((F.col("t") >= before) & (F.col("t") < F.col("n") - after)).select("file", "ch", (F.col("t") + F.col("offset")).alias("t"), "x")


def processed(train: DataFrame, unique: int, apart: int) -> DataFrame:
    """train with `is_unique` and `is_alone`: no spike of another unit closer than `unique`, than `apart`."""
    out = near_other(near_other(train, "us", unique, "unit", "near1"), "us", apart, "unit", "near2")
    return out.select(*train.columns, (~F.col("near1")).alias("is_unique"), (~F.col("near2")).alias("is_alone"))


def band_subsets(wave: DataFrame, flagged: DataFrame) -> DataFrame:
    """(unit, pos, mean and sd of all, of lone and of overlapping spikes) from flagged (spike, near), in one pass."""
    subsets = {"all": F.lit(True), "alone": ~F.col("near"), "overlap": F.col("near")}
    columns = [f(F.when(c, F.col("v"))).alias(f"{name}_{s}") for s, c in subsets.items() for name, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return wave.join(flagged, "spike").groupBy("unit", "pos").agg(*columns)


def correlogram_density(train: DataFrame, width: int, bin_us: int) -> DataFrame:
    """Cross-correlogram as a density: counts over all lags of the pair and the bin's width."""
    counts = trains.correlogram(train, width, bin_us)
    total = F.sum("n").over(Window.partitionBy("unit1", "unit2"))  # at most 2 * width / bin_us rows a pair
    return counts.select("unit1", "unit2", "bin", (F.col("n") / total / bin_us).alias("density"))


def by_session(train: DataFrame, f, *args) -> DataFrame:
    """A function of trains, for each (unit, session) by itself."""
    keyed = train.withColumn("unit", F.struct("unit", "session"))
    out = f(keyed, *args)
    return out.select("unit.unit", "unit.session", *[c for c in out.columns if c != "unit"])


def sorted_by_session(earlier: DataFrame, current: DataFrame) -> DataFrame:
    """(spike, unit, distance): each current waveform's nearest template of an earlier session, weighted by the current variance of each position."""
    templates = waves.template_band(earlier).select(F.col("unit").alias("template"), "pos", "mean")
    spread = current.groupBy("pos").agg(F.var_pop("v").alias("var"))
    model = templates.join(F.broadcast(spread), "pos").where("var > 0")  # units * positions rows
    d = current.join(model, "pos").groupBy("spike", "template").agg(F.round(F.sum(F.pow(F.col("v") - F.col("mean"), 2) / F.col("var")), 6).alias("distance"))
    return d.groupBy("spike").agg(F.min(F.struct("distance", "template")).alias("b")).select("spike", F.col("b.template").alias("unit"), "b.distance")


def spikes_per_template(wave: DataFrame, samples: int) -> DataFrame:
    """(unit, p, spikes): rate per sample, and rate times samples."""
    counts = wave.groupBy("unit").agg(F.count_distinct("spike").alias("n"))
    p = F.col("n") / F.lit(samples)
    return counts.select("unit", p.alias("p"), (p * samples).alias("spikes"))


def mahalanobis_amplitude(wave: DataFrame) -> DataFrame:
    """(unit, amplitude): the largest squared sample of each template over the variance of all samples."""
    noise = wave.agg(F.var_pop("v").alias("var"))  # one row
    return waves.template_band(wave).crossJoin(F.broadcast(noise)).groupBy("unit").agg(F.max(F.col("mean") * F.col("mean") / F.col("var")).alias("amplitude"))


def rolled_to_trough(wave: DataFrame, at: int = 10) -> DataFrame:
    """(unit, pos, mean): templates moved in a circle until their minimum stands at `at`."""
    t = waves.template_band(wave).select("unit", "pos", "mean")
    low = t.groupBy("unit").agg(F.min_by("pos", F.struct(F.round("mean", 9), "pos")).alias("low"), F.count("*").alias("n"))
    return t.join(F.broadcast(low), "unit").select("unit", F.pmod(F.col("pos") - F.col("low") + at, F.col("n")).alias("pos"), "mean")


def capped(templates: DataFrame, most: int = 30) -> DataFrame:
    """Templates of the first `most` units only."""
    first = templates.select("unit").distinct().orderBy("unit").limit(most)  # the cap is the feature
    return templates.join(F.broadcast(first), "unit", "left_semi")


def upsampled(sig: DataFrame, factor: int) -> DataFrame:
    """(ch, t, x) at `factor` times the rate: straight lines between samples; t in new samples, the last sample ends it."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("j")
    lines = beside(sig, "ch", ["t"], signals.STRETCH, after={"after": "x"}).select("ch", "t", "x", "after", steps).where("after IS NOT NULL OR j = 0")
    return lines.select("ch", (F.col("t") * factor + F.col("j")).alias("t"), (F.col("x") + F.coalesce(F.col("after") - F.col("x"), F.lit(0.0)) * F.col("j") / factor).alias("x"))


def spiketrains(train: DataFrame, shapes: DataFrame, merged: dict[str, str], left_out: list[str] = (), micros: int = 1000) -> DataFrame:
    """(cell, ts_ms array<double>, spike_form array<array<double>>): the trains of chosen units, a row a cell.

    train: (unit, us); shapes: (unit, ch, pos, v), samples of waveforms. Units that `merged`
    names become one cell, with their distinct times and the mean of all their waveforms;
    those `left_out` go, the others are cells of their own.
    """
    names = F.create_map(*[F.lit(x) for pair in merged.items() for x in pair]) if merged else None
    cell = F.coalesce(names[F.col("unit")], "unit") if merged else F.col("unit")
    chosen = lambda df: df.where(~F.col("unit").isin(list(left_out))).withColumn("cell", cell)
    times = chosen(train).groupBy("cell").agg(F.transform(F.array_sort(F.collect_set("us")), lambda t: t / micros).alias("ts_ms"))  # a file's worth
    means = chosen(shapes).groupBy("cell", "ch", "pos").agg(F.avg("v").alias("v"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"])
    by_channel = means.groupBy("cell", "ch").agg(row.alias("row"))
    form = F.transform(F.array_sort(F.collect_list(F.struct("ch", "row"))), lambda c: c["row"])
    return times.join(by_channel.groupBy("cell").agg(form.alias("spike_form")), "cell")
