"""Templates, noise and quality of waveforms (spike, unit, pos, v)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dot


def template_band(wave: DataFrame) -> DataFrame:
    return wave.groupBy("unit", "pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n"))


def template_energy(wave: DataFrame) -> DataFrame:
    """Energy and largest squared amplitude of each unit's mean waveform."""
    return template_band(wave).groupBy("unit").agg(F.sum(F.col("mean") * F.col("mean")).alias("energy"), F.max(F.col("mean") * F.col("mean")).alias("largest"))


def remove_sparse(wave: DataFrame, share: float) -> DataFrame:
    """Units with more than `share` of the spikes."""
    n = wave.groupBy("unit").agg(F.countDistinct("spike").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).where(F.col("n") > share * F.col("total")).select("unit", "n")


def remove_noise(wave: DataFrame, sig: DataFrame, patch: int, factor: float) -> DataFrame:
    """Units whose template energy is at least `factor` times the median energy of consecutive patches of the signal."""
    patches = sig.groupBy("ch", F.floor(F.col("t") / patch).alias("p")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("n")).where(F.col("n") == patch)
    limit = patches.agg(F.median("e").alias("median"))  # one row
    return template_energy(wave).crossJoin(F.broadcast(limit)).where(F.col("energy") >= factor * F.col("median")).select("unit", "energy")


def noise_covariance(wave: DataFrame, positions: int) -> DataFrame:
    """Sample covariance between the first positions, over spikes; pairs meet by an equi-join on the spike."""
    few = wave.where(F.col("pos") < positions)
    a, b = (few.select("spike", F.col("pos").alias(p), F.col("v").alias(v)) for p, v in (("i", "x"), ("j", "y")))
    return a.join(b, "spike").where("i <= j").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def position_pairs(shapes: DataFrame) -> DataFrame:
    """(unit, i, j, x, y), i <= j, of all positions of each waveform (unit, v array<double>); no join."""
    first = shapes.select("unit", "v", F.posexplode("v").alias("i", "x"))
    pairs = first.select("unit", "i", "x", F.posexplode(F.expr("slice(v, i + 1, size(v))")).alias("k", "y"))
    return pairs.select("unit", F.col("i").cast("long").alias("i"), (F.col("i") + F.col("k")).cast("long").alias("j"), "x", "y")


def merge_statistic(wave: DataFrame, max_p: float = 12.0) -> DataFrame:
    """Squared difference of two templates over the variance of their means (noise: identity)."""
    t = template_band(wave).select("unit", "pos", "mean", "n")
    a, b = (t.select("pos", F.col("unit").alias(f"unit{k}"), F.col("mean").alias(f"m{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    d = a.join(b, "pos").where("unit1 < unit2").groupBy("unit1", "unit2").agg(F.sum(F.pow(F.col("m1") - F.col("m2"), 2)).alias("d"), F.min("n1").alias("n1"), F.min("n2").alias("n2"))
    return d.select("unit1", "unit2", (F.col("d") / (1 / F.least("n1", F.lit(max_p)) + 1 / F.least("n2", F.lit(max_p)))).alias("stat"))


def isolation_distance(wave: DataFrame) -> DataFrame:
    """Per unit of n spikes: distance of the n-th nearest spike of other units over that of the farthest member, from the unit's mean."""
    mean = template_band(wave).select("unit", "pos", "mean", "n")
    d = wave.select("spike", F.col("unit").alias("own"), "pos", "v").join(mean, "pos").groupBy("spike", "own", "unit", "n").agg(F.sum(F.pow(F.col("v") - F.col("mean"), 2)).alias("d"))
    far = d.where("own = unit").groupBy("unit").agg(F.max("d").alias("farthest"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("d", "spike"))
    other = d.where("own <> unit").withColumn("r", rank).where("r = n").select("unit", "d")
    return far.join(other, "unit").select("unit", (F.col("d") / F.col("farthest")).alias("ratio"))


def best_projection(wave: DataFrame, positions: int = 6) -> DataFrame:
    """The three positions along which the unit means are farthest apart, per pair of units."""
    t = template_band(wave).where(F.col("pos") < positions).select("unit", "pos", "mean")
    a, b = (t.select("pos", F.col("unit").alias(f"unit{k}"), F.col("mean").alias(f"m{k}")) for k in (1, 2))
    d = a.join(b, "pos").where("unit1 < unit2").select("unit1", "unit2", "pos", F.round(F.pow(F.col("m1") - F.col("m2"), 2), 9).alias("d"))
    p, q, r = (d.select("unit1", "unit2", F.col("pos").alias(f"p{k}"), F.col("d").alias(f"d{k}")) for k in (1, 2, 3))
    triples = p.join(q, ["unit1", "unit2"]).where("p1 < p2").join(r, ["unit1", "unit2"]).where("p2 < p3")
    best = F.max_by(F.struct("p1", "p2", "p3"), F.struct(F.round(F.expr("d1 + d2 + d3"), 9), -F.col("p1"), -F.col("p2"), -F.col("p3")))
    return triples.groupBy("unit1", "unit2").agg(best.alias("b")).select("unit1", "unit2", "b.p1", "b.p2", "b.p3")


def best_projection_all(wave: DataFrame) -> DataFrame:
    """As best_projection, over all positions: since the differences add up, the three largest make the best triple."""
    t = template_band(wave).select("unit", "pos", "mean")
    a, b = (t.select("pos", F.col("unit").alias(f"unit{k}"), F.col("mean").alias(f"m{k}")) for k in (1, 2))
    d = a.join(b, "pos").where("unit1 < unit2").select("unit1", "unit2", "pos", F.round(F.pow(F.col("m1") - F.col("m2"), 2), 9).alias("d"))
    rank = F.row_number().over(Window.partitionBy("unit1", "unit2").orderBy(F.desc("d"), "pos"))
    three = d.withColumn("r", rank).where("r <= 3").groupBy("unit1", "unit2").agg(F.array_sort(F.collect_list("pos")).alias("p")).where("size(p) = 3")
    return three.select("unit1", "unit2", *[F.col("p")[k].alias(f"p{k + 1}") for k in range(3)])


def resolve_overlaps(wave: DataFrame, unresolved: int = 0, shift: int = 3) -> DataFrame:
    """Per spike of the unresolved unit: the pair of templates, one shifted by at most `shift`, with the least squared error."""
    t = template_band(wave).where(F.col("unit") != unresolved).select("unit", "pos", "mean")
    a = t.select(F.col("unit").alias("unit1"), "pos", F.col("mean").alias("m1"))
    b = t.select(F.col("unit").alias("unit2"), F.col("mean").alias("m2"), F.explode(F.sequence(F.lit(-shift), F.lit(shift))).alias("s"), "pos").withColumn("pos", F.col("pos") + F.col("s"))
    pairs = a.join(b, "pos", "left").where("unit1 < unit2")
    model = pairs.select("unit1", "unit2", "s", "pos", (F.col("m1") + F.col("m2")).alias("m"))
    x = wave.where(F.col("unit") == unresolved).select("spike", "pos", "v")
    # |x - m|^2 summed where both stand; a spike meets units^2 * shifts candidates
    error = x.join(model, "pos").groupBy("spike", "unit1", "unit2", "s").agg(F.round(F.avg(F.pow(F.col("v") - F.col("m"), 2)), 9).alias("sse"))
    best = F.min(F.struct("sse", "unit1", "unit2", "s")).alias("b")
    return error.groupBy("spike").agg(best).select("spike", "b.unit1", "b.unit2", F.col("b.s").cast("long").alias("shift"), "b.sse")


def accepted_overlaps(wave: DataFrame, threshold: float = 0.05, unresolved: int = 0, shift: int = 3, salts: int = 8) -> DataFrame:
    """(spike, unit1, unit2, shift1, shift2, score): spikes of the unresolved unit that are the sum of two templates, each moved by at most `shift`.

    score: squared error over the energy of the sum, below `threshold`; the least one of a
    spike stays. An error is at least the squared difference of the norms, so a spike can only
    be accepted by sums whose norm lies within a factor of its own: sums and spikes meet by
    ranges of the norm, and spikes of one range are dealt over `salts` tasks.
    """
    shape = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"])
    means = template_band(wave).where(F.col("unit") != unresolved).select("unit", "pos", F.col("mean").alias("v"))
    means = means.groupBy("unit").agg(shape.alias("m"))
    moves = means.select("unit", "m", F.explode(F.sequence(F.lit(-shift), F.lit(shift))).alias("s"))
    zeros = F.array_repeat(F.lit(0.0), shift)
    moved = moves.select("unit", F.col("s").cast("long").alias("s"), F.slice(F.concat(zeros, "m", zeros), shift + 1 - F.col("s"), F.size("m")).alias("m"))
    one, two = (moved.select(F.col("unit").alias(f"unit{k}"), F.col("s").alias(f"shift{k}"), F.col("m").alias(f"m{k}"), F.lit(0).alias("all")) for k in (1, 2))
    sums = one.join(two, "all").where("unit1 < unit2").select("unit1", "unit2", "shift1", "shift2", F.zip_with("m1", "m2", lambda a, b: a + b).alias("m"))  # units^2 * shifts^2 / 2 rows
    width, root = 0.25, math.sqrt(threshold)
    power = lambda c: dot(F.col(c), F.col(c))
    range_of = lambda x: F.floor(F.ln(x) / (2 * width))  # noqa: E731  of the squared norm
    sums = sums.withColumn("energy", power("m")).where("energy > 0").select("*", range_of(F.col("energy")).alias("range"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    spikes = wave.where(F.col("unit") == unresolved).groupBy("spike").agg(shape.alias("v")).withColumn("own", power("v")).where("own > 0")
    slack = 1e-9
    low, high = range_of(F.col("own") / (1 + root + slack) ** 2), range_of(F.col("own") / max(1 - root - slack, 1e-9) ** 2)
    near = spikes.select("*", F.explode(F.sequence(low, high)).alias("range"), (F.abs(F.xxhash64("spike")) % salts).cast("int").alias("salt"))
    score = F.round((F.col("own") - 2 * dot(F.col("v"), F.col("m")) + F.col("energy")) / F.col("energy"), 9).alias("score")
    found = near.join(sums, ["range", "salt"]).select("spike", "unit1", "unit2", "shift1", "shift2", score).where(F.col("score") < threshold)
    best = F.min(F.struct("score", "unit1", "unit2", "shift1", "shift2")).alias("b")
    return found.groupBy("spike").agg(best).select("spike", *[f"b.{c}" for c in ("unit1", "unit2", "shift1", "shift2", "score")])


def overlap_table(accepted: DataFrame) -> DataFrame:
    """(spike, unit): the units of each accepted overlap."""
    return accepted.select("spike", F.explode(F.array("unit1", "unit2")).alias("unit"))
