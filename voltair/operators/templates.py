"""Sets of templates: dropping small and sparse ones, splitting, pooling, and learning in stages that can be resumed.

A set is few rows (template_id, p, precision, waveform), so its arithmetic is done on
the driver; whatever touches samples is a Spark aggregate. Each finished stage is a
folder `stage=<name>` of Parquet; one that is there already isn't computed again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hmm

TEMPLATES = "template_id long, p double, precision double, waveform array<double>"
#: Templates with less energy a sample than this aren't compared with others when templates are merged.
SMALL = 3.0
Set = tuple[np.ndarray, np.ndarray, float]


def to_frame(spark: SparkSession, found: Set) -> DataFrame:
    templates, p, precision = found
    return spark.createDataFrame([(i, float(p[i]), float(precision), [float(x) for x in t]) for i, t in enumerate(templates)], TEMPLATES)


def from_frame(df: DataFrame) -> Set | None:
    """The set of a frame; None of an empty one."""
    rows = df.orderBy("template_id").collect()  # as many as templates
    if not rows:
        return None
    return np.array([r["waveform"] for r in rows]), np.array([r["p"] for r in rows]), rows[0]["precision"]


def load(spark: SparkSession, folder: str, stage: str) -> Set | None:
    """A finished stage, or None. A stage that was being written, or found no templates, is not finished."""
    try:
        return from_frame(spark.read.schema(TEMPLATES).parquet(f"{folder}/stage={stage}"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def patch_energy(sig: DataFrame, length: int) -> float:
    """Median energy of consecutive whole patches of `length` samples; without any: 0."""
    patches = sig.groupBy("ch", F.floor(F.col("t") / length).alias("patch")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("n"))
    return patches.where(F.col("n") == length).agg(F.median("e")).first()[0] or 0.0


def drop_small(found: Set, energy: float, factor: float) -> Set:
    """Templates of at least `factor` times the energy of a patch."""
    templates, p, precision = found
    keep = (templates**2).sum(1) >= factor * energy
    return templates[keep], p[keep], precision


def drop_sparse(found: Set, least: float) -> Set:
    """Templates that fire more often than `least` a sample."""
    templates, p, precision = found
    return templates[p > least], p[p > least], precision


def merge(found: Set, samples: int, max_p: float = 12.0) -> Set:
    """Merged templates; small ones stay as they are, behind the others."""
    templates, p, precision = found
    small = precision * (templates**2).sum(1) < SMALL * templates.shape[1]
    merged, rate = hmm.combine(templates[~small], p[~small], precision, samples, max_p=max_p)
    return np.concatenate([merged, templates[small]]), np.concatenate([rate, p[small]]), precision


def pooled_covariance(parts: DataFrame) -> DataFrame:
    """(i, j, cov): covariances (part, n, i, j, cov) of several recordings, weighted by their samples."""
    return parts.groupBy("i", "j").agg((F.sum(F.col("n") * F.col("cov")) / F.sum("n")).alias("cov"))


def gather(parts: DataFrame, sig: DataFrame, factor: float = 4.0) -> Set:
    """One set from those learned on several stretches (part, n, template_id, p, precision, waveform) of `sig`: pooled variance, noise removed, merged."""
    of_part = parts.groupBy("part").agg(F.first("n").alias("n"), F.first("precision").alias("precision"))
    total, variance = of_part.agg(F.sum("n"), F.sum(F.col("n") / F.col("precision")) / F.sum("n")).first()
    rows = parts.orderBy("part", "template_id").collect()  # as many as templates
    if not rows:
        raise ValueError("no part has templates")
    templates, p = np.array([r["waveform"] for r in rows]), np.array([r["p"] * r["n"] / total for r in rows])
    found = drop_small((templates, p, 1 / variance), patch_energy(sig, templates.shape[1]), factor)
    return merge(found, total) if len(found[0]) else found


def sets_under(spark: SparkSession, pattern: str, stage: str = "after_noise") -> DataFrame:
    """(part, template_id, p, precision, waveform): the sets of one stage in all folders of learning that match a pattern; part: the folder. Files that can't be read are left out."""
    found = spark.read.schema(TEMPLATES).option("ignoreCorruptFiles", "true").parquet(f"{pattern.rstrip('/')}/stage={stage}")
    folder = F.regexp_extract(F.input_file_name(), f"^(.*)/stage={stage}/", 1)
    return found.select(folder.alias("part"), *found.columns)


def gather_files(pattern: str, sig: DataFrame, lengths: DataFrame | None = None, factor: float = 4.0, stage: str = "after_noise") -> Set:
    """gather, from all folders of learning that match a pattern. lengths: (part, n), samples each was learned on (default: the same)."""
    parts = sets_under(sig.sparkSession, pattern, stage)
    parts = parts.withColumn("n", F.lit(1).cast("long")) if lengths is None else parts.join(F.broadcast(lengths), "part")  # a row a folder
    return gather(parts, sig, factor)


def learn_files(spark: SparkSession, path: str, channel: int, folder: str, begin: int = 0, end: int | None = None, gain: float = 1.0, layout: str = "signal", **options) -> dict[str, Set]:
    """learn, from one channel of recording files and a range of their samples; only these bytes are read. Each file is a recording of its own."""
    from ..sources import recordings

    rows = recordings.samples(spark, path, layout).where((F.col("ch") == channel) & (F.col("t") >= begin))
    rows = rows if end is None else rows.where(F.col("t") < end)
    return learn(rows.select(F.col("file").alias("ch"), "t", (F.col("x") / gain).alias("x")), folder, **options)


def learn(sig: DataFrame, folder: str, rate: float = 30_000.0, rings: int = 8, length: int | None = None, iterations: int = 3, min_rate: float = 0.5, min_snr: float = 4.0, small: float = 1.0, split: bool = False, **options) -> dict[str, Set]:
    """Sets by stage: learn, merge, drop small, drop sparse, learn twice more, drop sparse, drop small.

    length: samples of a waveform (1.5 ms); min_rate: spikes a second; options: those of
    hmm.learn. It ends at the first stage that leaves no template.
    """
    spark = sig.sparkSession
    length = length or int(np.ceil(1.5 * rate / 1000))
    least = min_rate / rate
    samples, energy = sig.count(), patch_energy(sig, length)
    below = least if split else None
    steps: list[tuple[str, Callable[[Set | None], Set]]] = [
        ("all", lambda _: hmm.learn(sig, rings, length, iterations, split_below=below, **options)),
        ("after_combine", lambda f: merge(f, samples)),
        ("after_noise", lambda f: drop_small(f, energy, min_snr)),
        ("after_sparse", lambda f: drop_sparse(f, least)),
        ("second_learning", lambda f: hmm.learn(sig, len(f[0]), length, 2, known=f, **options)),
        ("second_after_sparse", lambda f: drop_sparse(f, least)),
        ("second_after_noise", lambda f: drop_small(f, energy, small)),
    ]
    out: dict[str, Set] = {}
    found: Set | None = None
    for name, step in steps:
        done = load(spark, folder, name)
        if done is None:
            done = step(found)
            to_frame(spark, done).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stage={name}")
        out[name] = found = done
        if not len(found[0]):
            break
    return out
