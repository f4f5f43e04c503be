"""Recordings cut in time: chunks with the samples around them, so that one channel keeps many tasks busy.

Recursions in time are run for each chunk by itself, from some samples before it (the
lead) to some after it (the tail). Whether that was enough is seen where chunks meet:
what one chunk ends with must be what the next one begins with. Chunks that fail are run
again with a longer halo, at last with the whole recording, so the result is that of one
pass over all of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise

#: By how much the halo grows where it was too short.
GROWTH = 4


def sections(sig: DataFrame, chunk: int, halo: int, only: DataFrame | None = None) -> DataFrame:
    """(ch, k, t0, lead, own, first, last, x array<double>, mark array<boolean>): each chunk of `chunk` samples with up to `halo` samples before and after it.

    sig: (ch, t, x), t without gaps, x a number or an array of one for each channel of a group, and maybe a boolean `mark` a sample (default: false).
    t0: the chunk's first sample; first, last: the section reaches the recording's start,
    end. only: (ch, k) of the chunks wanted.
    """
    number = not sig.schema["x"].dataType.typeName() == "array"
    sig = sig if "mark" in sig.columns else sig.withColumn("mark", F.lit(False))
    ends = F.broadcast(sig.groupBy("ch").agg(F.min("t").alias("_low"), F.max("t").alias("_high")))  # a row a channel
    at = F.col("t") - F.col("_low")
    reach = F.sequence(F.floor(F.greatest(at - halo, F.lit(0)) / chunk), F.floor(F.least(at + halo, F.col("_high") - F.col("_low")) / chunk))
    near = sig.join(ends, "ch").select("ch", "t", "x", "mark", "_low", "_high", F.explode(reach).alias("k"))
    if only is not None:
        near = near.join(only.select("ch", "k"), ["ch", "k"], "left_semi")
    tasks = int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.col("_low") + F.col("k") * chunk
    cut = near.select("ch", "k", low.alias("t0"), "t", "x", "mark", (low - halo <= F.col("_low")).alias("first"), (low + chunk + halo > F.col("_high")).alias("last"))
    rows = cut.repartition(tasks, "ch", "k").groupBy("ch", "k", "t0", "first", "last").agg(F.sort_array(F.collect_list(F.struct("t", "x", "mark"))).alias("s"))  # at most chunk + 2 * halo samples
    lead = F.size(F.filter("s", lambda v: v["t"] < F.col("t0")))
    own = F.size(F.filter("s", lambda v: (v["t"] >= F.col("t0")) & (v["t"] < F.col("t0") + chunk)))
    return rows.select("ch", "k", "t0", lead.alias("lead"), own.alias("own"), "first", "last", F.transform("s", lambda v: v["x"].cast("double") if number else v["x"]).alias("x"), F.transform("s", lambda v: v["mark"]).alias("mark"))


def settled(sig: DataFrame, chunk: int, halo: int, run: Callable[[DataFrame], DataFrame], failed: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """run(sections) with a row a chunk (ch, k, ..), where no chunk fails: failed(rows) gives (ch, k) to be run again with a longer halo."""
    done = materialise(run(sections(sig, chunk, halo)), name)
    while True:
        bad = materialise(failed(done).distinct(), f"{name}-failed")
        if bad.isEmpty():
            return done
        halo *= GROWTH
        again = run(sections(sig, chunk, halo, bad))
        done = materialise(done.join(bad, ["ch", "k"], "left_anti").select(*again.columns).unionByName(again), name)


def apart(a: str, b: str, share: float) -> Column:
    """Whether two arrays of numbers differ by more than a share of their size somewhere; infinities equal themselves."""
    return F.exists(F.zip_with(a, b, lambda x, y: ~((x == y) | (F.abs(x - y) <= share * (1 + F.abs(x))))), lambda v: v)


def not_yet(pairs: DataFrame, wrong: Column, ahead: bool, reach: str) -> DataFrame:
    """(ch, k) to be run again where `wrong`: the next chunk (ahead) or this one, unless its section reaches the recording's end on the side `reach`; else the other, likewise."""
    one, two = (F.col(f"next_{reach}"), F.col(reach)) if ahead else (F.col(reach), F.col(f"next_{reach}"))
    step = F.when(~one, F.lit(int(ahead))).when(~two, F.lit(int(not ahead)))
    return pairs.where(wrong).select("ch", (F.col("k") + step).alias("k")).where("k IS NOT NULL")


def meeting(rows: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """Chunks side by side with the next one of their channel: (ch, k, columns of the chunk, columns of the next)."""
    ahead = rows.select("ch", (F.col("k") - 1).alias("k"), *[F.col(c).alias(f"next_{c}") for c in after])
    return rows.select("ch", "k", *before).join(ahead, ["ch", "k"])


class Lanes:
    """Sections side by side: x (lanes, steps[, channels]), each lane's own samples from step `at` on, samples from `begin` to `stop`."""

    def __init__(self, leads: list[int], owns: list[int], firsts: list[bool], lasts: list[bool], xs: list[np.ndarray]):
        self.lead, self.own = np.array(leads), np.array(owns)
        self.at = int(self.lead.max(initial=0))
        self.begin = self.at - self.lead
        self.stop = self.begin + np.array([len(x) for x in xs])
        self.exact, self.ends = np.array(firsts), np.array(lasts)
        self.x = self.spread(xs, float)
        self.last = self.at + self.own - 1

    def spread(self, xs: list[np.ndarray], kind: type) -> np.ndarray:
        """A value or a row a sample as (lanes, steps[, channels])."""
        out = np.zeros((len(xs), int(self.stop.max(initial=0)), *(xs[0].shape[1:] if len(xs) and isinstance(xs[0], np.ndarray) else ())), kind)
        for i, x in enumerate(xs):
            out[i, self.begin[i] : self.stop[i]] = x
        return out

    @property
    def steps(self) -> int:
        return self.x.shape[1]


def lanes_of(batch: dict[str, list], bytes_a_sample: int, budget: int = 1 << 27):
    """(rows, Lanes) of a batch of sections, as many side by side as the budget of bytes allows, one at least; sections of like length stand together."""
    xs = [np.asarray(x, float) for x in batch["x"]]
    order = np.argsort([-len(x) for x in xs], kind="stable")
    at = 0
    while at < len(order):
        size = max(1, min(len(order) - at, budget // max(1, bytes_a_sample * len(xs[order[at]]))))
        rows = order[at : at + size].tolist()
        yield rows, Lanes([batch["lead"][i] for i in rows], [batch["own"][i] for i in rows], [batch["first"][i] for i in rows], [batch["last"][i] for i in rows], [xs[i] for i in rows])
        at += size
