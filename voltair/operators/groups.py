"""The hidden Markov model over groups of channels that are recorded side by side.

Signals are (grp, ch, t, x). A template is a waveform on every channel of its group,
and noise has a covariance between channels. A group is cut in time like a single
channel; learning sums are combined by a grouped aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from . import hmm
from .ordered import numbered
from .signals import STRETCH


def side_by_side(sig: DataFrame, channels: list) -> DataFrame:
    """(ch, t, x array<double>, at): a group's instants at which all channels have a sample, numbered from 0; at: the instant."""
    row = F.array(*[F.max(F.when(F.col("ch") == c, F.col("x"))).cast("double") for c in channels])
    whole = sig.groupBy(F.col("grp").cast("string").alias("ch"), F.col("t").alias("at")).agg(row.alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    return materialise(numbered(whole, "ch", F.col("at"), [], STRETCH).select("ch", "t", "x", "at"), "groups")


def decode(sig: DataFrame, channels: list, templates: np.ndarray, p: np.ndarray, precision: np.ndarray, active: int = 2, patch: int = 20_000) -> DataFrame:
    """(grp, template_id, t, state, margin), states above 0 only.

    templates: (rings, channels, length); precision: inverse covariance of the noise.
    margin: by how much the best way into the state beats the second best; infinite
    where there is only one. patch: samples that a task takes at once.
    """
    states = hmm.joint_states(len(templates), templates.shape[-1], min(active, len(templates)))
    rows = side_by_side(sig, channels)
    done = hmm.decoded_chunks(rows.select("ch", "t", "x"), states, hmm.predecessors(states, templates.shape[-1], p), templates, precision, patch, margins=True)
    found = hmm.sparse(done, states).join(rows.select("ch", "t", "at"), ["ch", "t"])
    return found.select(F.col("ch").alias("grp"), "template_id", F.col("at").alias("t"), "state", "margin")


def sums(rows: DataFrame, templates: np.ndarray, p: np.ndarray, precision: np.ndarray, chunk: int = 8192) -> DataFrame:
    """(kind, i, value): sums over all groups of side_by_side rows. g: posterior of state i; gx: of state and channel, i counting channels first; xx: products of channels; n: samples."""
    means = np.concatenate([np.zeros((1, templates.shape[1])), templates.transpose(0, 2, 1).reshape(-1, templates.shape[1])])
    done = hmm.posterior_rows(rows.select("ch", "t", "x"), means, templates.shape[-1], p, precision, chunk)
    kinds = {"g": "g", "gx": "gx", "xx": "gxx"}
    each = [done.select(F.lit(kind).alias("kind"), F.posexplode(c).alias("i", "value")) for kind, c in kinds.items()]
    each.append(done.select(F.lit("n").alias("kind"), F.lit(0).alias("i"), F.col("own").cast("double").alias("value")))
    whole = each[0].union(each[1]).union(each[2]).union(each[3])
    return whole.groupBy("kind", "i").agg(F.sum("value").alias("value"))


def learn(sig: DataFrame, channels: list, templates: np.ndarray, p: np.ndarray, precision: np.ndarray, iterations: int = 3, update_p: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(templates, p, precision) by expectation maximisation from a first guess. The driver gets (states + channels) x channels sums."""
    rings, many, length = templates.shape
    rows, first = side_by_side(sig, channels), p
    for _ in range(iterations):
        found = sums(rows, templates, p if update_p else first, precision).toPandas()
        part = {k: r.sort_values("i")["value"].to_numpy() for k, r in found.groupby("kind")}
        if not part:
            break
        samples, g, gx = part["n"][0], part["g"], part["gx"].reshape(-1, many)
        means = np.concatenate([np.zeros((1, many)), templates.transpose(0, 2, 1).reshape(-1, many)])
        cross = gx.T @ means
        residual = part["xx"].reshape(many, many) - cross - cross.T + means.T @ (means * g[:, None])
        templates = (gx / np.maximum(g, 1e-300)[:, None])[1:].reshape(rings, length, many).transpose(0, 2, 1)
        p = g[1 + np.arange(rings) * length] / samples
        precision = np.linalg.pinv(residual / samples)
    return templates, p, precision
