"""Hidden Markov model of recurring waveforms: learning and decoding.

State space: one silent state and, for each template, a ring of its samples. From
silence a ring is entered with its rate p; inside a ring time advances; its last
sample leads back to silence. Recursions in time run in numpy, over states and over many
chunks of recordings side by side; Spark deals chunks to tasks, checks that they meet, and
combines the learning sums by a grouped aggregate.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chi2_tail
from . import lanes
from .chunks import Lanes, apart, lanes_of, meeting, not_yet, settled
from .signals import mad_scale

TINY = np.exp(-700.0)


def by_channel(templates: np.ndarray) -> np.ndarray:
    """(rings, channels, length); templates of one channel may lack the middle."""
    return templates if templates.ndim == 3 else templates[:, None, :]


def misfit(x: np.ndarray, means: np.ndarray, precision: float | np.ndarray) -> np.ndarray:
    """(states, samples): half the squared distance of x (samples[, channels]) from means (states, channels). precision: the noise's inverse covariance."""
    x, c = x.reshape(len(x), -1), np.atleast_2d(precision)
    weighted = means @ c
    return 0.5 * (((x @ c) * x).sum(1)[None, :] - 2 * weighted @ x.T + (weighted * means).sum(1)[:, None])


def posterior_chunks(x: np.ndarray, templates: np.ndarray, p: np.ndarray, precision: float | np.ndarray, chunk: int = 50_000) -> Iterator[tuple[int, np.ndarray]]:
    """(first sample, posterior (states, samples)) of each chunk of a recording, the last chunk first.

    One pass forward keeps the column before each chunk only; then each chunk is passed
    forward again from that column, and backward from the column that the chunk after it
    hands over. So a recording of any length takes the memory of a chunk, and the result
    is that of the whole.
    """
    t = by_channel(templates)
    n, channels, length = t.shape
    means = np.concatenate([np.zeros((1, channels)), t.transpose(0, 2, 1).reshape(-1, channels)])
    first, last = 1 + np.arange(n) * length, (1 + np.arange(n)) * length

    def emission(a: int, z: int) -> np.ndarray:
        e = np.exp(-misfit(x[a:z], means, precision)) + TINY
        return e / e.sum(0)

    def forward(column: np.ndarray, e: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(e.shape[1]):
            new = np.empty_like(column)
            new[1:] = column[:-1]
            new[first] = column[0] * p
            new[0] = column[0] * (1 - p.sum()) + column[last].sum()
            new *= e[:, k]
            column = new / new.sum()
            yield column

    silent = np.zeros(len(means))
    silent[0] = 1.0  # it starts silent, and the first sample isn't scored
    starts, before, column = list(range(0, len(x), chunk)), [], silent
    for a in starts:
        before.append(column)
        if a == starts[-1]:
            break
        for column in forward(column, emission(a, a + chunk)[:, a == 0 :]):  # noqa: B007
            pass
    b, after = np.ones(len(means)), None  # after: emission of the sample behind the chunk
    for a, column in zip(reversed(starts), reversed(before), strict=True):
        e = emission(a, min(a + chunk, len(x)))
        g = np.empty_like(e)
        if a == 0:
            g[:, 0] = silent
        for k, c in enumerate(forward(column, e[:, a == 0 :]), int(a == 0)):
            g[:, k] = c
        for k in range(e.shape[1] - 1, -1, -1):
            if after is not None:
                ahead = b * after
                new = np.zeros_like(b)
                new[:-1] = ahead[1:]
                new[last] = ahead[0]
                new[0] = ahead[0] * (1 - p.sum()) + (p * ahead[first]).sum()
                b = new / new.sum()
            g[:, k] *= b
            g[:, k] /= g[:, k].sum()
            after = e[:, k]
        yield a, g


def forward_backward(x: np.ndarray, templates: np.ndarray, p: np.ndarray, precision: float | np.ndarray, chunk: int = 50_000) -> np.ndarray:
    """Posterior (states, samples) of one recording. templates: (rings[, channels], length), the silent sample not among them."""
    found = [g for _, g in posterior_chunks(x, templates, p, precision, chunk)]
    return np.concatenate(found[::-1], 1) if found else np.zeros((1 + by_channel(templates)[:, 0].size, 0))


def rows_of(x: pa.Array) -> np.ndarray:
    """Numbers, or equally long lists of them, as an array."""
    return x.flatten().to_numpy().reshape(len(x), -1) if pa.types.is_list(x.type) else x.to_numpy()


def in_lanes(rows: DataFrame, bytes_a_sample: int, kernel: Callable[[Lanes, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """kernel(lanes, marks) over sections, as rows (ch, k, t0, own, first, last, and what the kernel gives a lane, cut to `own` samples where it gives more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = {c: b[c].to_pylist() for c in ("ch", "k", "t0", "own", "lead", "first", "last")} | {"x": [rows_of(v.values) for v in b["x"]], "mark": [v.values.to_numpy(zero_copy_only=False) for v in b["mark"]]}
            for rows, lanes in lanes_of(batch, bytes_a_sample):
                out = kernel(lanes, lanes.spread([batch["mark"][i] for i in rows], bool))
                fixed = {c: pa.array([batch[c][i] for i in rows], b.schema.field(c).type) for c in ("ch", "k", "t0", "own", "first", "last")}
                made = {n: pa.array([v[: lanes.own[j]] for j, v in enumerate(a)] if n in ("path", "margin") else list(a) if a.ndim == 2 else a) for n, a in out.items()}
                yield pa.record_batch(fixed | made)

    return rows.mapInArrow(run, f"ch string, k long, t0 long, own int, first boolean, last boolean, {schema}")


def posterior_rows(sig: DataFrame, means: np.ndarray, length: int, p: np.ndarray, precision: float | np.ndarray, chunk: int, halo: int | None = None) -> DataFrame:
    """(ch, k, own, g, gx, gxx, ..): the sums of lanes.posterior, a row a chunk; what chunks hand over agrees."""
    schema = ", ".join(f"{n} array<double>" for n in ("g", "gx", "gxx", "fin", "fout", "bin", "bout"))

    def run(rows: DataFrame) -> DataFrame:
        return in_lanes(rows.withColumn("ch", F.col("ch").cast("string")), 48 * len(means), lambda x, _: lanes.posterior(x, means, length, p, precision), schema)

    def failed(rows: DataFrame) -> DataFrame:
        pairs = meeting(rows, ["first", "last", "fout", "bin"], ["first", "last", "fin", "bout"])
        return not_yet(pairs, apart("fout", "next_fin", lanes.AGREE), True, "first").union(not_yet(pairs, apart("next_bout", "bin", lanes.AGREE), False, "last"))

    return settled(sig, chunk, halo or 8 * length, run, failed, "posterior")


def posterior_sums(sig: DataFrame, templates: np.ndarray, p: np.ndarray, precision: float, chunk: int = 8192, halo: int | None = None) -> DataFrame:
    """(state, g, gx, gxx, samples): sums of the posterior and of posterior-weighted samples over all channels, chunk by chunk."""
    done = posterior_rows(sig, np.concatenate([[0.0], templates.ravel()]), templates.shape[1], p, precision, chunk, halo)
    each = done.select("own", F.posexplode(F.arrays_zip("g", "gx", "gxx")).alias("state", "s"))
    sums = [F.sum(f"s.{c}").alias(c) for c in ("g", "gx", "gxx")]
    return each.groupBy(F.col("state").cast("long").alias("state")).agg(*sums, F.sum("own").alias("samples"))


def split_sparse(templates: np.ndarray, p: np.ndarray, precision: float, below: float, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The first template rarer than `below` becomes a slightly smaller copy of a frequent, large one, and both share its rate."""
    rare = np.flatnonzero(p < below)
    donors = np.flatnonzero((p >= np.median(p)) & (p > 4 * below) & (precision * (templates**2).max(1) > 10))
    if len(rare) and len(donors):
        templates, p = templates.copy(), p.copy()
        i, j = rare[0], r.choice(donors)
        templates[i] = 0.98 * templates[j]
        p[[i, j]] = p[j] / 2
    return templates, p


def first_guess(rings: int, length: int, r: np.random.Generator) -> np.ndarray:
    """Waves of random sizes, in units of the signal's scale."""
    return np.sin(np.linspace(0, 3 * np.pi, length))[None, :] * r.uniform(0.5, 1.5, (rings, 1))


def learn(sig: DataFrame, rings: int = 8, length: int = 45, iterations: int = 3, seed: int = 1234, update_p: bool = False, start: float = 1e-8, known: tuple[np.ndarray, np.ndarray, float] | None = None, split_below: float | None = None, shift: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(templates, p, precision) by expectation maximisation. Only sums by state, a fixed number, come to the driver.

    known: a set to go on from; split_below: the rate under which a template is replaced after an iteration;
    shift: move each template by one state in the end. Where sums overflow or vanish, the iteration is done again with a precision 200 times smaller.
    """
    r = np.random.default_rng(seed)
    if known is not None:
        templates, p0, precision = known
        rings, length = templates.shape
    else:
        scale = float(mad_scale(sig).agg({"scale": "avg"}).first()[0] or 1.0)
        templates = first_guess(rings, length, r) * scale
        p0, precision = np.full(rings, start), 1 / scale**2
    p = p0
    for _ in range(iterations):
        s = posterior_sums(sig, templates, p if update_p else p0, precision).toPandas().sort_values("state")
        for _ in range(3):
            if np.isfinite(s["g"]).all():
                break
            precision /= 200
            s = posterior_sums(sig, templates, p if update_p else p0, precision).toPandas().sort_values("state")
        g, gx, gxx, samples = (s[c].to_numpy(float) for c in ("g", "gx", "gxx", "samples"))
        mean = gx / np.maximum(g, 1e-300)
        mean[0] = 0.0
        templates = mean[1:].reshape(rings, length)
        p = g[1 + np.arange(rings) * length] / samples[0]
        residual = (gxx - 2 * mean * gx + mean**2 * g).sum() / samples[0]
        precision = 1 / residual if residual > 0 else precision
        if split_below is not None:
            templates, p = split_sparse(templates, p, precision, split_below, r)
    return np.roll(templates, 1, 1) if shift else templates, p, precision


def learn_until_stable(sig: DataFrame, iterations: int = 6, rounds: int = 10, settled: float = 0.01, alpha: float = 0.001, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """learn, then merge templates and learn again from what is left, until none merge or the rates change by less than `settled` of themselves."""
    model = learn(sig, iterations=iterations, **options)
    samples = sig.count()
    for _ in range(rounds):
        templates, p = combine(*model, samples, alpha)
        if len(templates) == len(model[0]):
            break
        again = learn(sig, iterations=iterations, known=(templates, p, model[2]))
        still = np.abs(again[1] - p).max() < settled * p.max()
        model = again
        if still:
            break
    return model


def spline(x: np.ndarray, factor: int) -> np.ndarray:
    """x at `factor` times the rate through a natural cubic spline; it ends at the last sample."""
    n = len(x)
    if n < 3 or factor == 1:
        return np.interp(np.arange((n - 1) * factor + 1) / factor, np.arange(n), x) if n else x
    system = 4 * np.eye(n - 2) + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1)
    bend = np.concatenate([[0], np.linalg.solve(system, 6 * (x[2:] - 2 * x[1:-1] + x[:-2])), [0]])
    at = np.arange((n - 1) * factor + 1)
    i = np.minimum(at // factor, n - 2)
    u = at / factor - i
    w = 1 - u
    return w * x[i] + u * x[i + 1] + ((w**3 - w) * bend[i] + (u**3 - u) * bend[i + 1]) / 6


def aligned(template: np.ndarray, other: np.ndarray, factor: int = 10) -> np.ndarray:
    """`other`, moved in a circle by parts of a sample until it lies closest to `template`."""
    length = len(template)
    fine = spline(np.append(other, other[0]), factor)[:-1]
    moved = np.stack([np.roll(fine, s)[::factor] for s in range(length * factor)])
    return moved[((moved - template) ** 2).sum(1).argmin()]


def combine(templates: np.ndarray, p: np.ndarray, precision: float, samples: int, alpha: float = 0.001, max_p: float = 12.0, factor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Merge the closest pair of templates, at its best circular alignment, while a chi-square test can't tell them apart.

    factor: above 1, all are first aligned to the first one by parts of a sample.
    """
    templates, p = templates.copy(), p.copy()
    if factor > 1 and len(templates):
        templates[1:] = [aligned(templates[0], t, factor) for t in templates[1:]]
    while len(templates) > 1:
        best = None
        for i, j in itertools.combinations(range(len(templates)), 2):
            for s in range(templates.shape[1]):
                d = templates[i] - np.roll(templates[j], s)
                stat = precision * (d @ d) / (1 / min(max(samples * p[i], 1e-12), max_p) + 1 / min(max(samples * p[j], 1e-12), max_p))
                if best is None or stat < best[0]:
                    best = (stat, i, j, s)
        stat, i, j, s = best
        if chi2_tail(stat, templates.shape[1]) <= alpha:
            break
        weight = p[[i, j]] / max(p[i] + p[j], 1e-300)
        templates[i] = weight[0] * templates[i] + weight[1] * np.roll(templates[j], s)
        p[i] += p[j]
        templates, p = np.delete(templates, j, 0), np.delete(p, j)
    return templates, p


def combine_alike(templates: np.ndarray, p: np.ndarray, precision: float, alpha: float = 0.05, factor: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """The other rule of merging: from the most frequent template on, each takes all that a chi-square test can't tell from it after alignment; the mean is weighted by rate."""
    left, out, rates = list(np.argsort(-p, kind="stable")), [], []
    while left:
        i = left[0]
        moved = {j: aligned(templates[i], templates[j], factor) if j != i else templates[i] for j in left}
        same = [j for j in left if j == i or chi2_tail(precision * ((moved[j] - templates[i]) ** 2).sum(), templates.shape[1]) > alpha]
        rate = p[same].sum()
        out.append(sum(p[j] * moved[j] for j in same) / max(rate, 1e-300))
        rates.append(rate)
        left = [j for j in left if j not in same]
    return np.array(out), np.array(rates)


def joint_states(rings: int, length: int, active: int) -> np.ndarray:
    """(states, rings): ring positions, 0 silent, with at most `active` rings running at once."""
    parts = [np.zeros((1, rings), np.int16)]
    for k in range(1, active + 1):
        where = np.stack(np.meshgrid(*[np.arange(1, length + 1)] * k, indexing="ij"), -1).reshape(-1, k)
        for who in itertools.combinations(range(rings), k):
            rows = np.zeros((len(where), rings), np.int16)
            rows[:, who] = where
            parts.append(rows)
    return np.concatenate(parts)


@dataclass
class Moves:
    """Ways into each state: those of state i are `who` and `log_p` from at[i] to at[i + 1]. Most states have one; `many` lists the others."""

    who: np.ndarray
    log_p: np.ndarray
    at: np.ndarray
    many: np.ndarray

    def of(self, state: int) -> slice:
        return slice(self.at[state], self.at[state + 1])


def predecessors(states: np.ndarray, length: int, p: np.ndarray) -> Moves:
    """Running rings come from the sample before; of the silent ones, as many as the limit of running rings leaves room for may just have ended."""
    active = int((states > 0).sum(1).max())
    names = [s[s > 0].tobytes() + np.flatnonzero(s).astype(np.int16).tobytes() for s in states]
    index = {name: i for i, name in enumerate(names)}
    log_on, log_off = np.log(p), np.log1p(-p)
    stay = log_off.sum()
    who, log_p, at = [], [], [0]
    for s in states:
        running = np.flatnonzero(s)
        before = s[running] - 1
        base = stay - log_off[running].sum() + log_on[running[before == 0]].sum()
        held = {int(r): int(v) for r, v in zip(running, before, strict=True) if v}
        silent = [r for r in range(len(s)) if not s[r]]
        for k in range(min(active - len(held), len(silent)) + 1):
            for ended in itertools.combinations(silent, k):
                rings = sorted({**held, **dict.fromkeys(ended, length)}.items())
                name = np.array([v for _, v in rings], np.int16).tobytes() + np.array([r for r, _ in rings], np.int16).tobytes()
                if name in index:
                    who.append(index[name])
                    log_p.append(base - sum(log_off[r] for r in ended))
        at.append(len(who))
    at = np.array(at, np.int64)
    return Moves(np.array(who, np.int64), np.array(log_p), at, np.flatnonzero(np.diff(at) > 1))


def columns(x: np.ndarray, states: np.ndarray, moves: Moves, templates: np.ndarray, precision: float | np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """From the second sample on: (t, scores of all ways, the best way into each state, score of each state). It starts in silence; overlapping waveforms add up."""
    t = by_channel(templates)
    padded = np.concatenate([np.zeros((*t.shape[:2], 1)), t], 2)
    means = sum(padded[r, :, states[:, r]] for r in range(len(t)))
    score = np.full(len(states), -np.inf)
    score[0] = 0.0
    single = moves.at[:-1].copy()
    some = np.concatenate([np.arange(moves.at[i], moves.at[i + 1]) for i in moves.many]) if len(moves.many) else np.zeros(0, np.int64)
    size = np.diff(moves.at)[moves.many]
    first = np.cumsum(size) - size
    for at in range(1, len(x)):
        options = score[moves.who] + moves.log_p
        pick = single.copy()
        if len(some):  # the first of the best ways
            ways = options[some]
            best = np.repeat(np.maximum.reduceat(ways, first), size)
            pick[moves.many] = some[np.minimum.reduceat(np.where(ways == best, np.arange(len(ways)), len(ways)), first)]
        score = options[pick] - misfit(x[at : at + 1], means, precision)[:, 0]
        yield at, options, pick, score


def viterbi(x: np.ndarray, states: np.ndarray, moves: Moves, templates: np.ndarray, precision: float | np.ndarray) -> tuple[np.ndarray, float]:
    """Best path (indices of joint states) and its score; the first sample isn't scored. Ways are kept for states that have several."""
    back = np.zeros((len(x), len(moves.many)), np.int32)
    place = np.full(len(states), -1)
    place[moves.many] = np.arange(len(moves.many))
    only = moves.who[np.minimum(moves.at[:-1], len(moves.who) - 1)]
    score = np.where(np.arange(len(states)) == 0, 0.0, -np.inf)
    for t, _, pick, score in columns(x, states, moves, templates, precision):  # noqa: B007
        back[t] = moves.who[pick[moves.many]]
    path = np.empty(len(x), np.int64)
    path[-1] = int(score.argmax())
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = only[path[t]] if place[path[t]] < 0 else back[t, place[path[t]]]
    return path, float(score.max())


def path_margins(x: np.ndarray, path: np.ndarray, states: np.ndarray, moves: Moves, *model) -> np.ndarray:
    """How much better the way taken into each state of the path was than the second best; infinite without another."""
    out = np.full(len(x), np.inf)
    for t, options, pick, _ in columns(x, states, moves, *model):
        here = moves.of(path[t])
        ways, taken = options[here], pick[path[t]] - here.start
        if len(ways) > 1:
            out[t] = ways[taken] - np.delete(ways, taken).max()
    return out


def path_of(x: np.ndarray, states: np.ndarray, moves: Moves, templates: np.ndarray, precision: float | np.ndarray, patch: int, margins: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Best path, in patches that restart at the last silent sample of the one before, its margins (on request), and the sum of the patches' scores (stretches of two patches count twice)."""
    model = (states, moves, templates, precision)
    path, margin, at, total = np.zeros(len(x), np.int64), np.full(len(x), np.inf), 0, 0.0
    while at < len(x):
        part, score = viterbi(x[at : at + patch], *model)
        total += score
        path[at : at + len(part)] = part
        if margins:
            margin[at : at + len(part)] = path_margins(x[at : at + patch], part, *model)
        if at + len(part) >= len(x):
            break
        silent = np.flatnonzero(part[1:] == 0)
        at += int(silent[-1]) + 1 if len(silent) else len(part)
    return path, margin, total


def decoded_chunks(sig: DataFrame, states: np.ndarray, moves: Moves, templates: np.ndarray, precision: float, chunk: int, halo: int | None = None, margins: bool = False, end: int | None = None) -> DataFrame:
    """(ch, k, t0, own, path array<int>, score, ..): the best path of each channel, a row a chunk; the chunks' columns and states meet.

    margins: with `margin array<double>`. Samples that sig marks take the second best way into
    the path's state (where there is one). end: the joint state in which recordings end.
    """
    second = margins or "mark" in sig.columns
    trellis = lanes.Trellis(states, moves, templates, precision, second=second)
    schema = "path array<int>, " + ("margin array<double>, " if margins else "") + "score double, cin array<double>, cout array<double>, sin long, sout long"
    bytes_a_sample = (12 + 16 * second) * max(1, len(moves.many)) + 8

    def kernel(run: Lanes, marks: np.ndarray) -> dict[str, np.ndarray]:
        out = trellis.decode(run, marks if second else None, end)
        out["path"] = out["path"].astype(np.int32)
        if not margins:
            del out["margin"]
        return out

    def run(rows: DataFrame) -> DataFrame:
        return in_lanes(rows.withColumn("ch", F.col("ch").cast("string")), bytes_a_sample, kernel, schema)

    def failed(rows: DataFrame) -> DataFrame:
        pairs = meeting(rows, ["first", "last", "cout", "sout"], ["first", "last", "cin", "sin"])
        return not_yet(pairs, apart("cout", "next_cin", lanes.AGREE), True, "first").union(not_yet(pairs, F.col("sout") != F.col("next_sin"), False, "last"))

    return settled(sig, chunk, halo or max(64, 8 * templates.shape[-1]), run, failed, "decoded")


def sparse(decoded: DataFrame, states: np.ndarray) -> DataFrame:
    """(ch, template_id, t, state[, margin]) of the running rings in decoded_chunks."""
    margins = "margin" in decoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ring = states[b["path"][i].values.to_numpy()]
                at, template = np.nonzero(ring)
                out = {"ch": pa.array([b["ch"][i].as_py()] * len(at), pa.string()), "template_id": pa.array(template), "t": pa.array(b["t0"][i].as_py() + at), "state": pa.array(ring[at, template].astype(np.int64))}
                yield pa.record_batch(out | ({"margin": pa.array(b["margin"][i].values.to_numpy()[at])} if margins else {}))

    names = ["ch", "t0", "path", *(["margin"] if margins else [])]
    return decoded.select(*names).mapInArrow(run, "ch string, template_id long, t long, state long" + (", margin double" if margins else ""))


def decode(sig: DataFrame, templates: np.ndarray, p: np.ndarray, precision: float, active: int = 2, patch: int = 20_000) -> DataFrame:
    """(ch, template_id, t, state), states above 0 only, of each channel by itself. patch: samples a task takes at once; the path is that of the whole channel."""
    states = joint_states(len(templates), templates.shape[1], min(active, len(templates)))
    return sparse(decoded_chunks(sig, states, predecessors(states, templates.shape[1], p), templates, precision, patch), states)


def decode_with_score(sig: DataFrame, templates: np.ndarray, p: np.ndarray, precision: float, active: int = 2, patch: int = 20_000) -> DataFrame:
    """As decode, with one row more a channel, of template -1: its samples as t and its path's log-likelihood `ll`."""
    states = joint_states(len(templates), templates.shape[1], min(active, len(templates)))
    done = decoded_chunks(sig, states, predecessors(states, templates.shape[1], p), templates, precision, patch)
    stats = done.groupBy("ch").agg(F.sum("own").alias("t"), F.sum("score").alias("ll"))
    none = F.lit(None).cast("double").alias("ll")
    return sparse(done, states).select("ch", "template_id", "t", "state", none).union(stats.select("ch", F.lit(-1).cast("long"), "t", F.lit(0).cast("long"), "ll"))


def uncertain(sig: DataFrame, templates: np.ndarray, p: np.ndarray, precision: float, below: float, active: int = 2, patch: int = 20_000) -> DataFrame:
    """(ch, t, margin): decisions on the best path that beat the second best way into its state by less than `below`."""
    states = joint_states(len(templates), templates.shape[1], min(active, len(templates)))
    done = decoded_chunks(sig, states, predecessors(states, templates.shape[1], p), templates, precision, patch, margins=True)
    each = done.select("ch", "t0", F.posexplode("margin").alias("i", "margin"))
    return each.where(F.col("margin") < below).select("ch", (F.col("t0") + F.col("i")).alias("t"), "margin")


def redecode(sig: DataFrame, flips: DataFrame, templates: np.ndarray, p: np.ndarray, precision: float, active: int = 2, patch: int = 20_000) -> DataFrame:
    """As decode, but at the instants flips (ch, t) the path goes on by the second best way into its state; without a second way nothing changes there."""
    marked = sig.join(flips.select("ch", "t", F.lit(True).alias("mark")).distinct(), ["ch", "t"], "left").withColumn("mark", F.coalesce("mark", F.lit(False)))
    states = joint_states(len(templates), templates.shape[1], min(active, len(templates)))
    return sparse(decoded_chunks(marked, states, predecessors(states, templates.shape[1], p), templates, precision, patch), states)


def ring_matrix(length: int, p: float) -> np.ndarray:
    """Chances of moving (from, to) in the ring of one template: silent, then its samples."""
    m = np.eye(length + 1, k=1)
    m[0, :2] = 1 - p, p
    m[length, 0] = 1.0
    return m


def ring_moves(states: np.ndarray, matrices: list[np.ndarray], joint: dict[tuple[tuple[int, ...], tuple[int, ...]], float] | None = None) -> Moves:
    """Ways between joint states from one matrix of chances (from, to) a ring, which moves by itself; joint: chances of single moves (from, to) of all rings that replace the product, 0 forbids one."""
    index = {tuple(s): i for i, s in enumerate(states.tolist())}
    sources = [[np.flatnonzero(m[:, j]).tolist() for j in range(len(m))] for m in matrices]
    ways: list[dict[int, float]] = []
    for s in states.tolist():
        here = {}
        for before in itertools.product(*[sources[r][v] for r, v in enumerate(s)]):
            if before in index:
                here[index[before]] = float(sum(np.log(matrices[r][b, v]) for r, (b, v) in enumerate(zip(before, s, strict=True))))
        ways.append(here)
    for (a, b), chance in (joint or {}).items():
        ways[index[b]].pop(index[a], None)
        if chance > 0:
            ways[index[b]][index[a]] = float(np.log(chance))
    pairs = [sorted(w.items()) for w in ways]
    at = np.cumsum([0, *map(len, pairs)])
    return Moves(np.array([w for p in pairs for w, _ in p], np.int64), np.array([v for p in pairs for _, v in p]), at, np.flatnonzero(np.diff(at) > 1))


def decode_rings(sig: DataFrame, templates: np.ndarray, matrices: list[np.ndarray], precision: float, active: int = 2, joint: dict | None = None, silent_end: bool = True, patch: int = 20_000) -> DataFrame:
    """As decode, with transitions of one's own: a matrix a ring, and single joint moves. silent_end: recordings end in silence."""
    states = joint_states(len(templates), templates.shape[1], min(active, len(templates)))
    return sparse(decoded_chunks(sig, states, ring_moves(states, matrices, joint), templates, precision, patch, end=0 if silent_end else None), states)


def k_best(x: np.ndarray, states: np.ndarray, moves: Moves, templates: np.ndarray, precision: float, k: int, end: int | None = None) -> list[tuple[float, np.ndarray]]:
    """The k best paths and their scores, best first, from silence at the first sample (which isn't scored) to the end state (default: any).

    Each state keeps its k best ways so far, as (way, which of the way's own k best).
    """
    trellis = lanes.Trellis(states, moves, templates, precision)
    most = int(np.diff(moves.at).max())
    ways = moves.at[:-1, None] + np.arange(most)
    there = ways < moves.at[1:, None]
    ways = np.where(there, ways, 0)
    score = np.full((len(states), k), -np.inf)
    score[0, 0] = 0.0
    back = np.zeros((len(x), len(states), k), np.int64)
    for t in range(1, len(x)):
        options = np.where(there[:, :, None], score[moves.who[ways]] + moves.log_p[ways][:, :, None], -np.inf).reshape(len(states), -1)
        back[t] = np.argsort(-options, axis=1, kind="stable")[:, :k] if options.shape[1] >= k else np.pad(np.argsort(-options, axis=1, kind="stable"), ((0, 0), (0, k - options.shape[1])), constant_values=-1)
        score = np.where(back[t] >= 0, np.take_along_axis(options, np.maximum(back[t], 0), 1), -np.inf) - (0.5 * precision * (x[t] - trellis.means) ** 2)[:, None]
    last = [(float(v), s, j) for s in range(len(states)) for j, v in enumerate(score[s].tolist()) if np.isfinite(v) and (end is None or s == end)]
    out = []
    for v, s, j in sorted(last, key=lambda w: (-w[0], w[1], w[2]))[:k]:
        path = np.zeros(len(x), np.int64)
        for t in range(len(x) - 1, -1, -1):
            path[t] = s
            if t:
                w, j = divmod(int(back[t, s, j]), k)
                s = int(moves.who[ways[s, w]])
        out.append((v, path))
    return out


def alternatives(sig: DataFrame, templates: np.ndarray, p: np.ndarray, precision: float, k: int, active: int = 2, patch: int = 20_000) -> DataFrame:
    """(ch, t0, t1, place, loss, spikes array<struct<template_id, t>>): the k best readings of each stretch of samples between two silent ones of the best path.

    place 1 is the best path's; loss: how much worse than it; spikes: where templates begin.
    Stretches are dealt to tasks one by one, each with the silent sample before and after it.
    """
    states = joint_states(len(templates), templates.shape[1], min(active, len(templates)))
    moves = predecessors(states, templates.shape[1], p)
    from .ordered import numbered

    done = decoded_chunks(sig, states, moves, templates, precision, patch)
    running = done.select("ch", "t0", F.posexplode("path").alias("i", "s")).where("s > 0").select("ch", (F.col("t0") + F.col("i")).alias("t"))
    # a stretch begins where the sample before isn't in one; firsts and lasts belong together by their order
    begun = running.join(running.select("ch", (F.col("t") + 1).alias("t")), ["ch", "t"], "left_anti").select("ch", "t")
    ended = running.join(running.select("ch", (F.col("t") - 1).alias("t")), ["ch", "t"], "left_anti").select("ch", F.col("t").alias("t1"))
    stretch = numbered(begun, "ch", F.col("t"), [], patch, "_no").join(numbered(ended, "ch", F.col("t1"), [], patch, "_no"), ["ch", "_no"]).select("ch", F.col("t").alias("t0"), "t1")
    wanted = stretch.select("ch", "t0", "t1", F.explode(F.sequence(F.col("t0") - 1, F.col("t1") + 1)).alias("t"))
    rows = wanted.join(sig.select(F.col("ch").cast("string").alias("ch"), "t", "x"), ["ch", "t"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        t, t1 = part["t"].to_numpy(), int(part["t1"].iloc[0])
        closed = t[-1] == t1 + 1  # else the recording ends inside
        found = k_best(part["x"].to_numpy(float), states, moves, templates, precision, k, 0 if closed else None)
        rows = []
        for place, (score, path) in enumerate(found):
            ring = states[path]
            spikes = [{"template_id": int(r), "t": int(t[i])} for i, r in zip(*np.nonzero(ring == 1), strict=True)]
            rows.append((part["ch"].iloc[0], int(part["t0"].iloc[0]), t1, place + 1, found[0][0] - score, spikes))
        return pd.DataFrame(rows, columns=["ch", "t0", "t1", "place", "loss", "spikes"])

    return rows.groupBy("ch", "t0").applyInPandas(run, "ch string, t0 long, t1 long, place long, loss double, spikes array<struct<template_id: long, t: long>>")


#: Templates decoded together, at most.
MAX_TEMPLATES = 30


def decode_session(sig: DataFrame, templates: np.ndarray, precision: float, p: np.ndarray | None = None, cap: int = MAX_TEMPLATES, prepend: bool = False, active: int = 2, patch: int = 20_000) -> dict[str, DataFrame]:
    """The tables of a decoding: states, templates and decode_stats (ch, samples, ll).

    p: rates; none: 2 to the power of minus three halves of the length, for each. cap: templates
    beyond it are left out. prepend: a silent sample before each template.
    """
    templates = templates[:cap]
    templates = np.pad(templates, ((0, 0), (1, 0))) if prepend else templates
    p = np.full(len(templates), 2.0 ** (-1.5 * templates.shape[1])) if p is None else p[:cap]
    found = decode_with_score(sig, templates, p, precision, active, patch)
    rows = [(i, float(p[i]), [float(v) for v in t]) for i, t in enumerate(templates)]
    return {
        "states": found.where("template_id >= 0").drop("ll"),
        "templates": sig.sparkSession.createDataFrame(rows, "template_id long, p double, waveform array<double>"),
        "decode_stats": found.where("template_id < 0").select("ch", F.col("t").alias("samples"), "ll"),
    }


def decode_learned(sig: DataFrame, learned: DataFrame, precision: float, active: int = 2, patch: int = 20_000) -> DataFrame:
    """(ch, template_id, t, state): each channel with its own templates, from learned (ch, template_id, p, waveform)."""

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(own):
            return pd.DataFrame({"ch": np.array([], object), **{c: np.array([], np.int64) for c in ("template_id", "t", "state")}})
        own, rows = own.sort_values("template_id"), rows.sort_values("t")
        templates, p = np.array(own["waveform"].tolist()), own["p"].to_numpy(float)
        states = joint_states(len(templates), templates.shape[1], min(active, len(templates)))
        path, _, _ = path_of(rows["x"].to_numpy(float), states, predecessors(states, templates.shape[1], p), templates, precision, patch)
        where, which = np.nonzero(states[path])
        return pd.DataFrame({"ch": np.full(len(where), rows["ch"].iloc[0], object), "template_id": own["template_id"].to_numpy()[which], "t": rows["t"].to_numpy()[where], "state": states[path][where, which].astype(int)})

    return sig.groupBy("ch").cogroup(learned.groupBy("ch")).applyInPandas(run, "ch string, template_id long, t long, state long")


def decoded_spikes(states: DataFrame, templates: np.ndarray, align: str = "trough") -> DataFrame:
    """Instants at which a template passes its trough, or a third of its length."""
    at = templates.argmin(1) + 1 if align == "trough" else np.full(len(templates), templates.shape[1] // 3)
    wanted = F.array(*[F.lit(int(a)) for a in at])
    return states.where(F.col("state") == F.element_at(wanted, (F.col("template_id") + 1).cast("int"))).select("ch", F.col("template_id").alias("unit"), "t")


def without_edge(spikes: DataFrame, sig: DataFrame, after: int = 22) -> DataFrame:
    """spikes (ch, .., t) that end before the last `after` samples of their channel."""
    ends = sig.groupBy(F.col("ch").cast("string").alias("ch")).agg((F.max("t") + 1 - after).alias("_stop"))  # a row a channel
    return spikes.join(F.broadcast(ends), "ch").where(F.col("t") < F.col("_stop")).drop("_stop")


def milliseconds(t: Column, rate: float) -> Column:
    return t * 1000 / rate
