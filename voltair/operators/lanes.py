"""Recursions of the hidden Markov model over many sections side by side, in numpy: a step in time is one operation for all of them."""

from __future__ import annotations

import numpy as np

from .chunks import Lanes

TINY = np.exp(-700.0)
#: Columns of two chunks that meet agree if no score differs by more than this share.
AGREE = 1e-9


def misfits(x: np.ndarray, means: np.ndarray, precision: float | np.ndarray) -> np.ndarray:
    """(.., states): half the squared distance of samples x (..[, channels]) from means (states[, channels]), weighted by the noise's inverse covariance."""
    if means.ndim == 1:
        d = x[..., None] - means
        return 0.5 * precision * d * d
    c = np.atleast_2d(precision)
    weighted = means @ c
    return 0.5 * (((x @ c) * x).sum(-1)[..., None] - 2 * x @ weighted.T + (weighted * means).sum(1))


def posterior(run: Lanes, means: np.ndarray, length: int, p: np.ndarray, precision: float | np.ndarray) -> dict[str, np.ndarray]:
    """Sums over each lane's own samples, by state: g, gx, gxx; and the columns that chunks hand over: fin, fout (forward, before and at the end), bin, bout (backward).

    means: (states[, channels]), the silent one first. With channels, gx is by state and
    channel, and gxx the plain sum of products of channels. Lanes that don't reach the start begin with the model's rates.
    """
    lanes, steps, states = len(run.x), run.steps, len(means)
    first, last = 1 + np.arange(len(p)) * length, (1 + np.arange(len(p))) * length
    silent = np.zeros(states)
    silent[0] = 1.0
    guess = np.concatenate([[1.0], np.repeat(p, length)])
    e = np.exp(-misfits(run.x, means, precision)) + TINY
    e /= e.sum(2, keepdims=True)
    column = np.where(run.exact[:, None], silent, guess / guess.sum())
    start = run.begin + run.exact  # the first sample of a recording isn't scored
    g = np.zeros((int(run.own.max(initial=0)), lanes, states))
    fin = column.copy()
    for t in range(steps):
        new = np.empty_like(column)
        new[:, 1:] = column[:, :-1]
        new[:, first] = column[:, :1] * p
        new[:, 0] = column[:, 0] * (1 - p.sum()) + column[:, last].sum(1)
        new *= e[:, t]
        new /= new.sum(1, keepdims=True)
        column = np.where(((t >= start) & (t < run.stop))[:, None], new, column)
        if t == run.at - 1:
            fin = column.copy()
        elif run.at <= t < run.at + len(g):
            g[t - run.at] = column
    fout = g[run.own - 1, np.arange(lanes)]
    b = np.full((lanes, states), 1 / states)
    bin_, bout = b.copy(), b.copy()
    for t in range(steps - 1, -1, -1):
        if t + 1 < steps:
            ahead = b * e[:, t + 1]
            new = np.zeros_like(b)
            new[:, :-1] = ahead[:, 1:]
            new[:, last] = ahead[:, :1]
            new[:, 0] = ahead[:, 0] * (1 - p.sum()) + ahead[:, first] @ p
            new /= new.sum(1, keepdims=True)
            b = np.where((t + 1 < run.stop)[:, None], new, b)
        bin_ = np.where((t == run.last)[:, None], b, bin_)
        if t == run.at - 1:
            bout = b.copy()
            break
        if run.at <= t < run.at + len(g):
            g[t - run.at] *= b
            g[t - run.at] /= g[t - run.at].sum(1, keepdims=True)
    g *= (np.arange(len(g))[:, None] < run.own)[:, :, None]
    if means.ndim == 1:
        x = run.x[:, run.at : run.at + len(g)].T[:, :, None]
        gx, gxx = (g * x).sum(0), (g * x * x).sum(0)
    else:
        x = run.x[:, run.at : run.at + len(g)] * (np.arange(len(g)) < run.own[:, None])[:, :, None]
        gx = np.einsum("nls,lnc->lsc", g, x).reshape(lanes, -1)
        gxx = np.einsum("lnc,lnd->lcd", x, x).reshape(lanes, -1)
    return {"g": g.sum(0), "gx": gx, "gxx": gxx, "fin": fin, "fout": fout, "bin": bin_, "bout": bout}


class Trellis:
    """Best ways into all joint states of a run of lanes, and the second best on request; ways are those of `moves` (see hmm.Moves)."""

    def __init__(self, states: np.ndarray, moves, templates: np.ndarray, precision: float | np.ndarray, start: int = 0, second: bool = False):
        self.states, self.moves, self.precision, self.start, self.second = states, moves, precision, start, second
        padded = np.concatenate([np.zeros((*templates.shape[:-1], 1)), templates], -1)
        self.means = sum(padded[r, ..., states[:, r]] for r in range(len(templates)))
        self.place = np.full(len(states), -1)
        self.place[moves.many] = np.arange(len(moves.many))
        size = np.diff(moves.at)[moves.many]
        self.ways = np.concatenate([np.arange(moves.at[i], moves.at[i + 1]) for i in moves.many]) if len(moves.many) else np.zeros(0, np.int64)
        self.first = np.cumsum(size) - size
        self.size = size
        self.reached = np.diff(moves.at) > 0  # states without any way are never entered
        self.single = np.minimum(moves.at[:-1], max(len(moves.who) - 1, 0))

    def begin(self, lanes: int, exact: np.ndarray) -> np.ndarray:
        silent = np.full(len(self.states), -np.inf)
        silent[self.start] = 0.0
        return np.where(exact[:, None], silent, np.zeros((lanes, len(self.states))))

    def step(self, score: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(scores after a sample, best way into each of `moves.many`, the second best or None, by how much it is worse)."""
        options = score[:, self.moves.who] + self.moves.log_p
        pick = np.broadcast_to(self.single, (len(score), len(self.single))).copy()
        best = after = margin = None
        if len(self.ways):
            some = options[:, self.ways]
            number = np.arange(some.shape[1])
            top = np.maximum.reduceat(some, self.first, axis=1)
            at = np.minimum.reduceat(np.where(some == np.repeat(top, self.size, axis=1), number, some.shape[1] - 1), self.first, axis=1)  # the first of the best
            best = self.ways[at]
            pick[:, self.moves.many] = best
            if self.second:
                rest = some.copy()
                np.put_along_axis(rest, at, -np.inf, 1)
                runner = np.maximum.reduceat(rest, self.first, axis=1)
                after = self.ways[np.minimum.reduceat(np.where(rest == np.repeat(runner, self.size, axis=1), number, some.shape[1] - 1), self.first, axis=1)]
                with np.errstate(invalid="ignore"):
                    margin = np.where(np.isfinite(runner), top - runner, np.inf)
        new = np.where(self.reached, np.take_along_axis(options, pick, 1), -np.inf) - misfits(x, self.means, self.precision)
        return new, (np.zeros((len(score), 0), np.int64) if best is None else best), after, margin

    def decode(self, run: Lanes, flips: np.ndarray | None = None, end: int | None = None) -> dict[str, np.ndarray]:
        """Paths (lanes, own samples) of joint states, their margins, score of the own samples, and what chunks hand over: cin, cout (scores less the best), sin, sout (states).

        flips: (lanes, steps), where the second best way into the path's state is taken.
        end: the state in which recordings end (default: the best).
        """
        lanes, steps = len(run.x), run.steps
        score = self.begin(lanes, run.exact)
        start = run.begin + run.exact
        back = np.zeros((steps, lanes, len(self.moves.many)), np.int32)
        then = np.zeros((steps, lanes, len(self.moves.many)), np.int32) if self.second else None
        worse = np.full((steps, lanes, len(self.moves.many)), np.inf) if self.second else None
        cin, cout = score.copy(), score.copy()
        for t in range(steps):
            new, best, after, margin = self.step(score, run.x[:, t])
            score = np.where(((t >= start) & (t < run.stop))[:, None], new, score)
            back[t] = best
            if self.second and after is not None:
                then[t], worse[t] = after, margin
            if t == run.at - 1:
                cin = score.copy()
            cout = np.where((t == run.last)[:, None], score, cout)
        state = score.argmax(1) if end is None else np.where(run.ends, end, score.argmax(1))
        every = np.arange(lanes)
        path = np.zeros((steps, lanes), np.int64)
        way = np.full((steps, lanes), -1)
        margins = np.full((steps, lanes), np.inf)
        for t in range(steps - 1, -1, -1):
            path[t] = state
            spot = self.place[state]
            taken = np.where(spot < 0, self.single[state], back[t, every, spot] if back.shape[2] else 0)
            if self.second:
                margins[t] = np.where(spot < 0, np.inf, worse[t, every, spot] if back.shape[2] else np.inf)
                if flips is not None:
                    taken = np.where(flips[:, t] & np.isfinite(margins[t]), then[t, every, spot], taken)
            live = (t >= start) & (t < run.stop)
            way[t] = np.where(live, taken, -1)
            state = np.where(live, self.moves.who[taken], state)
        own = slice(run.at, run.at + int(run.own.max(initial=0)))
        mine = np.arange(own.stop - own.start)[:, None] < run.own
        d = np.swapaxes(run.x[:, own], 0, 1) - self.means[path[own]]
        far = self.precision * d * d if d.ndim == 2 else ((d @ np.atleast_2d(self.precision)) * d).sum(-1)
        gain = np.where(way[own] >= 0, self.moves.log_p[way[own]] - 0.5 * far, 0.0)
        less = lambda c: c - c.max(1, keepdims=True)
        return {"path": path[own].T, "margin": margins[own].T, "score": (gain * mine).sum(0), "cin": less(cin), "cout": less(cout), "sin": path[max(run.at - 1, 0)], "sout": path[run.last, every]}


class Online:
    """A decoder of one recording that is fed bit by bit: it tells states as soon as all paths that may still be the best agree on them.

    It holds a score a state, and the ways of the samples not told yet, however many these are.
    """

    def __init__(self, trellis: Trellis):
        self.trellis = trellis
        self.score = trellis.begin(1, np.array([True]))
        self.back = np.zeros((0, len(trellis.moves.many)), np.int32)
        self.count = 0

    def before(self, at: int, state: np.ndarray) -> np.ndarray:
        """The states at the sample before untold sample `at` on the paths into `state`."""
        spot = self.trellis.place[state]
        single = self.trellis.single[state]
        return self.trellis.moves.who[np.where(spot < 0, single, self.back[at, np.maximum(spot, 0)] if self.back.shape[1] else single)]

    def push(self, x: np.ndarray) -> np.ndarray:
        """States of the samples that are certain now."""
        told = []
        ways = []
        for v in x:
            if not self.count:  # the first sample isn't scored: it starts in silence
                told.append(self.trellis.start)
            else:
                self.score, best, _, _ = self.trellis.step(self.score, np.array([v]))
                self.score -= self.score.max()
                ways.append(best[0].astype(np.int32))
            self.count += 1
        if ways:
            self.back = np.concatenate([self.back, np.stack(ways)])
        heads = np.flatnonzero(np.isfinite(self.score[0]))
        for at in range(len(self.back) - 1, -1, -1):
            if len(heads) == 1:
                return np.concatenate([np.array(told, np.int64), self.tell(at + 1, int(heads[0]))])
            heads = np.unique(self.before(at, heads))
        return np.array(told, np.int64)

    def tell(self, n: int, state: int) -> np.ndarray:
        """The states of the first n untold samples, of which the last is `state`; they are told then."""
        path = np.zeros(n, np.int64)
        for at in range(n - 1, -1, -1):
            path[at] = state
            state = int(self.before(at, np.array([state]))[0])
        self.back = self.back[n:]
        return path

    def close(self) -> np.ndarray:
        """The states of all other samples, where the recording ends."""
        return self.tell(len(self.back), int(self.score[0].argmax()))
