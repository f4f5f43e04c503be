"""Threshold events and decoding of a live signal, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import hmm, lanes


def stream_troughs(sig: DataFrame, threshold: float) -> DataFrame:
    """(ch, t, x) of local minima below -threshold from a stream of (ch, t, x) in order of t per channel.

    The state of a channel is its last two samples, so minima on the edge of two
    micro-batches are found like all others.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("t")
        if state.exists:
            t0, x0, t1, x1, n = state.get
            rows = pd.concat([pd.DataFrame({"ch": key[0], "t": [t0, t1][2 - n :], "x": [x0, x1][2 - n :]}), rows])
        x, t = rows["x"].tolist(), rows["t"].tolist()
        sign = lambda d: (d > 0) - (d < 0)
        found = [i for i in range(1, len(x) - 1) if sign(x[i + 1] - x[i]) - sign(x[i] - x[i - 1]) > 0 and x[i] < -threshold]
        n = min(2, len(x))
        state.update((t[-2] if n == 2 else 0, x[-2] if n == 2 else 0.0, t[-1], x[-1], n))
        yield pd.DataFrame({"ch": [key[0]] * len(found), "t": [t[i] for i in found], "x": [x[i] for i in found]})

    return sig.groupBy("ch").applyInPandasWithState(run, "ch string, t long, x double", "t0 long, x0 double, t1 long, x1 double, n int", "append", GroupStateTimeout.NoTimeout)


#: Samples decoded at once.
PIECE = 1 << 14


def stream_decode(sig: DataFrame, templates: np.ndarray, p: np.ndarray, precision: float, active: int = 2) -> DataFrame:
    """(ch, template_id, t, state) of running templates, from a stream of (ch, t, x) that may come in any cut and order.

    t counts from 0 in each channel; a row without x, of the t after the last, ends it. States
    are told as soon as they are certain, and are those of the batch decoder. A channel's state
    is a score for each joint state, the ways of samples that aren't told yet, and samples that
    came before their time; samples seen already are passed over. A task holds the samples of a
    micro-batch and decodes them piece by piece.
    """
    states = hmm.joint_states(len(templates), templates.shape[1], min(active, len(templates)))
    trellis = lanes.Trellis(states, hmm.predecessors(states, templates.shape[1], p), templates, precision)
    many = len(trellis.moves.many)

    def named(ch: str, told: int, path: np.ndarray) -> pd.DataFrame:
        ring = states[path]
        at, template = np.nonzero(ring)
        return pd.DataFrame({"ch": [ch] * len(at), "template_id": template, "t": told + at, "state": ring[at, template].astype(np.int64)})

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f[["t", "x"]] for f in frames])
        decoder, told, ended = lanes.Online(trellis), 0, False
        if state.exists:
            decoder.count, told, ended, score, back, t, x = state.get
            decoder.score = np.frombuffer(score).reshape(1, -1)
            decoder.back = np.frombuffer(back, np.int32).reshape(-1, many) if many else np.zeros((decoder.count - told, 0), np.int32)
            rows = pd.concat([pd.DataFrame({"t": np.frombuffer(t, np.int64), "x": np.frombuffer(x)}), rows])
        rows = rows[rows["t"] >= decoder.count].drop_duplicates("t").sort_values("t")
        t, x = rows["t"].to_numpy(np.int64), rows["x"].to_numpy(float)
        ready = int((t == decoder.count + np.arange(len(t))).cumprod().sum())  # samples whose turn it is
        now = x[:0] if ended else x[:ready]
        stop = np.flatnonzero(np.isnan(now))
        now, ended = now[: stop[0]] if len(stop) else now, ended or len(stop) > 0
        done = 0
        while done < len(now):
            size = max(PIECE, len(decoder.back))  # pieces grow with what is uncertain, as each looks it through
            path = decoder.push(now[done : done + size])
            yield named(key[0], told, path)
            told, done = told + len(path), done + size
        if len(stop):
            path = decoder.close()
            yield named(key[0], told, path)
            told += len(path)
        late = slice(len(t) if ended else ready, None)
        state.update((decoder.count, told, ended, decoder.score.tobytes(), np.ascontiguousarray(decoder.back).tobytes(), t[late].tobytes(), x[late].tobytes()))

    kept = "count long, told long, ended boolean, score binary, back binary, early_t binary, early_x binary"
    return sig.groupBy("ch").applyInPandasWithState(run, "ch string, template_id long, t long, state long", kept, "append", GroupStateTimeout.NoTimeout)
