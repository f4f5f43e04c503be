"""Noise estimates, filters and threshold events of signals (ch, t, x)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import MAD_QUANTILE
from ..shared import materialise
from .chunks import sections
from .ordered import beside

#: Samples of a channel that a task puts in order.
STRETCH = 1 << 20


def mad_scale(sig: DataFrame) -> DataFrame:
    return sig.groupBy("ch").agg((F.median(F.abs("x")) / MAD_QUANTILE).alias("scale"))


def robust_threshold(sig: DataFrame, k: float = 6.0) -> DataFrame:
    """(ch, threshold, mean): k standard deviations, taken again without samples beyond k of them."""
    sd = sig.groupBy("ch").agg(F.stddev_pop("x").alias("sd"))
    kept = sig.join(F.broadcast(sd), "ch").where(F.abs("x") < k * F.col("sd"))  # one row a channel
    return kept.groupBy("ch").agg((k * F.stddev_pop("x")).alias("threshold"), F.avg("x").alias("mean"))


def session_threshold(sig: DataFrame, k: float = 4.0) -> DataFrame:
    """As above over files (file, ch, t, x): clipped by each file's deviation, sums pooled over files."""
    sd = sig.groupBy("file", "ch").agg(F.stddev_pop("x").alias("sd"))
    kept = sig.join(sd, ["file", "ch"]).where(F.abs("x") < k * F.col("sd"))
    part = kept.groupBy("file", "ch").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.count("*").alias("n"))
    whole = part.groupBy("ch").agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum("n").alias("n"))
    return whole.select("ch", (k * F.sqrt(F.col("s2") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))).alias("threshold"))


def troughs(sig: DataFrame) -> DataFrame:
    """Samples where the sign of the difference rises: local minima (a flat one counts at both ends)."""
    around = beside(sig, "ch", ["t"], STRETCH, before={"before": "x"}, after={"after": "x"})
    return around.where(F.signum(F.col("after") - F.col("x")) - F.signum(F.col("x") - F.col("before")) > 0).drop("before", "after")


def spikes(sig: DataFrame, k: float = 6.0, before: int = 10, after: int = 32) -> DataFrame:
    """Troughs below minus the robust threshold, away from the edges by the extent of a snippet."""
    ends = sig.groupBy("ch").agg((F.max("t") + 1).alias("samples"))
    found = troughs(sig).join(F.broadcast(robust_threshold(sig, k)), "ch").join(F.broadcast(ends), "ch")
    return found.where((F.col("x") < -F.col("threshold")) & (F.col("t") >= before) & (F.col("t") < F.col("samples") - after)).select("ch", "t", "x")


def refractory(found: DataFrame, group: str, gap: int = 3, rounds: int = 4) -> DataFrame:
    """Greedy suppression over the channels of a group: the largest peak first, others within `gap` samples of it go.

    In rounds: a peak that is the largest within the gap stays, and what lies within the gap
    of one that stays goes; what is left goes on. Rounds look no further than twice the gap,
    so stretches of time, with the peaks around them, run `rounds` of them by themselves.
    There are as many jobs as the longest chain of ever larger close peaks asks for. Of
    peaks that tie the earlier, then the first channel stays; equal rows count once.
    """
    key, near = F.struct("x", "t", "ch"), 2 * gap * rounds
    width = max(1024, 16 * near)
    names = found.columns
    left, kept = found.dropDuplicates([group, "x", "t", "ch"]), None
    while kept is None or not left.isEmpty():
        buckets = F.sequence(F.floor((F.col("t") - near) / width), F.floor((F.col("t") + near) / width))
        rows = left.select("*", F.explode(buckets).alias("_b"), F.lit(0).alias("_state"))
        around = Window.partitionBy(group, "_b").orderBy("t").rangeBetween(-gap, gap)
        for _ in range(rounds):
            largest = F.min(F.when(F.col("_state") == 0, key)).over(around)
            rows = rows.withColumn("_state", F.when((F.col("_state") == 0) & (key == largest), 1).otherwise(F.col("_state")))
            beside = F.max((F.col("_state") == 1).cast("int")).over(around)
            rows = rows.withColumn("_state", F.when((F.col("_state") == 0) & (beside == 1), 2).otherwise(F.col("_state")))
        rows = materialise(rows.where((F.col("_b") == F.floor(F.col("t") / width)) & (F.col("_state") < 2)).select(*names, "_state"), "refractory")
        some = rows.where("_state = 1").select(*names)
        kept = some if kept is None else kept.union(some)
        left = rows.where("_state = 0").select(*names)
    return kept


def snippets(sig: DataFrame, found: DataFrame, before: int = 10, after: int = 21) -> DataFrame:
    """(ch, t, pos, x): the samples around each spike, by an equi-join on (ch, t)."""
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("o")
    wanted = found.select("ch", "t", offsets).select("ch", "t", (F.col("o") + before).cast("long").alias("pos"), (F.col("t") + F.col("o")).alias("at"))
    return wanted.join(sig.select("ch", F.col("t").alias("at"), "x"), ["ch", "at"]).select("ch", "t", "pos", "x")


def mean_removed(sig: DataFrame) -> DataFrame:
    mean = sig.groupBy("ch").agg(F.avg("x").alias("mean"))
    return sig.join(F.broadcast(mean), "ch").select("ch", "t", (F.col("x") - F.col("mean")).alias("x"))


def line_noise_removed(sig: DataFrame, rate: int, line: int = 50, copies: int = 50, window: int | None = None) -> DataFrame:
    """x minus the mean of `copies` samples one line period apart, around the end of the channel (window: of each stretch of so many samples by itself).

    Samples one period apart are neighbours in the order of their residue class, so one
    window function does it; the ends are continued by copies of the other end.
    """
    period, low, high = rate // line, copies // 2 - 1, copies - copies // 2
    cut = sig.select("ch", (F.floor(F.col("t") / window) if window else F.lit(0)).cast("long").alias("_win"), "t", "x")
    cut = cut.withColumn("_t", F.col("t") - F.col("_win") * (window or 0))
    n = cut.groupBy("ch", "_win").agg(F.count("*").alias("_n"))
    turns = F.sequence(F.ceil((-low * period - F.col("_t")) / F.col("_n")), F.floor((F.col("_n") + high * period - 1 - F.col("_t")) / F.col("_n")))
    wrapped = cut.join(F.broadcast(n) if window is None else n, ["ch", "_win"]).withColumn("_turn", F.explode(turns))
    at = F.col("_t") + F.col("_turn") * F.col("_n")
    near = Window.partitionBy("ch", "_win", F.pmod(at, F.lit(period))).orderBy(at).rowsBetween(-low, high)
    return wrapped.withColumn("_mean", F.avg("x").over(near)).where("_turn = 0").select("ch", "t", (F.col("x") - F.col("_mean")).alias("x"))


def positive_artifacts(sig: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(t): instants at which more than half of the channels exceed their threshold, or one exceeds twice of it."""
    x = sig.join(F.broadcast(thresholds), "ch")
    seen = x.groupBy("t").agg(F.sum((F.col("x") > F.col("threshold")).cast("int")).alias("over"), F.max(F.col("x") / F.col("threshold")).alias("most"), F.count("*").alias("channels"))
    return seen.where((F.col("over") * 2 > F.col("channels")) | (F.col("most") > 2)).select("t")


def fft_bandpass(sig: DataFrame, rate: float, low: float, high: float) -> DataFrame:
    """Bins outside low .. high of the transform of each whole channel are zeroed.

    A channel of n = rows * columns samples is transformed in steps: all columns, then, after
    a shuffle, all rows (where the bins are zeroed and the way back begins), then the columns
    again. So a task holds a column or a row, about the root of n if n has a divisor there;
    for n without divisors a row is the channel. sig: t counts from 0 without gaps.
    """
    n = sig.groupBy("ch").agg(F.count("*").alias("n"))
    split = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt("n"))), lambda i: F.col("n") % i == 0))
    sizes = F.broadcast(n.select("ch", "n", split.alias("rows")))  # a row a channel
    columns = F.floor(F.col("n") / F.col("rows"))
    cut = sig.join(sizes, "ch").select(F.col("ch").cast("string").alias("ch"), "n", "rows", (F.col("t") % columns).alias("column"), F.floor(F.col("t") / columns).alias("row"), F.col("x").cast("double").alias("re"), F.lit(0.0).alias("im"))

    def transformed(part: pa.Table, over: str, size: int) -> np.ndarray:
        values = np.zeros(size, complex)
        values[part[over].to_numpy()] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        return values

    def step(kernel: Callable[[np.ndarray, int, int, int], np.ndarray], by: str, over: str) -> Callable[[pa.Table], pa.Table]:
        def run(part: pa.Table) -> pa.Table:
            n, rows, place = (part[c][0].as_py() for c in ("n", "rows", by))
            out = kernel(transformed(part, over, rows if over == "row" else n // rows), n, rows, place)
            whole = lambda v: pa.array(np.full(len(out), v, np.int64))
            index = {by: whole(place), over: pa.array(np.arange(len(out)))}
            return pa.table({"ch": pa.array([part["ch"][0].as_py()] * len(out), pa.string()), "n": whole(n), "rows": whole(rows), "column": index["column"], "row": index["row"], "re": pa.array(out.real.copy()), "im": pa.array(out.imag.copy())})

        return run

    turn = lambda n, a, size, sign: np.exp(sign * 2j * np.pi * (a * np.arange(size) % n) / n)

    def forth(x: np.ndarray, n: int, rows: int, column: int) -> np.ndarray:
        return np.fft.fft(x) * turn(n, column, rows, -1)

    def middle(x: np.ndarray, n: int, rows: int, row: int) -> np.ndarray:
        bins = row + rows * np.arange(len(x))
        f = np.minimum(bins, n - bins) * rate / n
        kept = np.where((f < low) | (f > high), 0, np.fft.fft(x))
        return np.fft.ifft(kept) * turn(n, row, len(x), 1)

    def back(x: np.ndarray, n: int, rows: int, column: int) -> np.ndarray:
        return np.fft.ifft(x)

    schema = "ch string, n long, rows long, column long, row long, re double, im double"
    for kernel, by, over in ((forth, "column", "row"), (middle, "row", "column"), (back, "column", "row")):
        cut = cut.groupBy("ch", by).applyInArrow(step(kernel, by, over), schema)
    return cut.select("ch", (F.col("row") * F.floor(F.col("n") / F.col("rows")) + F.col("column")).alias("t"), F.col("re").alias("x"))


def butterworth(order: int, cutoff: float, kind: str = "high") -> Iterator[np.ndarray]:
    """Second-order sections (b, a) of a Butterworth filter; cutoff as a share of the Nyquist frequency; even order."""
    warped = np.tan(np.pi * cutoff / 2)
    for k in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order))
        a = np.array([1 + q * warped + warped**2, 2 * (warped**2 - 1), 1 - q * warped + warped**2])
        b = np.array([1.0, -2.0, 1.0]) if kind == "high" else warped**2 * np.array([1.0, 2.0, 1.0])
        yield np.stack([b, a]) / a[0]


#: Samples that a section of a filter takes at once.
BLOCK = 64


def run_section(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One section from the steady state of the first sample, block by block: the answer to a block is its own share by one product of matrices, and that of the two numbers carried over from before."""
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    enter = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    answer = np.array([b[0], *(p[0] @ enter for p in powers[: BLOCK - 1])])
    lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
    inside = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)
    carried = np.stack([p[0] for p in powers[:BLOCK]])
    into = np.stack([p @ enter for p in powers[BLOCK - 1 :: -1]])
    gain = b.sum() / a.sum()
    last = (b[2] - a[2] * gain) * x[0]
    state = np.array([(b[1] - a[1] * gain) * x[0] + last, last])
    blocks = np.pad(x, (0, -len(x) % BLOCK)).reshape(-1, BLOCK)
    entering, states = blocks @ into, np.empty((len(blocks), 2))
    for k, e in enumerate(entering):
        states[k] = state
        state = powers[BLOCK] @ state + e
    return (blocks @ inside.T + states @ carried.T).ravel()[: len(x)]


def zero_phase(x: np.ndarray, order: int, cutoff: float, kind: str = "high") -> np.ndarray:
    """Forward and backward, with odd extension at both ends."""
    pad = min(3 * (order + 1), len(x) - 1)
    if len(x) < 2:
        return np.zeros(len(x)) if kind == "high" else x
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in butterworth(order, cutoff, kind):
            y = run_section(b, a, y)
        y = y[::-1]
    return y[pad : len(y) - pad]


def reach(order: int, cutoff: float, kind: str = "high", left: float = 1e-13) -> int:
    """Samples after which a filter's answer has died down to the share `left`, by its slowest pole; twice as many, since sections and directions follow one another."""
    slowest = max(abs(np.roots(a)).max() for _, a in butterworth(order, cutoff, kind))
    return 2 * math.ceil(math.log(left) / math.log(slowest))


FILTERED = "ch string, k long, t0 long, x array<double>"


def filtered_chunks(sig: DataFrame, order: int, cutoff: float, kind: str, chunk: int, gain: float = 1.0, only: DataFrame | None = None) -> DataFrame:
    """FILTERED: zero-phase filtered chunks, each with as many samples around it as the filter reaches, so they are those of the whole filter."""
    rows = sections(sig, chunk, reach(order, cutoff, kind), only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lead, own = b["lead"][i].as_py(), b["own"][i].as_py()
                y = zero_phase(b["x"][i].values.to_numpy(), order, cutoff, kind)[lead : lead + own] / gain
                yield pa.record_batch({"ch": b["ch"].slice(i, 1), "k": b["k"].slice(i, 1), "t0": b["t0"].slice(i, 1), "x": pa.array([y])})

    return rows.select(F.col("ch").cast("string").alias("ch"), "k", "t0", "lead", "own", "x").mapInArrow(run, FILTERED)


def samples_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("ch", "t0", F.posexplode("x").alias("i", "x")).select("ch", (F.col("t0") + F.col("i")).alias("t"), "x")


def highpass(sig: DataFrame, low: float = 500.0, high: float = 10_000.0, rate: float = 30_000.0, cutoff: str = "reference", chunk: int = 8192) -> DataFrame:
    """4th-order zero-phase high-pass. cutoff: 'reference' normalises by `high`, 'nyquist' by half the rate."""
    return samples_of(filtered_chunks(sig, 4, low / high if cutoff == "reference" else low / (rate / 2), "high", chunk))


def filter_into(sig: DataFrame, path: str, cutoff: float, kind: str = "high", order: int = 4, chunk: int = 8192, gain: float = 1.0, at_once: int = 4096, most: int | None = None) -> DataFrame:
    """Filter sig into a Parquet table at `path`, FILTERED, chunk by chunk, and read it back.

    Chunks are appended in commits of `at_once` chunks a channel, and those the table already
    has aren't done again; so a run that was stopped goes on where it was. most: commits of
    this run, at most.
    """
    spark = sig.sparkSession
    count = F.floor((F.max("t") - F.min("t")) / chunk)
    wanted = sig.groupBy(F.col("ch").cast("string").alias("ch")).agg(count.alias("n")).select("ch", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("k"))
    try:
        done = spark.read.schema(FILTERED).parquet(path)
        todo = wanted.join(done.select("ch", "k"), ["ch", "k"], "left_anti")
    except AnalysisException:  # no table yet
        todo = wanted
    todo = materialise(todo, "filter-todo")
    runs = [r["run"] for r in todo.select(F.floor(F.col("k") / at_once).alias("run")).distinct().orderBy("run").collect()]  # a row a commit
    for run in runs[:most]:
        filtered_chunks(sig, order, cutoff, kind, chunk, gain, todo.where(F.floor(F.col("k") / at_once) == run)).write.mode("append").parquet(path)
    return spark.read.schema(FILTERED).parquet(path)


def lowpass_taps(cutoff: float, taps: int) -> list[float]:
    """A windowed sinc (Hamming) whose taps sum up to 1; cutoff as a share of the Nyquist frequency."""
    at = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(cutoff * at) * np.hamming(taps)
    return (h / h.sum()).tolist()


def fir(sig: DataFrame, taps: list[float], factor: int = 1, ahead: int = 0, whole: bool = False) -> DataFrame:
    """(ch, t, x): every `factor`-th value of x filtered by taps, t numbered anew; y[m] is the sum of taps[j] * x[m * factor + ahead - j].

    Only the values that are kept are summed up, in tasks before the shuffle. Samples beyond
    the ends are zero; whole: the taps that met samples are scaled to the sum of all.
    sig: t counts from 0.
    """
    n, h = len(taps), F.array(*map(F.lit, taps))
    ends = sig.groupBy("ch").agg(F.max("t").alias("_high"))  # a row a channel
    low = F.greatest(F.ceil((F.col("t") - ahead) / factor), F.lit(0))
    high = F.least(F.floor((F.col("t") - ahead + n - 1) / factor), F.floor(F.col("_high") / factor))
    met = sig.join(F.broadcast(ends), "ch").where(low <= high).select("ch", "t", "x", F.explode(F.sequence(low, high)).alias("m"))
    weight = F.get(h, (F.col("m") * factor + ahead - F.col("t")).cast("int"))
    sums = met.groupBy("ch", F.col("m").alias("t")).agg(F.sum(weight * F.col("x")).alias("x"), F.sum(weight).alias("_w"))
    return sums.select("ch", "t", (F.col("x") / F.col("_w") * sum(taps) if whole else F.col("x")).alias("x"))


def lowpass_decimated(sig: DataFrame, rate: float, low: float, to: float = 1000.0, taps: int | None = None) -> DataFrame:
    """Low-pass at `low` Hz, at a rate of about `to`: a linear-phase filter of which only the kept values are computed."""
    factor = max(1, int(rate // to))
    n = taps or 8 * factor + 1
    return fir(sig, lowpass_taps(low / (rate / 2), n), factor, (n - 1) // 2, whole=True)


#: The scaling filter of the Daubechies wavelet with two vanishing moments.
DB2 = [(1 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 + math.sqrt(3)) / (4 * math.sqrt(2)), (3 - math.sqrt(3)) / (4 * math.sqrt(2)), (1 - math.sqrt(3)) / (4 * math.sqrt(2))]


def wavelet(levels: int = 10) -> np.ndarray:
    """The db2 wavelet at steps of 2**-levels over [0, 3], by the cascade algorithm from the scaling function at whole numbers."""
    phi = np.array([0.0, (1 + math.sqrt(3)) / 2, (1 - math.sqrt(3)) / 2, 0.0])

    def refined(f: np.ndarray, filter_: list[float]) -> np.ndarray:
        """sqrt(2) * sum of filter[k] * f(2 x - k), on a grid of half the step."""
        n = len(f) - 1
        at = np.arange(2 * n + 1)
        out = np.zeros(2 * n + 1)
        for k, c in enumerate(filter_):
            place = at - k * (n // 3)
            inside = (place >= 0) & (place <= n)
            out[inside] += math.sqrt(2) * c * f[place[inside]]
        return out

    for _ in range(levels - 1):
        phi = refined(phi, DB2)
    return refined(phi, [(-1) ** k * c for k, c in enumerate(reversed(DB2))])


def wavelet_taps(levels: int = 10) -> list[float]:
    """The continuous transform at scale 1 as a filter: differences of the wavelet's integral at whole numbers, the last first."""
    psi = wavelet(levels)
    step = 2.0**-levels
    sums = (np.cumsum(psi) * step)[:: 1 << levels]
    f = np.concatenate([[0.0], sums[::-1], [0.0]])
    return (-np.diff(f)).tolist()


def with_wavelet(sig: DataFrame, suffix: str = "_wavelet") -> DataFrame:
    """sig with a channel more for each: its continuous wavelet transform at scale 1."""
    made = fir(sig, wavelet_taps(), ahead=2)
    return sig.select("ch", "t", F.col("x").cast("double").alias("x")).union(made.select(F.concat("ch", F.lit(suffix)), "t", "x"))
