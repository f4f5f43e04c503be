"""Registered queries over the test tables, each with the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views as v
from ..functions import split_state
from ..operators import signals, trains, waves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MINUTE, HOUR = 60_000_000, 3_600_000_000


def query(sql: str | None = None, *views: str, also: str | None = None):
    """Register a query under its name, and maybe another one. views: those that the SQL reads."""

    def put(f):
        for name in filter(None, (f.__name__, also)):
            if name in QUERIES:
                raise ValueError(f"there is a query {name}")
            QUERIES[name] = f
            if sql is not None:
                SQL[name] = ("WITH " + ", ".join(v.SQL[x] for x in views) + sql) if views else sql
        return f

    return put


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})  # no negative zero


@query(" SELECT ch, round(median(abs(x)) / 0.6745, 6) AS scale FROM sig GROUP BY ch", "sig")
def channel_mad(s, d):
    return rounded(signals.mad_scale(v.sig(s, d)), "scale")


THRESHOLD = ", sd AS (SELECT ch, stddev_pop(x) AS sd FROM sig GROUP BY ch), thr AS (SELECT sig.ch, {k} * stddev_pop(x) AS threshold, avg(x) AS mean FROM sig JOIN sd ON sig.ch = sd.ch WHERE abs(x) < {k} * sd GROUP BY sig.ch)"
TROUGH = ", around AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM sig WINDOW w AS (PARTITION BY ch ORDER BY t)), trough AS (SELECT ch, t, x FROM around WHERE sign(a - x) - sign(x - b) > 0)"
SPIKES = THRESHOLD.format(k=3) + TROUGH + ", ends AS (SELECT ch, max(t) + 1 AS samples FROM sig GROUP BY ch), spikes AS (SELECT trough.ch, t, x FROM trough JOIN thr ON trough.ch = thr.ch JOIN ends ON trough.ch = ends.ch WHERE x < -threshold AND t >= 10 AND t < samples - 32)"


@query(THRESHOLD.format(k=6) + " SELECT ch, round(threshold, 6) AS threshold, round(mean, 6) AS mean FROM thr", "sig")
def robust_threshold(s, d):
    return rounded(signals.robust_threshold(v.sig(s, d)), "threshold", "mean")


@query(
    """, f AS (SELECT *, t // 500 AS file FROM sig), sd AS (SELECT file, ch, stddev_pop(x) AS sd FROM f GROUP BY ALL),
kept AS (SELECT f.ch, x FROM f JOIN sd ON f.ch = sd.ch AND f.file = sd.file WHERE abs(x) < 4 * sd)
SELECT ch, round(4 * sqrt(avg(x * x) - avg(x) * avg(x)), 6) AS threshold FROM kept GROUP BY ch""",
    "sig",
)
def session_threshold(s, d):
    return rounded(signals.session_threshold(v.sig(s, d).withColumn("file", F.floor(F.col("t") / 500))), "threshold")


@query(TROUGH + " SELECT * FROM trough", "sig")
def detect_troughs(s, d):
    return signals.troughs(v.sig(s, d))


@query(SPIKES + " SELECT * FROM spikes", "sig")
def detect_spikes(s, d):
    return signals.spikes(v.sig(s, d), 3.0)


@query(SPIKES + " SELECT spikes.ch, spikes.t, sig.t - spikes.t + 10 AS pos, sig.x FROM spikes JOIN sig ON spikes.ch = sig.ch AND sig.t BETWEEN spikes.t - 10 AND spikes.t + 21", "sig")
def snippets(s, d):
    sig = v.sig(s, d)
    return signals.snippets(sig, signals.spikes(sig, 3.0))


POSITIVE = ", pos AS (SELECT ch, t, -x AS x FROM sig), lim AS (SELECT ch, stddev_pop(x) AS threshold FROM pos GROUP BY ch), seen AS (SELECT t, sum((x > threshold)::INT) AS over_, max(x / threshold) AS most, count(*) AS channels FROM pos JOIN lim ON pos.ch = lim.ch GROUP BY t)"


@query(POSITIVE + " SELECT t FROM seen WHERE over_ * 2 > channels OR most > 2", "sig")
def positive_artifacts(s, d):
    sig = v.sig(s, d).withColumn("x", -F.col("x"))
    return signals.positive_artifacts(sig, sig.groupBy("ch").agg(F.stddev_pop("x").alias("threshold")))


@query(" SELECT ch, t, round(x - avg(x) OVER (PARTITION BY ch), 6) AS x FROM sig", "sig")
def mean_removed(s, d):
    return rounded(signals.mean_removed(v.sig(s, d)), "x")


@query(", n AS (SELECT ch, count(*) AS n FROM sig GROUP BY ch), moved AS (SELECT sig.ch, t, x, (((t + k * 4) % n) + n) % n AS y FROM sig JOIN n ON sig.ch = n.ch, range(-24, 26) r(k)) SELECT moved.ch, moved.t, round(any_value(moved.x) - avg(sig.x), 6) AS x FROM moved JOIN sig ON moved.ch = sig.ch AND moved.y = sig.t GROUP BY moved.ch, moved.t", "sig")
def line_noise(s, d):
    return rounded(signals.line_noise_removed(v.sig(s, d), 200), "x")


ISI = ", isi AS (SELECT unit, us - lag(us) OVER (PARTITION BY unit ORDER BY us, spike) AS isi FROM train QUALIFY isi IS NOT NULL)"


@query(ISI + " SELECT unit, count(*) AS n, min(isi) AS shortest, max(isi) AS longest, sum(isi)::BIGINT AS total FROM isi GROUP BY unit", "train")
def isi_stats(s, d):
    return trains.isi_stats(v.train(s, d))


@query(ISI + ", l AS (SELECT unit, round(ln(isi / 1000), 9) AS x FROM isi WHERE isi > 0), e AS (SELECT unit, min(x) AS lo, max(x) AS hi FROM l GROUP BY unit) SELECT l.unit, CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 100)), 99) END::BIGINT AS bin, count(*) AS n FROM l JOIN e ON l.unit = e.unit GROUP BY ALL", "train")
def isi_hist(s, d):
    return trains.isi_histogram(v.train(s, d))


COUNTS = f", e AS (SELECT unit, min(us) AS a, max(us) AS z FROM train GROUP BY unit), w AS (SELECT unit, unnest(range(0, (z - a) // {6 * HOUR} + 1)) AS w FROM e), c AS (SELECT train.unit, (us - a) // {6 * HOUR} AS w, count(*) AS n FROM train JOIN e ON train.unit = e.unit GROUP BY ALL), counts AS (SELECT w.unit, w.w, coalesce(n, 0) AS n FROM w LEFT JOIN c ON w.unit = c.unit AND w.w = c.w)"


@query(COUNTS + " SELECT * FROM counts", "train")
def spike_counts(s, d):
    return trains.spike_counts(v.train(s, d), 6 * HOUR)


@query(COUNTS + " SELECT unit, n AS spikes, count(*) AS windows FROM counts GROUP BY ALL", "train")
def count_dist(s, d):
    return trains.count_distribution(v.train(s, d), 6 * HOUR)


CORR = f" SELECT a.unit AS unit1, b.unit AS unit2, floor((a.us - b.us) / {MINUTE})::BIGINT AS bin, count(*) AS n FROM train a JOIN train b ON a.us - b.us < {10 * MINUTE} AND a.us - b.us > -{10 * MINUTE} AND "


@query(CORR + "a.unit = b.unit AND a.spike <> b.spike GROUP BY ALL", "train")
def autocorr(s, d):
    return trains.correlogram(v.train(s, d), 10 * MINUTE, MINUTE, auto=True)


@query(CORR + "a.unit < b.unit GROUP BY ALL", "train")
def crosscorr(s, d):
    return trains.correlogram(v.train(s, d), 10 * MINUTE, MINUTE)


ALONE = " SELECT * FROM train a WHERE {no} EXISTS (SELECT 1 FROM train b WHERE b.unit <> a.unit AND a.us - b.us < {w} AND a.us - b.us > -{w})"


@query(ALONE.format(no="NOT", w=MINUTE), "train")
def unique_spikes(s, d):
    return trains.isolated(v.train(s, d), MINUTE)


@query(ALONE.format(no="NOT", w=10 * MINUTE), "train")
def nonoverlap_spikes(s, d):
    return trains.isolated(v.train(s, d), 10 * MINUTE)


@query(ALONE.format(no="", w=10 * MINUTE), "train")
def overlap_spikes(s, d):
    return trains.overlapping(v.train(s, d), 10 * MINUTE)


@query(" SELECT DISTINCT CASE WHEN unit IN ('click', 'view') THEN 'merged' ELSE unit END AS unit, us FROM train", "train")
def merge_units(s, d):
    return trains.merge_units(v.train(s, d), {"click": "merged", "view": "merged"})


BAND = ", band AS (SELECT unit, pos, avg(v) AS mean, stddev_pop(v) AS sd, count(*) AS n FROM wave GROUP BY unit, pos)"


@query(BAND + " SELECT unit, pos, round(mean, 6) AS mean, round(sd, 6) AS sd, n FROM band", "wave")
def waveform_band(s, d):
    return rounded(waves.template_band(v.wave(s, d)), "mean", "sd")


@query(BAND + " SELECT unit, round(sum(mean * mean), 6) AS energy, round(max(mean * mean), 6) AS largest FROM band GROUP BY unit", "wave")
def template_energy(s, d):
    return rounded(waves.template_energy(v.wave(s, d)), "energy", "largest")


@query(", c AS (SELECT unit, count(DISTINCT spike) AS n FROM wave GROUP BY unit) SELECT * FROM c WHERE n > 0.1 * (SELECT sum(n) FROM c)", "wave")
def remove_sparse(s, d):
    return waves.remove_sparse(v.wave(s, d), 0.1)


@query(BAND + ", p AS (SELECT ch, t // 64 AS p, sum(x * x) / 1e10 AS e FROM sig GROUP BY ALL HAVING count(*) = 64), u AS (SELECT unit, sum(mean * mean) AS energy FROM band GROUP BY unit) SELECT unit, round(energy, 6) AS energy FROM u WHERE energy >= (SELECT median(e) FROM p)", "wave", "sig")
def remove_noise(s, d):
    return rounded(waves.remove_noise(v.wave(s, d), v.sig(s, d).withColumn("x", F.col("x") / 100_000), 64, 1.0), "energy")


@query(BAND + " SELECT a.unit AS unit1, b.unit AS unit2, round(sum((a.mean - b.mean) ** 2) / (1 / least(min(a.n), 12) + 1 / least(min(b.n), 12)), 6) AS stat FROM band a JOIN band b ON a.pos = b.pos AND a.unit < b.unit GROUP BY ALL", "wave")
def merge_stat(s, d):
    return rounded(waves.merge_statistic(v.wave(s, d)), "stat")


@query(BAND + ", dist AS (SELECT spike, w.unit AS own, b.unit, b.n, sum((v - mean) ** 2) AS d FROM wave w JOIN band b ON w.pos = b.pos GROUP BY ALL), far AS (SELECT unit, max(d) AS far FROM dist WHERE own = unit GROUP BY unit), r AS (SELECT unit, n, d, row_number() OVER (PARTITION BY unit ORDER BY d, spike) AS r FROM dist WHERE own <> unit) SELECT r.unit, round(d / far, 6) AS ratio FROM r JOIN far ON r.unit = far.unit WHERE r = n", "wave")
def isolation_distance(s, d):
    return rounded(waves.isolation_distance(v.wave(s, d)), "ratio")


@query(BAND + ", q AS (SELECT a.unit AS unit1, b.unit AS unit2, a.pos, round((a.mean - b.mean) ** 2, 9) AS d FROM band a JOIN band b ON a.pos = b.pos AND a.unit < b.unit), three AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY unit1, unit2 ORDER BY d DESC, pos) <= 3) SELECT unit1, unit2, min(pos) AS p1, sum(pos)::BIGINT - min(pos) - max(pos) AS p2, max(pos) AS p3 FROM three GROUP BY unit1, unit2 HAVING count(*) = 3", "wave", also="best_projection")
def best_projection_all(s, d):
    return waves.best_projection_all(v.wave(s, d))


@query(BAND + ", t AS (SELECT * FROM band WHERE unit <> 0), m AS (SELECT a.unit AS unit1, b.unit AS unit2, s, a.pos, a.mean + b.mean AS m FROM t a JOIN t b ON a.unit < b.unit, range(-3, 4) r(s) WHERE a.pos = b.pos + s), e AS (SELECT spike, unit1, unit2, s AS shift, round(avg((v - m) ** 2), 9) AS sse FROM wave JOIN m ON wave.pos = m.pos WHERE wave.unit = 0 GROUP BY ALL) SELECT spike, unit1, unit2, shift, sse FROM e QUALIFY row_number() OVER (PARTITION BY spike ORDER BY sse, unit1, unit2, shift) = 1", "wave")
def resolve_overlaps(s, d):
    return waves.resolve_overlaps(v.wave(s, d))


@query(" SELECT gr_nr, ch_nr, row_number() OVER (PARTITION BY gr_nr ORDER BY ch_nr) - 1 AS idx FROM chan WHERE active AND gr_nr > 0", "chan")
def group_channels(s, d):
    from pyspark.sql import Window

    return v.chan(s, d).where("active AND gr_nr > 0").select("gr_nr", "ch_nr", (F.row_number().over(Window.partitionBy("gr_nr").orderBy("ch_nr")) - 1).cast("long").alias("idx"))


@query(" SELECT DISTINCT gr_nr FROM chan WHERE active AND gr_nr NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0)", "chan")
def pending_groups(s, d):
    done = v.table(s, d, "region").where("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("gr_nr"))
    return v.chan(s, d).where("active").select("gr_nr").distinct().join(done, "gr_nr", "left_anti")


FILES = "files AS (SELECT o_custkey AS series, year(o_orderdate)::BIGINT * 12 + month(o_orderdate) AS number, count(*) AS n FROM orders GROUP BY ALL)"


def files(s, d):
    when = F.col("o_orderdate")
    return v.table(s, d, "orders").groupBy(F.col("o_custkey").alias("series"), (F.year(when).cast("long") * 12 + F.month(when)).alias("number")).agg(F.count("*").alias("n"))


@query("WITH " + FILES + ", g AS (SELECT series, number, lead(number) OVER (PARTITION BY series ORDER BY number) AS nx FROM files) SELECT series, unnest(range(number + 1, nx)) AS number FROM g WHERE nx - number > 1")
def missing_files(s, d):
    return trains.missing_numbers(files(s, d))


@query("WITH " + FILES + ", g AS (SELECT *, n * coalesce(lead(number) OVER w - number, 1) AS span FROM files WINDOW w AS (PARTITION BY series ORDER BY number)) SELECT series, number, n, coalesce(sum(span) OVER (PARTITION BY series ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM g")
def file_offsets(s, d):
    return trains.file_offsets(files(s, d))


@query("SELECT o_orderkey AS joint, o_orderkey % 45 AS s0, (o_orderkey // 45) % 45 AS s1, (o_orderkey // 2025) % 45 AS s2 FROM orders")
def split_states(s, d):
    s0, s1, s2 = split_state(F.col("o_orderkey"), 45, 3)
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("joint"), s0.alias("s0"), s1.alias("s1"), s2.alias("s2"))


#: Two short templates for the decoding queries, in units of a channel's scale.
DEMO = np.array([[-1.0, -3.0, -2.0, 0.5], [-2.0, -1.0, -4.0, -1.0]])


def scaled(s, d):
    sig = v.sig(s, d)
    return sig.join(F.broadcast(signals.mad_scale(sig)), "ch").select("ch", "t", (F.col("x") / F.col("scale")).alias("x"))


from . import decoding, recorded, selection, sessions  # noqa: E402, F401  (register their queries here)
