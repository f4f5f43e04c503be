"""Queries over whole sessions and between them, over the same views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as v
from ..functions import numeric_suffix, popcount
from ..operators import channels, sessions, trains, waves
from . import BAND, CORR, HOUR, MINUTE, SPIKES, query, rounded

#: Trains by session, waveforms with a time, in both languages.
v.SQL["sess"] = "sess AS (SELECT event_type AS unit, user_id % 3 AS session, epoch_us(ts) AS us, event_id AS spike FROM events)"
v.SQL["flag"] = "spk AS (SELECT vec_id AS spike, label AS unit, (vec_id * 37) % 9973 AS us FROM embeddings), flag AS (SELECT spike, EXISTS (SELECT 1 FROM spk b WHERE b.unit <> a.unit AND abs(a.us - b.us) < 5) AS near FROM spk a)"


def sess(s, d):
    return v.table(s, d, "events").select(F.col("event_type").alias("unit"), (F.col("user_id") % 3).alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("spike"))


@query(" SELECT ch, t, round(x / 5000.0, 9) + 0.0 AS x FROM sig", "sig")
def gain_divided(s, d):
    return rounded(v.sig(s, d).withColumn("x", F.col("x") / 5000.0), "x", digits=9)


@query(BAND + " SELECT unit, pos, round(mean, 6) + 0.0 AS mean FROM band WHERE unit IN (SELECT DISTINCT unit FROM band ORDER BY unit LIMIT 5)", "wave")
def template_cap(s, d):
    return rounded(sessions.capped(waves.template_band(v.wave(s, d)), 5).select("unit", "pos", "mean"), "mean")


@query(" SELECT DISTINCT unit FROM train WHERE unit NOT IN ('click', 'view')", "train")
def selected_not_merged(s, d):
    merged = s.createDataFrame([("click",), ("view",)], "unit string")
    return v.train(s, d).select("unit").subtract(merged)


@query(
    """ SELECT unit, pos, round(avg(v), 6) + 0.0 AS mean_all, round(stddev_pop(v), 6) AS sd_all, round(avg(v) FILTER (WHERE NOT near), 6) + 0.0 AS mean_alone, round(stddev_pop(v) FILTER (WHERE NOT near), 6) AS sd_alone,
round(avg(v) FILTER (WHERE near), 6) + 0.0 AS mean_overlap, round(stddev_pop(v) FILTER (WHERE near), 6) AS sd_overlap FROM wave JOIN flag USING (spike) GROUP BY unit, pos""",
    "wave",
    "flag",
)
def waveform_subsets(s, d):
    spikes = v.table(s, d, "embeddings").select(F.col("vec_id").alias("spike"), F.col("label").alias("unit"), ((F.col("vec_id") * 37) % 9973).alias("us"))
    flagged = sessions.near_other(spikes, "us", 5, "unit").select("spike", "near")
    return rounded(sessions.band_subsets(v.wave(s, d), flagged), *(f"{m}_{k}" for m in ("mean", "sd") for k in ("all", "alone", "overlap")))


@query(" SELECT unit, round(count(DISTINCT spike) / 30000, 9) AS p, round(count(DISTINCT spike) / 30000 * 30000, 6) AS spikes FROM wave GROUP BY unit", "wave")
def spikes_per_template(s, d):
    return rounded(rounded(sessions.spikes_per_template(v.wave(s, d), 30_000), "p", digits=9), "spikes")


@query(BAND + " SELECT unit, round(max(mean * mean) / (SELECT var_pop(v) FROM wave), 6) AS amplitude FROM band GROUP BY unit", "wave")
def mahalanobis_amplitude(s, d):
    return rounded(sessions.mahalanobis_amplitude(v.wave(s, d)), "amplitude")


@query(BAND + ", l AS (SELECT unit, arg_min(pos, (round(mean, 9), pos)) AS low FROM band GROUP BY unit) SELECT unit, (pos - low + 10 + 64) % 64 AS pos, round(mean, 6) + 0.0 AS mean FROM band JOIN l USING (unit)", "wave")
def rolled_templates(s, d):
    return rounded(sessions.rolled_to_trough(v.wave(s, d)), "mean")


@query(
    """ , w AS (SELECT spike, unit, dense_rank() OVER (ORDER BY spike) - 1 AS idx FROM wave), c AS (SELECT c_nationkey AS cut, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer)
SELECT DISTINCT spike, cut, gr_nr FROM w JOIN c USING (idx) JOIN chan ON cut = ch_nr""",
    "wave",
    "chan",
)
def waveform_units(s, d):
    """Unit and channel group of each waveform by its position in the file and in the list of units."""
    place = lambda df, key: sessions.numbered(df.withColumn("_all", F.lit(0)), "_all", F.col(key), [], 1000, "idx").drop("_all")
    spikes = place(v.table(s, d, "embeddings").select(F.col("vec_id").alias("spike")), "spike")
    cut = place(v.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("cut")), "c_custkey")
    return spikes.join(cut, "idx").join(v.chan(s, d).select(F.col("ch_nr").alias("cut"), "gr_nr"), "cut").select("spike", "cut", "gr_nr")


@query("SELECT n_name || '.' || n_nationkey AS file, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")
def files_in_order(s, d):
    from pyspark.sql import Window

    files = v.table(s, d, "nation").select(F.concat_ws(".", "n_name", "n_nationkey").alias("file"))
    return files.withColumn("place", (F.row_number().over(Window.orderBy(numeric_suffix(F.col("file")))) - 1).cast("long"))  # one row a file


@query("WITH " + v.SQL["train"] + ", h AS (" + CORR + "a.unit < b.unit GROUP BY ALL) SELECT unit1, unit2, bin, round(n / sum(n) OVER (PARTITION BY unit1, unit2) / 60, 9) AS density FROM h")
def crosscorr_density(s, d):
    out = sessions.correlogram_density(v.train(s, d), 10 * MINUTE, MINUTE)
    return rounded(out.withColumn("density", F.col("density") * 1_000_000), "density", digits=9)


S_ISI = ", isi AS (SELECT unit, session, us - lag(us) OVER (PARTITION BY unit, session ORDER BY us, spike) AS isi FROM sess QUALIFY isi IS NOT NULL), l AS (SELECT unit, session, round(ln(isi / 1000), 9) AS x FROM isi WHERE isi > 0), e AS (SELECT unit, session, min(x) AS lo, max(x) AS hi FROM l GROUP BY ALL)"


@query(S_ISI + " SELECT unit, session, CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 100)), 99) END::BIGINT AS bin, count(*) AS n FROM l JOIN e USING (unit, session) GROUP BY ALL", "sess")
def isi_sessions(s, d):
    return sessions.by_session(sess(s, d), trains.isi_histogram)


@query(
    f""", e AS (SELECT unit, session, min(us) AS a, max(us) AS z FROM sess GROUP BY ALL), w AS (SELECT unit, session, unnest(range(0, (z - a) // {6 * HOUR} + 1)) AS w FROM e),
c AS (SELECT unit, session, (us - a) // {6 * HOUR} AS w, count(*) AS n FROM sess JOIN e USING (unit, session) GROUP BY ALL), counts AS (SELECT unit, session, coalesce(n, 0) AS n FROM w LEFT JOIN c USING (unit, session, w))
SELECT unit, session, n AS spikes, count(*) AS windows FROM counts GROUP BY ALL""",
    "sess",
)
def count_sessions(s, d):
    return sessions.by_session(sess(s, d), trains.count_distribution, 6 * HOUR)


@query(
    """, old AS (SELECT unit, pos, avg(v) AS mean FROM wave WHERE spike % 2 = 0 GROUP BY ALL), new AS (SELECT * FROM wave WHERE spike % 2 = 1), var AS (SELECT pos, var_pop(v) AS var FROM new GROUP BY pos),
d AS (SELECT spike, old.unit, round(sum((v - mean) ** 2 / var), 6) AS distance FROM new JOIN old USING (pos) JOIN var USING (pos) WHERE var > 0 GROUP BY ALL)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY spike ORDER BY distance, unit) = 1""",
    "wave",
)
def sorted_by_session(s, d):
    wave = v.wave(s, d)
    return sessions.sorted_by_session(wave.where("spike % 2 = 0"), wave.where("spike % 2 = 1"))


@query(" SELECT *, NOT EXISTS (SELECT 1 FROM train b WHERE b.unit <> a.unit AND abs(a.us - b.us) < {u}) AS is_unique, NOT EXISTS (SELECT 1 FROM train b WHERE b.unit <> a.unit AND abs(a.us - b.us) < {w}) AS is_alone FROM train a".format(u=MINUTE, w=10 * MINUTE), "train")
def processed_trains(s, d):
    return sessions.processed(v.train(s, d), MINUTE, 10 * MINUTE)


@query(
    SPIKES
    + """, pos AS (SELECT ch, t, x FROM sig), seen AS (SELECT t, sum((x > threshold)::INT) AS over_, max(x / threshold) AS most, count(*) AS channels FROM pos JOIN thr USING (ch) GROUP BY t),
good AS (SELECT * FROM spikes WHERE t NOT IN (SELECT t FROM seen WHERE over_ * 2 > channels OR most > 2))
SELECT good.ch, good.t, round(any_value(threshold), 6) AS threshold, round(any_value(mean), 6) + 0.0 AS mean, list(round(sig.x, 6) ORDER BY sig.t)::VARCHAR AS shape FROM good JOIN thr ON good.ch = thr.ch JOIN sig ON good.ch = sig.ch AND sig.t BETWEEN good.t - 10 AND good.t + 21 GROUP BY good.ch, good.t""",
    "sig",
)
def extracted_spikes(s, d):
    out = rounded(sessions.extract(v.sig(s, d), 3.0), "threshold", "mean")
    text = lambda x: F.when((F.round(x, 6) == 0) & x.cast("string").startswith("-"), "-0.0").otherwise(F.round(x, 6).cast("string"))  # round() drops the sign of zero
    return out.withColumn("shape", F.concat(F.lit("["), F.array_join(F.transform("shape", text), ", "), F.lit("]")))


@query(
    """, f AS (SELECT ch, t // 500 AS file, t % 500 AS t, x FROM sig), sd AS (SELECT file, ch, stddev_pop(x) AS sd FROM f GROUP BY ALL), kept AS (SELECT f.ch, x FROM f JOIN sd USING (file, ch) WHERE abs(x) < 1.2 * sd),
thr AS (SELECT ch, 1.2 * sqrt(avg(x * x) - avg(x) * avg(x)) AS threshold FROM kept GROUP BY ch),
around AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM f WINDOW w AS (PARTITION BY file, ch ORDER BY t)), trough AS (SELECT * FROM around WHERE sign(a - x) - sign(x - b) > 0),
n AS (SELECT file, max(t) + 1 AS n FROM f GROUP BY file), o AS (SELECT file, n, coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM n)
SELECT trough.file, trough.ch, t + offset_ AS t, x FROM trough JOIN thr USING (ch) JOIN o USING (file) WHERE x < -threshold AND t >= 10 AND t < n - 32""",
    "sig",
)
def session_spikes(s, d):
    sig = v.sig(s, d).select("ch", F.floor(F.col("t") / 500).alias("file"), (F.col("t") % 500).alias("t"), "x")
    return sessions.session_spikes(sig, 1.2)


@query(" SELECT ch, t * 4 + j AS t, round(x + coalesce(a - x, 0) * j / 4, 6) + 0.0 AS x FROM (SELECT *, lead(x) OVER (PARTITION BY ch ORDER BY t) AS a FROM sig), range(4) r(j) WHERE a IS NOT NULL OR j = 0", "sig")
def upsampled_signal(s, d):
    return rounded(sessions.upsampled(v.sig(s, d), 4), "x")


@query("SELECT o_orderkey, bit_count(o_orderkey)::INT AS ones FROM orders")
def active_rings(s, d):
    return v.table(s, d, "orders").select("o_orderkey", popcount(F.col("o_orderkey")).alias("ones"))


@query(
    """, w AS (SELECT ch, t // 200 AS win, t % 200 AS t, x FROM sig), n AS (SELECT ch, win, count(*) AS n FROM w GROUP BY ALL),
moved AS (SELECT w.ch, w.win, t, x, (((t + k * 4) % n) + n) % n AS y FROM w JOIN n USING (ch, win), range(-24, 26) r(k))
SELECT moved.ch, moved.win * 200 + moved.t AS t, round(any_value(moved.x) - avg(w.x), 6) + 0.0 AS x FROM moved JOIN w ON w.ch = moved.ch AND w.win = moved.win AND w.t = moved.y GROUP BY ALL""",
    "sig",
)
def line_noise_windows(s, d):
    from ..operators import signals

    return rounded(signals.line_noise_removed(v.sig(s, d), 200, window=200), "x")


@query(
    BAND
    + """, t AS (SELECT * FROM band WHERE unit <> 0), k AS (SELECT s FROM range(-3, 4) r(s)), u AS (SELECT DISTINCT unit FROM t),
q AS (SELECT a.unit AS unit1, b.unit AS unit2, i.s AS shift1, j.s AS shift2, p.pos, coalesce(m.mean, 0) + coalesce(n.mean, 0) AS m
FROM u a JOIN u b ON a.unit < b.unit, k i, k j, (SELECT DISTINCT pos FROM wave) p LEFT JOIN t m ON m.unit = a.unit AND m.pos = p.pos - i.s LEFT JOIN t n ON n.unit = b.unit AND n.pos = p.pos - j.s),
z AS (SELECT spike, wave.pos, m.mean + n.mean + 0.05 * v AS v FROM wave JOIN t m ON m.unit = spike % 9 + 1 AND m.pos = wave.pos JOIN t n ON n.unit = (spike + 4) % 9 + 1 AND n.pos = wave.pos WHERE wave.unit = 0),
e AS (SELECT spike, unit1, unit2, shift1, shift2, round(sum((v - m) ** 2) / sum(m * m), 9) AS score FROM z JOIN q ON z.pos = q.pos GROUP BY ALL)
SELECT spike, unit1, unit2, shift1, shift2, round(score, 6) AS score FROM e WHERE score < 0.05 QUALIFY row_number() OVER (PARTITION BY spike ORDER BY score, unit1, unit2, shift1, shift2) = 1""",
    "wave",
)
def accepted_overlaps(s, d):
    """Waveforms of unit 0 become sums of two units' means, with a twentieth of their own."""
    wave = v.wave(s, d)
    mean = waves.template_band(wave).where("unit <> 0").select("unit", "pos", "mean")
    one, two = (mean.select(F.col("unit").alias(f"u{k}"), "pos", F.col("mean").alias(f"m{k}")) for k in (1, 2))
    lone = wave.where("unit = 0").withColumn("u1", F.col("spike") % 9 + 1).withColumn("u2", (F.col("spike") + 4) % 9 + 1)
    summed = lone.join(one, ["u1", "pos"]).join(two, ["u2", "pos"]).select("spike", "unit", "pos", (F.col("m1") + F.col("m2") + 0.05 * F.col("v")).alias("v"))
    return rounded(waves.accepted_overlaps(wave.where("unit <> 0").union(summed)), "score")


@query(" SELECT unit, spike - 1 AS spike FROM (SELECT unit, dense_rank() OVER (ORDER BY us // 1000000) AS spike FROM train GROUP BY unit, us // 1000000)", "train")
def overlap_index(s, d):
    """Spikes in the same second are one instant."""
    return channels.overlap_index(v.train(s, d).select("unit", F.floor(F.col("us") / 1_000_000).alias("t")), 86_400)


@query(
    SPIKES
    + """, cells AS (SELECT DISTINCT ch, CASE WHEN ch IN ('click', 'view') THEN 'merged' ELSE ch END AS cell FROM sig WHERE ch <> 'purchase'),
shape AS (SELECT cell, sig.t - spikes.t + 10 AS pos, avg(sig.x) AS v FROM spikes JOIN cells ON cells.ch = spikes.ch JOIN sig ON spikes.ch = sig.ch AND sig.t BETWEEN spikes.t - 10 AND spikes.t + 21 GROUP BY ALL),
times AS (SELECT DISTINCT cell, us FROM (SELECT event_type AS ch, epoch_us(ts) AS us FROM events) JOIN cells USING (ch) WHERE cell IN (SELECT cell FROM shape))
SELECT cell, 'timestamps' AS name, row_number() OVER (PARTITION BY cell ORDER BY us) - 1 AS i, round(us / 1000, 3) + 0.0 AS x FROM times UNION ALL SELECT cell, 'spikeForm', pos, round(v, 9) + 0.0 FROM shape""",
    "sig",
)
def spiketrain_files(s, d):
    """Trains of merged and selected units as MAT files, a cell each, read back."""
    from ..operators import signals
    from ..shared import folder
    from ..sources import mat

    sig, path = v.sig(s, d), folder(s, "spiketrains")
    shapes = signals.snippets(sig, signals.spikes(sig, 3.0)).select(F.col("ch").alias("unit"), F.lit(0).alias("ch"), "pos", F.col("x").alias("v"))
    mat.write_spiketrains(sessions.spiketrains(v.train(s, d), shapes, {"click": "merged", "view": "merged"}, ["purchase"]), path)
    named = mat.read(s, path).select(F.regexp_extract("file", "([^/]*)[.]mat$", 1).alias("cell"), "name", "x")  # a row a variable
    rows = named.select("cell", "name", F.posexplode("x").alias("i", "x"))
    return rows.withColumn("i", F.col("i").cast("long")).withColumn("x", F.when(F.col("name") == "timestamps", F.round("x", 3)).otherwise(F.round("x", 9)) + 0.0)
