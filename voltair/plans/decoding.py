"""Queries that decode in chunks, online, with own transitions, and with flipped decisions; those of one ring have recursive SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import streaming
from .. import views as v
from ..operators import groups, hmm, signals
from ..shared import folder
from ..sources import recordings
from . import DEMO, query, rounded, scaled

ONE, RATE, CHUNK = DEMO[:1], np.array([1e-3]), 2000
#: Samples of all channels that a micro-batch of a stream holds.
BATCH = 1 << 20
#: Chances of a ring whose third sample may be held, and that may be broken off after it.
HELD = hmm.ring_matrix(4, 0.02)
HELD[3, :] = 0.1, 0.0, 0.0, 0.2, 0.7
SCALED = ", mad AS (SELECT ch, median(abs(x)) / 0.6745 AS scale FROM sig GROUP BY ch), sc AS (SELECT sig.ch, t, x / scale AS x FROM sig JOIN mad ON sig.ch = mad.ch)"


def ring_sql(matrix: np.ndarray, template: np.ndarray, end: int | None = None) -> str:
    """A path CTE (ch, t, state, margin): Viterbi over one ring of unit precision, forward and back by recursion in t; the first sample is silent and not scored."""
    n = len(matrix)
    means = [0.0, *map(float, template)]
    ways = {j: [(int(i), float(np.log(matrix[i, j]))) for i in np.flatnonzero(matrix[:, j])] for j in range(n)}
    option = lambda i, lp: f"(w.s{i} + {lp!r}::DOUBLE)"
    best = {j: "greatest(" + ", ".join(option(*w) for w in ways[j]) + ")" for j in range(n)}
    score = ", ".join(f"{best[j]} - 0.5 * (sc.x - {means[j]!r}::DOUBLE) * (sc.x - {means[j]!r}::DOUBLE) AS s{j}" for j in range(n))
    back = ", ".join("CASE " + " ".join(f"WHEN {option(*w)} = {best[j]} THEN {w[0]}" for w in ways[j]) + f" END AS b{j}" for j in range(n))
    margin = ", ".join(f"{' - '.join([best[j], 'least(' + ', '.join(option(*w) for w in ways[j]) + ')']) if len(ways[j]) == 2 else '1e300::DOUBLE'} AS m{j}" for j in range(n))
    zero = ", ".join(f"{0.0 if j == 0 else -1e300!r}::DOUBLE AS s{j}" for j in range(n)) + ", " + ", ".join(f"0 AS b{j}" for j in range(n)) + ", " + ", ".join(f"1e300::DOUBLE AS m{j}" for j in range(n))
    chosen = lambda c: "CASE " + " ".join(f"WHEN q.state = {j} THEN f.{c}{j}" for j in range(n)) + " END"
    top = "greatest(" + ", ".join(f"s{j}" for j in range(n)) + ")"
    last = str(end) if end is not None else "CASE " + " ".join(f"WHEN s{j} = {top} THEN {j}" for j in range(n)) + " END"
    return f"""{SCALED}, f AS (SELECT ch, 0::BIGINT AS t, {zero} FROM sc WHERE t = 0 UNION ALL SELECT sc.ch, sc.t, {score}, {back}, {margin} FROM f w JOIN sc ON sc.ch = w.ch AND sc.t = w.t + 1),
high AS (SELECT ch, max(t) AS high FROM sc GROUP BY ch),
q AS (SELECT f.ch, f.t, {last} AS state FROM f JOIN high ON f.ch = high.ch AND f.t = high UNION ALL SELECT q.ch, q.t - 1, {chosen("b")} FROM q JOIN f ON f.ch = q.ch AND f.t = q.t WHERE q.t > 0),
path AS (SELECT q.ch, q.t, q.state::BIGINT AS state, {chosen("m")} AS margin FROM q JOIN f ON f.ch = q.ch AND f.t = q.t)"""


RING = ring_sql(hmm.ring_matrix(4, 1e-3), ONE[0])
STATES = " SELECT ch, 0::BIGINT AS template_id, t, state FROM path WHERE state > 0"


def recursive(sql: str, *views: str):
    """query, in SQL that begins WITH RECURSIVE."""
    return query("WITH RECURSIVE " + ", ".join(v.SQL[x] for x in views) + sql)


@recursive(RING + STATES, "sig")
def one_ring_states(s, d):
    return hmm.decode(scaled(s, d), ONE, RATE, 1.0, patch=CHUNK)


@recursive(RING + STATES, "sig")
def online_states(s, d):
    """The same, by a stream: samples are written in stretches of time, read in micro-batches, two at least, of BATCH samples at most (if stretches are even), and told when they are certain."""
    sig = scaled(s, d).select("ch", "t", "x")
    ends = sig.groupBy("ch").agg((F.max("t") + 1).alias("t")).select("ch", "t", F.lit(None).cast("double").alias("x"))
    source, sink = folder(s, "online-in"), folder(s, "online-out")
    batches = max(2, -(-v.table(s, d, "events").count() // BATCH))
    sig.union(ends).repartitionByRange(8 * batches, "t").write.parquet(source)
    files = len(s.read.parquet(source).inputFiles())
    stream = s.readStream.schema(sig.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(source)
    found = streaming.stream_decode(stream, ONE, RATE, 1.0)
    found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(found.schema).parquet(sink)


@recursive(RING + " SELECT ch, t, round(margin, 6) AS margin FROM path WHERE margin < 2", "sig")
def uncertain_decisions(s, d):
    return rounded(hmm.uncertain(scaled(s, d), ONE, RATE, 1.0, 2.0, patch=CHUNK), "margin")


@recursive(ring_sql(HELD, ONE[0], end=0) + STATES, "sig")
def held_ring_states(s, d):
    """A ring with transitions of its own, which ends in silence."""
    return hmm.decode_rings(scaled(s, d), ONE, [HELD], 1.0, patch=CHUNK)


@recursive(RING + " SELECT path.ch, template_id, t, state, p, wave, samples FROM (SELECT *, 0::BIGINT AS template_id FROM path WHERE state > 0) path JOIN (SELECT 0.001::DOUBLE AS p, '" + ",".join(map(str, ONE[0].tolist())) + "' AS wave) ON true JOIN (SELECT ch, high + 1 AS samples FROM high) h ON h.ch = path.ch", "sig")
def decoded_tables(s, d):
    """The tables of a decoding, written, read back and joined."""
    path = folder(s, "decoded-tables")
    recordings.write_decoded(path, *hmm.decode_session(scaled(s, d), ONE, 1.0, RATE, patch=CHUNK).values())
    back = recordings.read_decoded(s, path)
    templates = back["templates"].select("template_id", "p", F.array_join(F.col("waveform").cast("array<string>"), ",").alias("wave"))
    return back["states"].join(F.broadcast(templates), "template_id").join(F.broadcast(back["decode_stats"].select("ch", "samples")), "ch")  # a row a template, a row a channel


RATES = np.full(2, 1e-3)
JOINT = hmm.joint_states(2, DEMO.shape[1], 2)


def trellis_sql(states: np.ndarray, moves: hmm.Moves, templates: np.ndarray, source: str = SCALED, also: np.ndarray | None = None) -> str:
    """source: CTEs up to sc (ch, t, x); also: templates of a second channel, whose samples sc has as y. As ring_sql, over joint states: best and second best ways into each, `path` by the best ones, and `other`, which takes the second best where the first wins by less than 0.5."""
    def means_of(shapes: np.ndarray) -> list[float]:
        padded = np.concatenate([np.zeros((len(shapes), 1)), shapes], 1)
        return [float(m) for m in sum(padded[r, states[:, r]] for r in range(len(shapes)))]

    means, n = means_of(templates), len(states)
    more, second, value = ("", "", "x") if also is None else (f", {means_of(also)!r}::DOUBLE[] AS m2", " - 0.5 * (y - m2[j]) * (y - m2[j])", "x, y")
    into = {j: list(zip(moves.who[moves.of(j)].tolist(), moves.log_p[moves.of(j)].tolist(), strict=True)) for j in range(n)}
    options = ", ".join(f"[{', '.join(f'w.s[{i + 1}] + {lp!r}::DOUBLE' for i, lp in into[j])}]" for j in range(n))
    ids = ", ".join(str([i for i, _ in into[j]]) for j in range(n))
    start = "[" + ", ".join("0.0" if j == 0 else "-1e300" for j in range(n)) + "]::DOUBLE[]"
    return f"""{source}, c AS (SELECT [{ids}] AS ids, {means!r}::DOUBLE[] AS m{more}),
f AS (SELECT ch, 0::BIGINT AS t, {start} AS s, []::BIGINT[] AS b, []::BIGINT[] AS b2, []::DOUBLE[] AS margin FROM sc WHERE t = 0
UNION ALL SELECT ch, t, list_transform(range(1, {n + 1}), lambda j: list_max(o[j]) - 0.5 * (x - m[j]) * (x - m[j]){second}), list_transform(range(1, {n + 1}), lambda j: ids[j][list_position(o[j], list_max(o[j]))]),
  list_transform(range(1, {n + 1}), lambda j: ids[j][list_position(o[j], list_reverse_sort(o[j])[least(2, len(o[j]))])]), list_transform(range(1, {n + 1}), lambda j: CASE WHEN len(o[j]) > 1 THEN list_max(o[j]) - list_reverse_sort(o[j])[2] ELSE 1e300 END)
  FROM (SELECT sc.ch, sc.t, {value}, [{options}] AS o FROM f w JOIN sc ON sc.ch = w.ch AND sc.t = w.t + 1), c),
high AS (SELECT ch, max(t) AS high FROM sc GROUP BY ch),
q AS (SELECT f.ch, f.t, list_position(s, list_max(s)) - 1 AS state FROM f JOIN high ON f.ch = high.ch AND f.t = high UNION ALL SELECT q.ch, q.t - 1, f.b[q.state + 1] FROM q JOIN f ON f.ch = q.ch AND f.t = q.t WHERE q.t > 0),
path AS (SELECT * FROM q),
weak AS MATERIALIZED (SELECT q.ch, q.t FROM q JOIN f ON f.ch = q.ch AND f.t = q.t WHERE q.t > 0 AND f.margin[q.state + 1] < 0.5),
marked AS MATERIALIZED (SELECT f.*, weak.t IS NOT NULL AS turn FROM f LEFT JOIN weak ON weak.ch = f.ch AND weak.t = f.t),
r AS (SELECT f.ch, f.t, list_position(s, list_max(s)) - 1 AS state FROM f JOIN high ON f.ch = high.ch AND f.t = high UNION ALL SELECT r.ch, r.t - 1, CASE WHEN turn AND f.margin[r.state + 1] < 1e299 THEN f.b2[r.state + 1] ELSE f.b[r.state + 1] END FROM r JOIN marked f ON f.ch = r.ch AND f.t = r.t WHERE r.t > 0),
other AS (SELECT * FROM r),
rings AS (SELECT * FROM (VALUES {', '.join(f'({i}, {k}, {int(v)})' for i, s in enumerate(states) for k, v in enumerate(s) if v)}) v(joint, template_id, state))"""


BOTH = trellis_sql(JOINT, hmm.predecessors(JOINT, DEMO.shape[1], RATES), DEMO)
RUNNING = " SELECT ch, template_id::BIGINT AS template_id, t, rings.state::BIGINT AS state FROM {path} p JOIN rings ON rings.joint = p.state"


@recursive(BOTH + RUNNING.format(path="path"), "sig")
def viterbi_states(s, d):
    return hmm.decode(scaled(s, d), DEMO, RATES, 1.0, patch=CHUNK)


@recursive(BOTH + " SELECT ch, template_id::BIGINT AS unit, t FROM path p JOIN rings ON rings.joint = p.state WHERE rings.state = CASE template_id " + " ".join(f"WHEN {i} THEN {int(k)}" for i, k in enumerate(DEMO.argmin(1) + 1)) + " END", "sig")
def decoded_spikes(s, d):
    return hmm.decoded_spikes(viterbi_states(s, d), DEMO)


@recursive(BOTH + f", ends AS (SELECT ch, high + 1 AS samples FROM high) SELECT p.ch, template_id::BIGINT AS unit, p.t, round(p.t * 1000 / 30000, 6) AS ts_ms FROM path p JOIN rings ON rings.joint = p.state JOIN ends ON ends.ch = p.ch WHERE rings.state = {DEMO.shape[1] // 3} AND p.t < samples - 22", "sig")
def decoded_trains(s, d):
    """Spike times in milliseconds, at a third of a template's length, without those at a channel's end."""
    sig = scaled(s, d)
    spikes = hmm.decoded_spikes(hmm.decode(sig, DEMO, RATES, 1.0, patch=CHUNK), DEMO, "third")
    return rounded(hmm.without_edge(spikes, sig).withColumn("ts_ms", hmm.milliseconds(F.col("t"), 30_000)), "ts_ms")


@recursive(BOTH + RUNNING.format(path="other"), "sig")
def redecoded_states(s, d):
    """Two rings, decoded again with the least certain decisions taken the other way."""
    sig = scaled(s, d)
    return hmm.redecode(sig, hmm.uncertain(sig, DEMO, RATES, 1.0, 0.5, patch=CHUNK), DEMO, RATES, 1.0, patch=CHUNK)


OTHER = -0.5 * DEMO[::-1]
PAIR = SCALED.replace("sc AS", "single AS") + ", sc AS (SELECT 'pair' AS ch, a.t, a.x, b.x AS y FROM single a JOIN single b ON a.t = b.t WHERE a.ch = (SELECT min(ch) FROM single) AND b.ch = (SELECT max(ch) FROM single))"


@recursive(trellis_sql(JOINT, hmm.predecessors(JOINT, DEMO.shape[1], RATES), DEMO, PAIR, OTHER) + RUNNING.format(path="path").replace("ch, template_id", "ch AS grp, template_id"), "sig")
def group_states(s, d):
    """The first and the last channel by name as a group, decoded together."""
    sig = scaled(s, d)
    names = sorted(r["ch"] for r in sig.select("ch").distinct().collect())  # a row a channel
    pair = [names[0], names[-1]]
    rows = sig.where(F.col("ch").isin(pair)).select(F.lit("pair").alias("grp"), "ch", "t", "x")
    return groups.decode(rows, pair, np.stack([DEMO, OTHER], 1), RATES, np.eye(2), patch=CHUNK).drop("margin")


def posterior_sql(tag: str, rings: int, length: int, p: float) -> str:
    """CTEs from m<tag> (m0, .., prec: one row) to sums<tag> (g0, x0, xx0, .., n): the sums of the posterior over all samples, forward and back by recursion in t."""
    n = 1 + rings * length
    first, last = [1 + r * length for r in range(rings)], [(1 + r) * length for r in range(rings)]
    each = lambda f, join=", ": join.join(f(j) for j in range(n))
    into = lambda j: f"w.f0 * {1 - rings * p!r} + " + " + ".join(f"w.f{k}" for k in last) if j == 0 else f"w.f0 * {p!r}" if j in first else f"w.f{j - 1}"
    out = lambda j: f"w.b0 * e0 * {1 - rings * p!r} + {p!r} * (" + " + ".join(f"w.b{k} * e{k}" for k in first) + ")" if j == 0 else "w.b0 * e0" if j in last else f"w.b{j + 1} * e{j + 1}"
    total = lambda c: each(lambda j: f"{c}{j}", " + ")
    return f"""em{tag} AS (SELECT ch, t, x, {each(lambda j: f"e{j} / total AS e{j}")} FROM (SELECT *, {total("e")} AS total FROM (SELECT ch, t, x, {each(lambda j: f"exp(-0.5 * prec * (x - m{j}) * (x - m{j})) + 9.859676543759770e-305 AS e{j}")} FROM sc, m{tag}))),
fw{tag} AS (SELECT ch, t, {each(lambda j: f"{float(j == 0)!r}::DOUBLE AS f{j}")} FROM em{tag} WHERE t = 0 UNION ALL SELECT ch, t, {each(lambda j: f"f{j} / total")} FROM (SELECT *, {total("f")} AS total FROM (SELECT e.ch, e.t, {each(lambda j: f"({into(j)}) * e{j} AS f{j}")} FROM fw{tag} w JOIN em{tag} e ON e.ch = w.ch AND e.t = w.t + 1))),
bw{tag} AS (SELECT ch, max(t) AS t, {each(lambda j: f"1.0::DOUBLE AS b{j}")} FROM em{tag} GROUP BY ch UNION ALL SELECT ch, t, {each(lambda j: f"b{j} / total")} FROM (SELECT *, {total("b")} AS total FROM (SELECT e.ch, w.t - 1 AS t, {each(lambda j: f"{out(j)} AS b{j}")} FROM bw{tag} w JOIN em{tag} e ON e.ch = w.ch AND e.t = w.t WHERE w.t > 0))),
po{tag} AS (SELECT ch, t, x, {each(lambda j: f"g{j} / total AS g{j}")} FROM (SELECT *, {total("g")} AS total FROM (SELECT e.ch, e.t, x, {each(lambda j: f"f{j} * b{j} AS g{j}")} FROM em{tag} e JOIN fw{tag} f ON f.ch = e.ch AND f.t = e.t JOIN bw{tag} b ON b.ch = e.ch AND b.t = e.t))),
sums{tag} AS (SELECT {each(lambda j: f"sum(g{j}) AS g{j}, sum(g{j} * x) AS x{j}, sum(g{j} * x * x) AS xx{j}")}, count(*) AS n FROM po{tag})"""


def model_sql(means: np.ndarray, precision: float) -> str:
    return "SELECT " + ", ".join(f"{float(m)!r}::DOUBLE AS m{j}" for j, m in enumerate([0.0, *means.ravel()])) + f", {precision!r}::DOUBLE AS prec"


@recursive(f"{SCALED}, m1 AS ({model_sql(DEMO, 1.0)}), {posterior_sql('1', 2, 4, 1e-3)} " + " UNION ALL ".join(f"SELECT {j}::BIGINT AS state, round(g{j}, 4) + 0.0 AS g, round(x{j}, 4) + 0.0 AS gx, round(xx{j}, 4) + 0.0 AS gxx, n AS samples FROM sums1" for j in range(9)), "sig")
def forward_backward(s, d):
    return rounded(hmm.posterior_sums(scaled(s, d), DEMO, RATES, 1.0, chunk=CHUNK), "g", "gx", "gxx", digits=4)


LEARNED = {"rings": 3, "length": 6, "iterations": 3, "start": 1e-3}


def learning_sql(rings: int, length: int, iterations: int, start: float) -> str:
    """Expectation maximisation from the first guess of hmm.learn; the rate stays as it was."""
    n = 1 + rings * length
    guess = hmm.first_guess(rings, length, np.random.default_rng(1234))
    parts = ["m1 AS (SELECT 0.0::DOUBLE AS m0, " + ", ".join(f"{float(v)!r} * scale AS m{j + 1}" for j, v in enumerate(guess.ravel())) + ", 1 / (scale * scale) AS prec FROM (SELECT avg(scale) AS scale FROM (SELECT ch, median(abs(x)) / 0.6745 AS scale FROM sc GROUP BY ch)))"]
    for k in range(1, iterations + 1):
        left = " + ".join(f"(xx{j} - 2 * m{j} * x{j} + m{j} * m{j} * g{j})" for j in range(n))
        mean = ", ".join("0.0::DOUBLE AS m0" if j == 0 else f"x{j} / greatest(g{j}, 1e-300) AS m{j}" for j in range(n))
        parts += [posterior_sql(str(k), rings, length, start), f"m{k + 1} AS (SELECT *, n / ({left}) AS prec FROM (SELECT *, {mean} FROM sums{k}))"]
    rows = " UNION ALL ".join(f"SELECT {r}::BIGINT AS template_id, round(g{1 + r * length} / n, 6) AS p, {i}::BIGINT AS pos, round(m{1 + r * length + i}, 4) + 0.0 AS x FROM m{iterations + 1}" for r in range(rings) for i in range(length))
    return f"{SCALED}, " + ", ".join(parts) + " " + rows


@recursive(learning_sql(**LEARNED), "sig")
def learn_templates(s, d):
    """(template_id, p, pos, x): learned waveforms, a row a sample."""
    templates, p, _ = hmm.learn(scaled(s, d), **LEARNED)
    rows = [(i, float(p[i]), k, float(x)) for i, t in enumerate(templates) for k, x in enumerate(t)]
    return rounded(rounded(s.createDataFrame(rows, "template_id long, p double, pos long, x double"), "p"), "x", digits=4)


@query(
    """, n AS (SELECT ch, count(*) AS n FROM sig GROUP BY ch), k AS (SELECT ch, n, k FROM n, unnest(range(0, n // 2 + 1)) r(k) WHERE k * 1000.0 / n >= 50 AND k * 1000.0 / n <= 300),
dft AS (SELECT k.ch, k.k, any_value(n) AS n, sum(x * cos(2 * pi() * ((k.k * t) % n) / n)) AS re, sum(x * sin(2 * pi() * ((k.k * t) % n) / n)) AS im FROM k JOIN sig ON sig.ch = k.ch GROUP BY k.ch, k.k)
SELECT sig.ch, t, round(sum((re * cos(2 * pi() * ((k * t) % n) / n) + im * sin(2 * pi() * ((k * t) % n) / n)) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END / n), 6) + 0.0 AS x FROM sig JOIN dft ON dft.ch = sig.ch GROUP BY sig.ch, t""",
    "sig",
)
def fft_bandpass(s, d):
    return rounded(signals.fft_bandpass(v.sig(s, d), 1000.0, 50.0, 300.0), "x")


@query()
def alternative_readings(s, d):
    """The three best readings of each busy stretch."""
    found = hmm.alternatives(scaled(s, d), DEMO, np.full(2, 1e-3), 1.0, 3, patch=CHUNK)
    spikes = F.array_join(F.transform("spikes", lambda x: F.concat_ws(":", x["template_id"].cast("string"), x["t"].cast("string"))), ",")
    return rounded(found.withColumn("spikes", spikes), "loss")


def section_sql(number: int, pair: np.ndarray, name: str) -> tuple[str, str, str]:
    """Value and next state of one second-order section, from the state (z1, z2) in w and the input `name`."""
    (b0, b1, b2), (_, a1, a2) = ([repr(float(c)) for c in r] for r in pair)
    y = f"({b0} * {name} + w.z{number}1)"
    return y, f"{b1} * {name} - {a1} * {y} + w.z{number}2", f"{b2} * {name} - {a2} * {y}"


def pass_sql(source: str, out: str, sections: list[np.ndarray]) -> str:
    """One direction of a filter over source (ch, i, x): out (ch, i, y), from the steady state of the first sample."""
    names, first, begin, follow = "x", "x", [], []
    for k, pair in enumerate(sections):
        b, a = pair
        gain = b.sum() / a.sum()
        z2 = f"({float(b[2] - a[2] * gain)!r} * {first})"
        begin += [(f"({float(b[1] - a[1] * gain)!r} * {first} + {z2})", f"z{k}1"), (z2, f"z{k}2")]
        first = f"({float(gain)!r} * {first})"
        y, z1, z2 = section_sql(k, pair, names if k else "p.x")
        follow += [(z1, f"z{k}1"), (z2, f"z{k}2")]
        names = y
    start = ", ".join(f"{e} AS {n}" for e, n in begin)
    step = ", ".join(f"{e} AS {n}" for e, n in follow)
    return f"{out} AS (SELECT ch, -1::BIGINT AS i, 0.0::DOUBLE AS y, {start} FROM {source} WHERE i = 0 UNION ALL SELECT p.ch, p.i, {names} AS y, {step} FROM {out} w JOIN {source} p ON p.ch = w.ch AND p.i = w.i + 1)"


SECTIONS, PAD = list(signals.butterworth(4, 500.0 / 10_000.0)), 15
HIGHPASS = f""", n AS (SELECT ch, max(t) AS n FROM sig GROUP BY ch), e AS (SELECT sig.ch, t, x, n, least({PAD}, n) AS pad FROM sig JOIN n ON sig.ch = n.ch),
ext AS (SELECT ch, t + pad AS i, x::DOUBLE AS x FROM e UNION ALL SELECT e.ch, pad - e.t, 2 * f.x - e.x FROM e JOIN sig f ON f.ch = e.ch AND f.t = 0 WHERE e.t BETWEEN 1 AND pad UNION ALL SELECT e.ch, 2 * n - e.t + pad, 2 * l.x - e.x FROM e JOIN sig l ON l.ch = e.ch AND l.t = n WHERE e.t BETWEEN n - pad AND n - 1),
{pass_sql("ext", "one", SECTIONS)}, turned AS (SELECT one.ch, m - i AS i, y AS x FROM one JOIN (SELECT ch, max(i) AS m FROM ext GROUP BY ch) l ON l.ch = one.ch WHERE i >= 0),
{pass_sql("turned", "two", SECTIONS)} SELECT two.ch, n + least({PAD}, n) - i AS t, round(y, 6) + 0.0 AS x FROM two JOIN n ON n.ch = two.ch WHERE n + least({PAD}, n) - i BETWEEN 0 AND n"""


@recursive(HIGHPASS, "sig")
def highpass(s, d):
    return rounded(signals.highpass(v.sig(s, d), chunk=CHUNK), "x")


@recursive(HIGHPASS, "sig")
def filtered_table(s, d):
    """The same, into a table: a first run stops after one commit, a second one does the rest."""
    path, share = folder(s, "filtered"), 500.0 / 10_000.0
    sig = v.sig(s, d)
    signals.filter_into(sig, path, share, chunk=500, at_once=2, most=1)
    return rounded(signals.samples_of(signals.filter_into(sig, path, share, chunk=500)), "x")


FACTOR = 4
TAPS = signals.lowpass_taps(300.0 / 2000.0, 8 * FACTOR + 1)
LOW = f", h AS (SELECT * FROM (VALUES {', '.join(f'({j}, {w!r}::DOUBLE)' for j, w in enumerate(TAPS))}) h(j, w))"


@query(LOW + f" SELECT ch, m.t, round(sum(w * x) / sum(w), 6) + 0.0 AS x FROM (SELECT ch AS c, unnest(range(0, max(t) // {FACTOR} + 1)) AS t FROM sig GROUP BY ch) m JOIN sig ON ch = c JOIN h ON sig.t = m.t * {FACTOR} + {4 * FACTOR} - j GROUP BY ch, m.t", "sig")
def lowpass_decimated(s, d):
    return rounded(signals.lowpass_decimated(v.sig(s, d), 4000, 300.0), "x")


WAVE = signals.wavelet_taps()
MOVED = " + ".join(f"coalesce({f'lead(x, {2 - q})' if q < 2 else f'lag(x, {q - 2})' if q > 2 else 'x'}{' OVER w' if q != 2 else ''}, 0) * {c!r}::DOUBLE" for q, c in enumerate(WAVE))


@query(f" SELECT ch, t, round(x, 6) + 0.0 AS x FROM sig UNION ALL SELECT ch || '_wavelet', t, round({MOVED}, 6) + 0.0 FROM sig WINDOW w AS (PARTITION BY ch ORDER BY t)", "sig")
def wavelet_channels(s, d):
    return rounded(signals.with_wavelet(v.sig(s, d)), "x")


@recursive(
    """, key AS (SELECT ch, t, x, row_number() OVER (ORDER BY t, ch) AS o FROM (SELECT sig.*, lag(x) OVER w AS b, lead(x) OVER w AS a FROM sig WINDOW w AS (PARTITION BY ch ORDER BY t)) WHERE sign(a - x) - sign(x - b) > 0),
cut AS (SELECT *, sum(CASE WHEN t - p <= 3 THEN 0 ELSE 1 END) OVER (ORDER BY o) AS island FROM (SELECT *, lag(t) OVER (ORDER BY o) AS p FROM key)),
c AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY x, t, ch) AS r FROM cut),
w AS (SELECT island, r, ch, t, x, true AS stays, [t] AS taken FROM c WHERE r = 1
  UNION ALL SELECT c.island, c.r, c.ch, c.t, c.x, len(list_filter(w.taken, lambda k: abs(k - c.t) <= 3)) = 0, CASE WHEN len(list_filter(w.taken, lambda k: abs(k - c.t) <= 3)) = 0 THEN list_append(w.taken, c.t) ELSE w.taken END FROM w JOIN c ON c.island = w.island AND c.r = w.r + 1)
SELECT ch, t, x, 0 AS grp FROM w WHERE stays""",
    "sig",
)
def refractory_spikes(s, d):
    return signals.refractory(signals.troughs(v.sig(s, d)).withColumn("grp", F.lit(0)), "grp")
