"""Signals, trains, waveforms, kernels, sources and streams: SQL, brute force, round trips."""

import itertools
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voltair import plans, sources, streaming
from voltair.functions import chi2_tail
from voltair.operators import bandjoin, hmm, signals, trains


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    expected = duck.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in sorted(expected.columns)]
    rows = sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect())
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["ch", "t", "x"]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_run(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


TEMPLATES, P, PRECISION = np.array([[-2.0, 3.0, 1.0], [1.0, -3.0, 2.0]]), np.array([0.1, 0.2]), 1.3


def paths(states, moves, samples):
    move = {(int(w), i): lp for i in range(len(states)) for w, lp in zip(moves.who[moves.of(i)], moves.log_p[moves.of(i)], strict=True)}
    for rest in itertools.product(range(len(states)), repeat=samples - 1):
        steps = list(zip((0, *rest), rest))  # noqa: B905
        if all(s in move for s in steps):
            yield (0, *rest), sum(move[s] for s in steps)


@pytest.mark.parametrize("active", [1, 2])
def test_viterbi_finds_the_best_path(active):
    states = hmm.joint_states(2, 3, active)
    moves = hmm.predecessors(states, 3, P)
    means = np.concatenate([np.zeros((2, 1)), TEMPLATES], 1)
    x = np.array([0.1, -2.2, 3.5, -1.9, 2.2])
    score = lambda path: sum(-0.5 * PRECISION * (x[t] - sum(means[r, states[path[t]][r]] for r in range(2))) ** 2 for t in range(1, len(x)))
    best = max(lp + score(path) for path, lp in paths(states, moves, len(x)))
    path, got = hmm.viterbi(x, states, moves, TEMPLATES, PRECISION)
    assert got == pytest.approx(best) and path[0] == 0
    n = 1 + 2 * 3 + (active == 2) * 9
    assert len(states) == n


def test_posterior_matches_enumeration():
    states = hmm.joint_states(2, 3, 1)
    index = {tuple(s): i for i, s in enumerate(states.tolist())}
    flat = [index[0, 0], *(index[k, 0] for k in (1, 2, 3)), *(index[0, k] for k in (1, 2, 3))]
    means = np.concatenate([[0.0], TEMPLATES.ravel()])
    x, total = np.array([0.2, -2.0, 2.9, 1.2]), np.zeros((7, 4))
    chance = np.zeros((7, 7))
    chance[0, 0], chance[0, 1], chance[0, 4] = 1 - P.sum(), *P
    for a in (1, 2, 4, 5):
        chance[a, a + 1] = 1
    chance[3, 0] = chance[6, 0] = 1
    for rest in itertools.product(range(7), repeat=3):
        path = (0, *rest)
        w = math.prod(chance[a, b] * math.exp(-0.5 * PRECISION * (x[t + 1] - means[b]) ** 2) for t, (a, b) in enumerate(itertools.pairwise(path)))
        for t, s in enumerate(path):
            total[s, t] += w
    assert len(flat) == 7
    np.testing.assert_allclose(hmm.forward_backward(x, TEMPLATES, P, PRECISION), total / total.sum(0), atol=1e-9)


def test_moves_are_those_of_the_rings():
    states = hmm.joint_states(3, 2, 2)
    moves = hmm.predecessors(states, 2, np.array([0.1, 0.2, 0.3]))
    p = [0.1, 0.2, 0.3]
    for i, s in enumerate(states.tolist()):
        expected = {}
        for j, b in enumerate(states.tolist()):
            chance = 1.0
            for ring in range(3):
                a, z = b[ring], s[ring]
                step = (1 - p[ring]) if (a, z) == (0, 0) else p[ring] if (a, z) == (0, 1) else 1.0 if z == a + 1 and a or (a, z) == (2, 0) else 0.0
                chance *= step
            if chance:
                expected[j] = pytest.approx(math.log(chance))
        assert dict(zip(moves.who[moves.of(i)].tolist(), moves.log_p[moves.of(i)].tolist(), strict=True)) == expected


def test_thirty_templates_are_decoded():
    r = np.random.default_rng(9)
    templates = r.normal(0, 3, (30, 45))
    x = r.normal(0, 0.3, 120)
    for t, k in ((10, 3), (40, 17)):
        x[t : t + 45] += templates[k]
    states = hmm.joint_states(30, 45, 2)
    assert len(states) == 1 + 30 * 45 + 435 * 45**2
    path, _ = hmm.viterbi(x, states, hmm.predecessors(states, 45, np.full(30, 1e-6)), templates, 1 / 0.09)
    onsets = np.argwhere(states[path] == 1).tolist()
    assert onsets == [[10, 3], [40, 17]]


@pytest.mark.parametrize("chunk", [1, 2, 7, 40])
def test_chunks_give_the_posterior_of_the_whole(chunk):
    x = np.random.default_rng(2).normal(0, 2, 40)
    whole = hmm.forward_backward(x, TEMPLATES, P, PRECISION)
    np.testing.assert_allclose(hmm.forward_backward(x, TEMPLATES, P, PRECISION, chunk), whole, atol=1e-12)


def test_decoding_tables_and_learned_templates(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 0.2, 200)
    x[50:53] += TEMPLATES[0]
    sig = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "ch string, t long, x double")
    found = hmm.decode_session(sig, TEMPLATES, 25.0, p=np.full(2, 0.01), cap=1)
    stats = found["decode_stats"].first()
    states = hmm.joint_states(1, 3, 1)
    _, score = hmm.viterbi(x, states, hmm.predecessors(states, 3, np.array([0.01])), TEMPLATES[:1], 25.0)
    assert stats.samples == 200 and stats.ll == pytest.approx(score)
    assert [s.t for s in found["states"].where("state = 1").collect()] == [50] and found["templates"].count() == 1
    learned = spark.createDataFrame([("a", 7, 0.01, TEMPLATES[0].tolist()), ("b", 8, 0.01, TEMPLATES[1].tolist())], "ch string, template_id long, p double, waveform array<double>")
    assert [(s.template_id, s.t) for s in hmm.decode_learned(sig, learned, 25.0).where("state = 1").collect()] == [(7, 50)]


def test_alignment_by_parts_of_a_sample():
    t = np.arange(40)
    wave = lambda s: np.exp(-((t - 20 - s) ** 2) / 18)
    assert np.abs(hmm.spline(wave(0), 10)[::10] - wave(0)).max() < 1e-12
    assert np.abs(hmm.aligned(wave(0), wave(3.4)) - wave(0)).max() < 1e-3
    many, rates = np.stack([wave(0), wave(3.4), -wave(0)]), np.array([0.01, 0.02, 0.03])
    for merged, rate in (hmm.combine(many, rates, 40.0, 4000, factor=10), hmm.combine_alike(many, rates, 40.0)):
        assert len(merged) == 2 and rate.sum() == pytest.approx(0.06)


def test_decoding_in_patches_finds_planted_spikes(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 0.2, 600)
    onset = np.array([20, 95, 96, 200, 350, 580])
    kind = np.array([0, 1, 0, 1, 0, 1])
    for t, k in zip(onset, kind, strict=True):
        x[t : t + 3] += TEMPLATES[k]
    sig = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "ch string, t long, x double")
    for patch in (600, 130):
        found = hmm.decode(sig, TEMPLATES, np.full(2, 0.01), 25.0, patch=patch).where("state = 1").collect()
        assert sorted((s.t, s.template_id) for s in found) == sorted(zip(onset.tolist(), kind.tolist(), strict=True))


def test_learning_recovers_a_template(spark):
    r = np.random.default_rng(1234)
    wave = np.array([0.0, -4.0, -7.0, 5.0, 3.0, 0.5])
    x = r.normal(0, 0.5, 4000)
    for t in range(30, 3900, 61):
        x[t : t + 6] += wave
    sig = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "ch string, t long, x double")
    templates, p, precision = hmm.learn(sig, rings=1, length=8, iterations=8, start=1e-2, update_p=True)
    padded = np.concatenate([wave, [0, 0]])
    error = min(((np.roll(templates[0], s) - padded) ** 2).sum() for s in range(8))
    assert error < 0.05 * (wave**2).sum()
    assert precision == pytest.approx(4, rel=0.3) and p[0] == pytest.approx(1 / 61, rel=0.3)
    merged, rate = hmm.combine(np.stack([padded, np.roll(padded, 2) + 0.01, -padded]), np.array([0.01, 0.02, 0.03]), 4.0, 4000)
    assert len(merged) == 2 and rate.sum() == pytest.approx(0.06)


@pytest.mark.parametrize(("stat", "df", "tail"), [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.5, 3, 0.918891411654676), (200.0, 150, 0.00399)])
def test_chi2_tail(stat, df, tail):
    assert chi2_tail(stat, df) == pytest.approx(tail, rel=5e-3)


def test_filters(spark):
    t = np.arange(6000)
    slow, fast = np.sin(2 * np.pi * t * 50 / 30_000), np.sin(2 * np.pi * t * 3000 / 30_000)
    assert np.abs(signals.zero_phase(slow, 4, 0.05)[500:-500]).max() < 1e-3
    np.testing.assert_allclose(signals.zero_phase(fast, 4, 0.05)[500:-500], fast[500:-500], atol=2e-3)
    np.testing.assert_allclose(signals.zero_phase(slow, 4, 0.05, "low")[500:-500], slow[500:-500], atol=2e-3)
    # half power at the cutoff, twice because of both directions
    edge = np.sin(2 * np.pi * t * 750 / 30_000)
    assert np.abs(signals.zero_phase(edge, 4, 0.05)[1000:-1000]).max() == pytest.approx(0.5, abs=0.01)
    sig = spark.createDataFrame([("a", int(i), float(a + b)) for i, a, b in zip(t[:3000], slow, fast, strict=False)], "ch string, t long, x double")
    out = np.array([r.x for r in signals.fft_bandpass(sig, 30_000, 1000, 5000).orderBy("t").collect()])
    np.testing.assert_allclose(out, fast[:3000], atol=1e-6)
    quiet = np.array([r.x for r in signals.line_noise_removed(sig.withColumn("x", F.sin(F.col("t") * 2 * math.pi * 50 / 30_000)), 30_000).collect()])
    assert (quiet**2).mean() < 0.01 * 0.5


def test_refractory_is_greedy_by_size(spark):
    rows = [("a", 10, -5.0), ("b", 13, -5.0), ("a", 14, -4.0), ("b", 17, -9.0), ("a", 30, -1.0), ("b", 34, -1.0), ("a", 34, -1.0)]
    got = signals.refractory(spark.createDataFrame(rows, "ch string, t long, x double").withColumn("grp", F.lit(1)), "grp").collect()
    assert sorted((r.ch, r.t) for r in got) == [("a", 10), ("a", 30), ("a", 34), ("b", 17)]


def test_band_joins_mirror_and_complement(spark):
    r = np.random.default_rng(2)
    a, b = (spark.createDataFrame([(i, int(t)) for i, t in enumerate(r.integers(-500, 500, 200))], "id long, at long") for _ in range(2))
    forward = {(x.l_id, x.r_id) for x in bandjoin.band_join(a, b, "at", 7).collect()}
    assert forward == {(x.r_id, x.l_id) for x in bandjoin.band_join(b, a, "at", 7).collect()}
    ta, tb = ({x.id: x.at for x in d.collect()} for d in (a, b))
    assert forward == {(i, j) for i in ta for j in tb if abs(ta[i] - tb[j]) < 7}
    assert {x.id for x in bandjoin.band_anti_join(a, b, "at", 7, "id").collect()} == set(ta) - {i for i, _ in forward}


def test_results_do_not_depend_on_partitions(spark, sf):
    train = plans.v.train(spark, sf)
    one, many = (sorted(map(tuple, trains.correlogram(train.repartition(n), 10 * plans.MINUTE, plans.MINUTE).collect())) for n in (1, 13))
    assert one == many


def test_sources_round_trip(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.integers(-999, 999, (70_001, 2))
    (tmp_path / "a.sig").write_bytes(sources.signal_bytes(x, 30_000))
    got = sources.samples(sources.read_signal(spark, str(tmp_path / "a.sig")))
    assert got.count() == x.size and got.where("ch = 1 AND t = 70000").first().x == x[-1, 1]
    w, ts = r.integers(-9, 9, (3, 4, 32)), np.array([10, 20, 30])
    (tmp_path / "a.wav").write_bytes(sources.waveform_bytes(w, ts))
    rows = sources.read_waveforms(spark, str(tmp_path / "a.wav")).orderBy("spike").collect()
    assert [x.ts_ms for x in rows] == pytest.approx([1.0, 2.0, 3.0]) and rows[2].w[3] == w[2, 3].tolist()
    (tmp_path / "a.syn").write_bytes(sources.sync_bytes("s", np.array([5, 6]), 0.0, 1.0))
    assert [x.sync for x in sources.read_syncs(spark, str(tmp_path / "a.syn")).orderBy("idx").collect()] == [5, 6]
    text = "header\nChannels 4\nRate 30000\nx\nGain 5000\nNumber Type Group Status\n"
    (tmp_path / "d.txt").write_text(text + "\n" + "1 electrode 1 Active\n2 electrode 1 missing\n3 electrode 2 Active\n4 presenter 0 Active\n")
    rows = sources.read_descriptor(spark, str(tmp_path / "d.txt")).orderBy("nr").collect()
    assert [x.ch_nr for x in rows] == [1, None, 2, 3] and [x.nr for x in rows if x.missing] == [2]


@pytest.mark.parametrize("first", [0, 50_000_000_001])
def test_waveform_files_round_as_sql(spark, tmp_path, first):
    """Floats next to every half of a thousandth: a thousand times as much is a half as a float, and mostly isn't as a double. Stamps of many digits."""
    path = tmp_path / "embeddings.parquet"
    duckdb.execute(f"COPY (SELECT {first} + i + 600 AS vec_id, [((2 * i + 1) / 2000)::FLOAT] AS embedding, (i & 3)::INT AS label FROM range(-600, 600) r(i)) TO '{path}' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    got = plans.QUERIES["waveform_files"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.SQL['waveform_files']})").fetchall())


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, 90)
    schema = "ch string, t long, x double"
    for k in range(3):
        spark.createDataFrame([("a", i, float(x[i])) for i in range(30 * k, 30 * k + 30)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    q = streaming.stream_troughs(source, 0.5).writeStream.format("memory").queryName("troughs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    sig = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], schema)
    assert sorted(r.t for r in spark.table("troughs").collect()) == sorted(r.t for r in signals.troughs(sig).where("x < -0.5").collect())
