"""Filters in chunks, suppression in rounds, online decoding, and the source and sink of recordings."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltair import streaming
from voltair.operators import hmm, lanes, signals, templates
from voltair.sources import recordings

SIG = "ch string, t long, x double"


def by_sample(b, a, x):
    """A second-order section, one sample after another."""
    gain = b.sum() / a.sum()
    z2 = (b[2] - a[2] * gain) * x[0]
    z1 = (b[1] - a[1] * gain) * x[0] + z2
    out = []
    for v in x:
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
@pytest.mark.parametrize("kind", ["high", "low"])
def test_blocks_are_the_recursion(n, kind):
    x = np.random.default_rng(n).normal(3, 1, n).cumsum()
    for b, a in signals.butterworth(4, 0.05, kind):
        np.testing.assert_allclose(signals.run_section(b, a, x), by_sample(b, a, x), atol=1e-9)


@pytest.fixture(scope="module")
def noise(spark):
    r = np.random.default_rng(6)
    rows = [(c, t, float(v)) for c, n in (("a", 3000), ("b", 700), ("c", 1)) for t, v in enumerate(r.normal(0, 10, n).cumsum())]
    return spark.createDataFrame(rows, SIG).cache()


def per_channel(df):
    return {c: g.sort_values("t")["x"].to_numpy() for c, g in df.toPandas().groupby("ch")}


@pytest.mark.parametrize("chunk", [97, 1000, 5000])
def test_filtered_chunks_are_the_whole(noise, chunk):
    got = per_channel(signals.highpass(noise, chunk=chunk))
    for c, x in per_channel(noise).items():
        np.testing.assert_allclose(got[c], signals.zero_phase(x, 4, 0.05), atol=1e-9)


def test_a_filtered_table_goes_on_where_it_stopped(noise, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    some = signals.filter_into(noise, path, 0.05, chunk=100, at_once=8, most=2, gain=2.0)
    assert {(r.ch, r.k) for r in some.select("ch", "k").collect()} == {*(("a", k) for k in range(16)), *(("b", k) for k in range(7)), ("c", 0)}
    files = {f: os.stat(f"{tmp_path}/out/{f}").st_mtime_ns for f in os.listdir(f"{tmp_path}/out") if f.startswith("part")}
    done, made = some.count(), []
    whole = signals.filtered_chunks
    monkeypatch.setattr(signals, "filtered_chunks", lambda *a: made.append(whole(*a)) or made[-1])
    got = signals.filter_into(noise, path, 0.05, chunk=100, at_once=8, gain=2.0)
    assert got.count() == 30 + 7 + 1 and sum(m.count() for m in made) == got.count() - done
    assert all(os.stat(f"{tmp_path}/out/{f}").st_mtime_ns == t for f, t in files.items())
    out = per_channel(signals.samples_of(got))
    for c, x in per_channel(noise).items():
        np.testing.assert_allclose(out[c], signals.zero_phase(x, 4, 0.05) / 2, atol=1e-9)
    made.clear()
    signals.filter_into(noise, path, 0.05, chunk=100, at_once=8)
    assert not made


def test_decimated_lowpass_keeps_what_is_low(spark):
    t = np.arange(4000)
    slow, fast = np.sin(2 * np.pi * 20 * t / 8000), np.sin(2 * np.pi * 3000 * t / 8000)
    sig = spark.createDataFrame([("a", int(i), float(v)) for i, v in enumerate(slow + fast + 5)], SIG)
    got = per_channel(signals.lowpass_decimated(sig, 8000, 300.0, taps=129))["a"]
    assert len(got) == 500
    np.testing.assert_allclose(got[20:-20], (slow + 5)[::8][20:-20], atol=0.01)
    np.testing.assert_allclose(got[:3], 5, atol=0.3)


def test_wavelet_taps():
    w = signals.wavelet_taps()
    assert len(w) == 5 and abs(sum(w)) < 1e-12
    psi = signals.wavelet(9)
    step = 2.0**-9
    assert abs(psi.sum() * step) < 1e-9 and (psi**2).sum() * step == pytest.approx(1, abs=0.01)
    assert abs((psi * np.arange(len(psi)) * step).sum() * step) < 1e-3  # two vanishing moments


def test_fir_is_a_convolution(noise):
    taps = [0.5, -1.0, 2.0, 0.25]
    for factor, ahead in ((1, 2), (3, 1), (1, 0)):
        got = per_channel(signals.fir(noise, taps, factor, ahead))
        for c, x in per_channel(noise).items():
            full = np.convolve(x, taps)
            want = np.pad(full, (0, ahead + factor))[ahead : ahead + len(x)][::factor]
            np.testing.assert_allclose(got[c], want, atol=1e-9)


@pytest.mark.parametrize("n", [1, 12, 97, 360, 1001])
def test_bandpass_is_that_of_the_whole_transform(spark, n):
    x = np.random.default_rng(n).normal(1, 2, n)
    spectrum, f = np.fft.rfft(x), np.fft.rfftfreq(n, 1 / 1000)
    spectrum[(f < 50) | (f > 300)] = 0
    sig = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], SIG)
    np.testing.assert_allclose(per_channel(signals.fft_bandpass(sig, 1000.0, 50.0, 300.0))["a"], np.fft.irfft(spectrum, n) if n > 1 else [0.0], atol=1e-9)


def greedy(rows, gap):
    kept = []
    for x, t, ch in sorted({(x, t, ch) for _, ch, t, x in rows}):
        if all(abs(t - k[1]) > gap for k in kept):
            kept.append((x, t, ch))
    return set(kept)


@pytest.mark.parametrize("rounds", [1, 4])
def test_suppression_in_rounds_is_the_greedy_one(spark, rounds):
    r = np.random.default_rng(rounds)
    rows = [(g, f"c{r.integers(4)}", int(t), float(-r.integers(1, 30))) for g in (1, 2) for t in r.integers(0, 2600, 500)]
    rows += [(3, "c", t, float(-t)) for t in range(60)]  # a chain of ever larger peaks
    rows += [(4, c, 1024 * k + d, -5.0) for k in (1, 2) for d in (-1, 0, 2, 3) for c in "ab"] + [(5, "a", 7, -1.0)] * 3
    df = spark.createDataFrame(rows, "grp long, ch string, t long, x double")
    got = signals.refractory(df, "grp", 3, rounds).collect()
    assert len(got) == len({tuple(g) for g in got})
    for g in range(1, 6):
        assert {(k.x, k.t, k.ch) for k in got if k.grp == g} == greedy([x for x in rows if x[0] == g], 3)
    assert signals.refractory(df.where("false"), "grp").count() == 0


TEMPLATES, P = np.array([[-2.0, 3.0, 1.0], [1.0, -3.0, 2.0]]), np.array([0.05, 0.08])


def stream_signal(n, seed=5):
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.7, n)
    for t in r.integers(1, n - 4, n // 8):
        x[t : t + 3] += TEMPLATES[r.integers(2)]
    return x


def trellis():
    states = hmm.joint_states(2, 3, 2)
    return lanes.Trellis(states, hmm.predecessors(states, 3, P), TEMPLATES, 1.3)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40, 200])
def test_online_states_are_those_of_the_whole_for_every_cut(size):
    x = stream_signal(160)
    model = trellis()
    whole, _ = hmm.viterbi(x, model.states, model.moves, TEMPLATES, 1.3)
    decoder, told, waiting = lanes.Online(model), [], []
    for a in range(0, len(x), size):
        told += decoder.push(x[a : a + size]).tolist()
        assert told == whole[: len(told)].tolist()
        waiting.append(len(decoder.back))
    told += decoder.close().tolist()
    assert told == whole.tolist() and (size > 7 or max(waiting) < 60)


def test_stream_in_any_order_tells_what_the_batch_does(spark, tmp_path):
    rows = [(c, t, float(v)) for c, seed in (("a", 5), ("b", 6)) for t, v in enumerate(stream_signal(120, seed))]
    ends = [("a", 120, None), ("b", 120, None)]
    cuts = [[r for r in rows if r[1] % 5 == 1], [r for r in rows if r[1] % 5 != 1 and r[1] < 70], [r for r in rows if r[1] % 5 != 1 and r[1] >= 60] + ends, rows[:30]]
    for k, part in enumerate(cuts):
        spark.createDataFrame(part, SIG).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(SIG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    found = streaming.stream_decode(source, TEMPLATES, P, 1.3)
    q = found.writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = hmm.decode(spark.createDataFrame(rows, SIG), TEMPLATES, P, 1.3)
    assert sorted(map(tuple, spark.table("online").collect())) == sorted(map(tuple, batch.collect()))


# ---------------------------------------------------------------- files


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("recordings")
    rows = spark.range(4 * 3 * 500).select(F.concat(F.lit("r"), F.floor(F.col("id") / 1500)).alias("file"), (F.floor(F.col("id") / 500) % 3).cast("int").alias("ch"), (F.col("id") % 500).alias("t"), (F.col("id") % 251).cast("double").alias("x"))
    listed = recordings.write_signals(rows, str(folder), 30_000).collect()
    assert sorted(r.name for r in listed) == ["r0", "r1", "r2", "r3"] and sorted(os.listdir(folder)) == ["r0", "r1", "r2", "r3"]
    return str(folder), rows


def test_written_files_are_read_back(spark, stored):
    folder, rows = stored
    got = recordings.samples(spark, folder).select(F.element_at(F.split("file", "/"), -1).alias("file"), "ch", "t", "x")
    assert got.exceptAll(rows.select(*got.columns)).count() == 0 and got.count() == rows.count()


def planned(filters, folder, **options):
    r = recordings.RecordingReader({"path": folder, "samples": "true", "samplespertask": "100", **options}, None)
    assert list(r.pushFilters(filters)) == filters
    return r.partitions()


def test_predicates_become_ranges(spark, stored):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

    folder, rows = stored
    assert len(planned([], folder)) == 4 * 5
    some = planned([GreaterThanOrEqual(("t",), 120), LessThan(("t",), 180), In(("ch",), (2, 0, 9))], folder)
    assert {(p.start, p.stop, p.channels) for p in some} == {(120, 180, (0, 2))} and len(some) == 4
    one = planned([GreaterThan(("t",), 119), LessThanOrEqual(("t",), 120), EqualTo(("ch",), 1), EqualTo(("file",), f"{folder}/r2")], folder)
    assert [(p.path, p.start, p.stop, p.channels) for p in one] == [(f"{folder}/r2", 120, 121, (1,))]
    assert planned([EqualTo(("ch",), 7)], folder) == [] and planned([GreaterThan(("t",), 10**6)], folder) == []
    got = recordings.samples(spark, folder).where("ch = 1 AND t BETWEEN 120 AND 179 AND x > 3")
    assert "ch" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == rows.where("ch = 1 AND t BETWEEN 120 AND 179 AND x > 3").count()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("f"), F.col("id") % 5).alias("file"), F.lit(0).alias("ch"), F.floor(F.col("id") / 5).alias("t"), F.when(F.col("id") == 777, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("double").alias("x"))
    with pytest.raises(Exception, match="stop"):
        recordings.write_signals(rows, str(tmp_path), 1000)
    assert os.listdir(tmp_path) == []


def test_a_write_that_fails_in_its_sink_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("good", 0, 0, 1.0), ("good", 0, 1, 2.0), ("bad", -9, 0, 1.0)], "file string, ch int, t long, x double")
    with pytest.raises(Exception, match="bounds"):
        recordings.write_signals(rows, str(tmp_path), 1000, channels=2)
    assert os.listdir(tmp_path) == []


def test_paths_need_a_scheme_on_a_cluster():
    class Context:
        master = "spark://x"

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="scheme"):
        recordings.shared_path(Session(), "/data/x")
    assert recordings.shared_path(Session(), "hdfs://data/x") == "hdfs://data/x"


def test_learning_from_files_and_gathering(spark, tmp_path):
    r = np.random.default_rng(3)
    wave = np.array([0.0, -60.0, -90.0, 50.0, 30.0, 0.0])
    rows = []
    for f in ("r0", "r1"):
        x = r.normal(0, 5, 3000)
        for t in range(20, 2900, 60):
            x[t : t + 6] += wave
        rows += [(f, 1, t, float(v)) for t, v in enumerate(x)] + [(f, 0, t, 0.0) for t in range(3000)]
    recordings.write_signals(spark.createDataFrame(rows, "file string, ch int, t long, x double"), f"{tmp_path}/in", 30_000)
    for k, (a, z) in enumerate(((0, 1500), (1500, 3000))):
        sets = templates.learn_files(spark, f"{tmp_path}/in", 1, f"file://{tmp_path}/sets/part{k}", a, z, rings=2, length=6, iterations=3, start=1e-2, min_rate=1.0, small=0.5)
        assert len(sets["after_noise"][0])
    found = templates.sets_under(spark, f"file://{tmp_path}/sets/*")
    assert {r.part.rsplit("/", 1)[-1] for r in found.collect()} == {"part0", "part1"}
    sig = recordings.samples(spark, f"{tmp_path}/in").where("ch = 1").select(F.col("file").alias("ch"), "t", "x")
    got, p, _ = templates.gather_files(f"file://{tmp_path}/sets/*", sig, factor=0.5)
    best = min(((np.roll(t, s) - wave) ** 2).sum() / (wave**2).sum() for t in got for s in range(6))
    assert best < 0.05 and len(p) == len(got)


def test_mat_files(spark, tmp_path):
    import struct
    import zlib

    from voltair.sources import mat

    def matrix(kind, name, dims, *parts, order="<"):
        put = lambda k, c: struct.pack(order + "II", k, len(c)) + c + bytes(-len(c) % 8)
        ints = lambda v: struct.pack(order + f"{len(v)}i", *v)
        small = struct.pack(order + "I", len(name) << 16 | 1) + name.ljust(4, b"\0") if 0 < len(name) <= 4 else put(1, name)
        return put(14, put(6, struct.pack(order + "II", kind, 0)) + put(5, ints(dims)) + small + b"".join(parts))

    part = lambda k, c, order="<": struct.pack(order + "II", k, len(c)) + c + bytes(-len(c) % 8)
    inner = matrix(12, b"", [1, 3], part(3, struct.pack("<3h", 7, -8, 9)))
    field = matrix(2, b"rec", [1, 1], struct.pack("<I", 4 << 16 | 5) + struct.pack("<i", 8), part(1, b"x".ljust(8, b"\0") + b"y".ljust(8, b"\0")), inner, matrix(4, b"", [1, 2], part(16, b"hi")))
    cell = matrix(1, b"c", [1, 2], matrix(6, b"", [2, 2], part(9, struct.pack("<4d", 1, 2, 3, 4))), struct.pack("<II", 14, 0))
    packed = zlib.compress(matrix(9, b"bytes", [2, 1], part(2, b"\x05\xff")))
    head = lambda sign, v: b"x".ljust(124) + v + sign
    (tmp_path / "a.mat").write_bytes(head(b"IM", b"\0\1") + field + cell + struct.pack("<II", 15, len(packed)) + packed)
    (tmp_path / "b.mat").write_bytes(head(b"MI", b"\1\0") + matrix(6, b"big", [1, 2], part(9, struct.pack(">2d", 1.5, -2)  , ">"), order=">"))
    got = {(r.file[-5:], r.name): (r["class"], r.dims, r.x, r.text) for r in mat.read(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.mat", "rec.x"): ("int32", [1, 3], [7, -8, 9], None), ("a.mat", "rec.y"): ("char", [1, 2], [104, 105], "hi"), ("a.mat", "c{1}"): ("double", [2, 2], [1, 2, 3, 4], None),
        ("a.mat", "c{2}"): ("double", [0, 0], [], None), ("a.mat", "bytes"): ("uint8", [2, 1], [5, 255], None), ("b.mat", "big"): ("double", [1, 2], [1.5, -2], None),
    }
    rows = [("cell01", [1.5, 2.5], [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), ("cell02", [], [[0.0]])]
    mat.write_spiketrains(spark.createDataFrame(rows, "cell string, ts_ms array<double>, spike_form array<array<double>>"), f"{tmp_path}/out")
    back = {(r.file[-10:-4], r.name): (r.dims, r.x) for r in mat.read(spark, f"{tmp_path}/out").collect()}
    assert back == {("cell01", "timestamps"): ([1, 2], [1.5, 2.5]), ("cell01", "spikeForm"): ([2, 3], [1, 4, 2, 5, 3, 6]), ("cell02", "timestamps"): ([1, 0], []), ("cell02", "spikeForm"): ([1, 1], [0.0])}
    assert {r["class"] for r in mat.read(spark, f"{tmp_path}/out").collect()} == {"double"}


def test_planted_overlaps_are_accepted(spark):
    from voltair.operators import waves

    r = np.random.default_rng(12)
    shapes = r.normal(0, 1, (3, 20))
    shapes[:, :4] = shapes[:, -4:] = 0
    rows = [(100 * (u + 1) + k, u + 1, p, float(v + r.normal(0, 0.01))) for u in range(3) for k in range(5) for p, v in enumerate(shapes[u])]
    planted = {0: (1, 2, -2, 3), 1: (2, 3, 0, 0), 2: (1, 3, 1, -1)}
    for s, (a, b, i, j) in planted.items():
        rows += [(s, 0, p, float(v)) for p, v in enumerate(np.roll(shapes[a - 1], i) + np.roll(shapes[b - 1], j) + r.normal(0, 0.05, 20))]
    rows += [(3, 0, p, float(v)) for p, v in enumerate(r.normal(0, 1, 20))] + [(4, 0, p, 0.0) for p in range(20)]
    wave = spark.createDataFrame(rows, "spike long, unit long, pos long, v double")
    found = waves.accepted_overlaps(wave, 0.05)
    assert {x.spike: (x.unit1, x.unit2, x.shift1, x.shift2) for x in found.collect()} == planted
    assert waves.overlap_table(found).count() == 6
