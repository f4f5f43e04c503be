"""Channel lists, staged learning and groups of channels: brute force, planted waveforms, resumption."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltair import plans
from voltair.operators import bandjoin, channels, groups, hmm, templates, waves


def test_channel_lists():
    assert channels.channel_list("0-3,7") == [0, 1, 2, 3, 7]
    assert channels.channel_list(" 5 ,2-2") == [5, 2] and channels.channel_list("") == []


def test_file_numbers(spark):
    names = spark.createDataFrame([("a_0012.bin",), ("x7y10",), ("none",)], "name string")
    assert [r.n for r in names.select(channels.file_number(F.col("name")).alias("n")).collect()] == [12, 10, None]


def test_near_other_is_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, int(u), int(t)) for i, (u, t) in enumerate(zip(r.integers(0, 4, 300), r.integers(-2000, 2000, 300), strict=True))] + [(300, 0, None), (301, 1, 7), (302, 1, 7)]
    got = bandjoin.near_other(spark.createDataFrame(rows, "spike long, unit long, at long"), "at", 9, "unit", "met")
    expected = {i: t is not None and any(v != u and s is not None and abs(s - t) < 9 for _, v, s in rows) for i, u, t in rows}
    assert {x.spike: x.met for x in got.collect()} == expected


def planted(spark, rate=61):
    r = np.random.default_rng(1234)
    wave = np.array([0.0, -4.0, -7.0, 5.0, 3.0, 0.5])
    x = r.normal(0, 0.5, 4000)
    for t in range(30, 3900, rate):
        x[t : t + 6] += wave
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "ch string, t long, x double"), wave


def test_stages_recover_a_template_and_resume(spark, tmp_path, monkeypatch):
    sig, wave = planted(spark)
    options = {"rate": 1000.0, "rings": 2, "length": 8, "iterations": 6, "start": 1e-2, "update_p": True}
    found = templates.learn(sig, str(tmp_path), **options)
    last, p, _ = found["second_after_noise"]
    padded = np.concatenate([wave, [0, 0]])
    assert min(((np.roll(t, s) - padded) ** 2).sum() for t in last for s in range(8)) < 0.05 * (wave**2).sum()
    assert p.sum() == pytest.approx(1 / 61, rel=0.3)
    monkeypatch.setattr(hmm, "learn", lambda *a, **k: pytest.fail("a finished stage was computed again"))
    again = templates.learn(sig, str(tmp_path), **options)
    for name in found:
        np.testing.assert_array_equal(found[name][0], again[name][0])


def test_a_set_without_templates_ends_the_stages(spark, tmp_path):
    sig, _ = planted(spark)
    found = templates.learn(sig, str(tmp_path), rate=1000.0, rings=1, length=8, iterations=1, min_snr=1e9)
    assert list(found)[-1] == "after_noise" and len(found["after_noise"][0]) == 0
    assert templates.load(spark, str(tmp_path), "after_noise") is None and templates.load(spark, str(tmp_path), "never") is None


def test_split_gives_a_rare_template_a_share():
    t = np.array([[1.0, 1.0], [9.0, -9.0], [0.1, 0.1]])
    got, p = hmm.split_sparse(t, np.array([1e-6, 0.2, 1e-7]), 1.0, 1e-5, np.random.default_rng(0))
    np.testing.assert_allclose(got[0], 0.98 * t[1])
    np.testing.assert_allclose(p, [0.1, 0.1, 1e-7])


def test_gather_merges_equal_templates_of_parts(spark):
    sig, wave = planted(spark)
    rows = [(k, 2000, 0, 0.01 * (k + 1), 4.0 / (k + 1), [*wave.tolist(), 0.0, 0.0]) for k in range(2)]
    parts = spark.createDataFrame(rows, "part long, n long, " + templates.TEMPLATES)
    merged, p, precision = templates.gather(parts, sig, 0.1)
    assert len(merged) == 1 and p[0] == pytest.approx(0.015) and precision == pytest.approx(1 / (0.5 * (0.25 + 0.5)))


WAVES = np.array([[[-3.0, 4.0, 1.0], [0.0, -2.0, 2.0]], [[2.0, -4.0, 1.0], [3.0, 3.0, -1.0]]])


def recording(spark, samples=400):
    r = np.random.default_rng(9)
    x = r.normal(0, 0.3, (samples, 2))
    onset = [(t, k % 2) for k, t in enumerate(range(11, samples - 10, 17))]
    for t, k in onset:
        x[t : t + 3] += WAVES[k].T
    rows = [("g", c, i, float(x[i, c])) for i in range(samples) for c in range(2)]
    return spark.createDataFrame(rows, "grp string, ch long, t long, x double"), onset, x


def test_groups_decode_planted_waveforms_with_margins(spark):
    sig, onset, x = recording(spark)
    args = (WAVES, np.full(2, 0.03), np.eye(2) / 0.09)
    found = groups.decode(sig, [0, 1], *args).collect()
    assert sorted((s.t, s.template_id) for s in found if s.state == 1) == onset
    assert all(s.margin > 0 for s in found)
    # one channel alone gives what the plain decoder gives
    states = hmm.joint_states(2, 3, 2)
    model = (states, hmm.predecessors(states, 3, np.full(2, 0.03)))
    a, b = hmm.viterbi(x[:, 0], *model, WAVES[:, 0], 11.0), hmm.viterbi(x[:, :1], *model, WAVES[:, :1], np.array([[11.0]]))
    np.testing.assert_array_equal(a[0], b[0])
    assert a[1] == pytest.approx(b[1])


def test_groups_learn_from_a_rough_guess(spark):
    sig, onset, _ = recording(spark, 1500)
    got, p, precision = groups.learn(sig, [0, 1], WAVES * 0.7, np.full(2, 0.03), np.eye(2), 5, update_p=True)
    assert ((got - WAVES) ** 2).sum() < 0.05 * (WAVES**2).sum()
    assert p.sum() == pytest.approx(len(onset) / 1500, rel=0.15)
    np.testing.assert_allclose(np.linalg.inv(precision), np.eye(2) * 0.09, atol=0.02)


def test_projection_searches_all_positions(spark):
    rows = [(k, k % 2, pos, float((k % 2) * {3: 1, 40: 5, 50: 4, 63: 3}.get(pos, 0))) for k in range(4) for pos in range(64)]
    got = waves.best_projection_all(spark.createDataFrame(rows, "spike long, unit long, pos long, v double")).collect()
    assert [tuple(x) for x in got] == [(0, 1, 40, 50, 63)]


@pytest.mark.parametrize("name", ["noise_cov_all", "pooled_cov_all"])
def test_covariances_have_all_positions(spark, sf, name):
    got = {(x.i, x.j) for x in plans.QUERIES[name](spark, sf).collect()}
    assert got == {(i, j) for i in range(64) for j in range(i, 64)}
