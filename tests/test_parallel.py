"""The model run in chunks, online, with flipped decisions, and with transitions of one's own: each against the whole, or against all paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltair.operators import chunks, hmm, lanes

TEMPLATES, P, PRECISION = np.array([[-2.0, 3.0, 1.0], [1.0, -3.0, 2.0]]), np.array([0.05, 0.08]), 1.3


def recording(n, seed, templates=TEMPLATES):
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.8, n)
    for t in r.integers(1, max(2, n - 5), n // 9):
        k = r.integers(len(templates))
        part = templates[k][: n - t]
        x[t : t + len(part)] += part
    return x


def model(active=2):
    states = hmm.joint_states(2, 3, active)
    return states, hmm.predecessors(states, 3, P)


def run_of(x, chunk, halo):
    """Sections as Lanes, by hand."""
    leads, owns, firsts, lasts, xs = [], [], [], [], []
    for a in range(0, len(x), chunk):
        lo, hi = max(0, a - halo), min(len(x), a + chunk + halo)
        leads.append(a - lo)
        owns.append(min(chunk, len(x) - a))
        firsts.append(a - halo <= 0)
        lasts.append(a + chunk + halo > len(x) - 1)
        xs.append(x[lo:hi])
    return chunks.Lanes(leads, owns, firsts, lasts, xs)


@pytest.mark.parametrize("chunk,halo", [(40, 60), (33, 50), (500, 1), (7, 60)])
def test_lanes_decode_what_the_whole_decodes(chunk, halo):
    x = recording(211, 3)
    states, moves = model()
    whole, score = hmm.viterbi(x, states, moves, TEMPLATES, PRECISION)
    out = lanes.Trellis(states, moves, TEMPLATES, PRECISION, second=True).decode(run := run_of(x, chunk, halo))
    path = np.concatenate([out["path"][i, : run.own[i]] for i in range(len(run.own))])
    np.testing.assert_array_equal(path, whole)
    assert out["score"].sum() == pytest.approx(score)
    margins = hmm.path_margins(x, whole, states, moves, TEMPLATES, PRECISION)
    np.testing.assert_allclose(np.concatenate([out["margin"][i, : run.own[i]] for i in range(len(run.own))])[1:], margins[1:], atol=1e-9)
    assert all(out["sout"][i] == out["sin"][i + 1] for i in range(len(run.own) - 1))


@pytest.mark.parametrize("chunk,halo", [(40, 120), (500, 1), (9, 120)])
def test_lanes_sum_what_the_whole_sums(chunk, halo):
    x = recording(211, 4)
    means = np.concatenate([[0.0], TEMPLATES.ravel()])
    g = hmm.forward_backward(x, TEMPLATES, P, PRECISION)
    out = lanes.posterior(run_of(x, chunk, halo), means, 3, P, PRECISION)
    np.testing.assert_allclose(out["g"].sum(0), g.sum(1), atol=1e-7)
    np.testing.assert_allclose(out["gxx"].sum(0), g @ (x * x), atol=1e-7)
    np.testing.assert_allclose(out["fout"][:-1], out["fin"][1:], atol=1e-9)
    np.testing.assert_allclose(out["bin"][:-1], out["bout"][1:], atol=1e-9)


def all_paths(states, moves, x, end=None):
    trellis = lanes.Trellis(states, moves, TEMPLATES, PRECISION)
    move = {(int(w), i): lp for i in range(len(states)) for w, lp in zip(moves.who[moves.of(i)], moves.log_p[moves.of(i)], strict=True)}
    ways = [((0,), 0.0)]
    for t in range(1, len(x)):
        ways = [((*path, i), s + move[path[-1], i] - 0.5 * PRECISION * (x[t] - trellis.means[i]) ** 2) for path, s in ways for i in range(len(states)) if (path[-1], i) in move]
    return sorted(((s, path) for path, s in ways if end is None or path[-1] == end), key=lambda w: -w[0])


@pytest.mark.parametrize("end", [None, 0])
def test_the_best_paths_are_those_of_enumeration(end):
    x = np.array([0.0, -1.9, 3.2, 0.8, 1.2, -2.7, 2.1])
    states, moves = model()
    every = all_paths(states, moves, x, end)
    got = hmm.k_best(x, states, moves, TEMPLATES, PRECISION, 40, end)
    np.testing.assert_allclose([s for s, _ in got], [s for s, _ in every[:40]])
    assert len({tuple(p) for _, p in got}) == min(40, len(every))
    scores = {p: s for s, p in every}
    assert all(scores[tuple(p)] == pytest.approx(s) for s, p in got)


def test_flips_take_the_second_best_way():
    x = recording(60, 8)
    states, moves = model()
    trellis = lanes.Trellis(states, moves, TEMPLATES, PRECISION, second=True)
    run = run_of(x, 100, 1)
    best = trellis.decode(run)
    margins = best["margin"][0]
    for t in np.flatnonzero(np.isfinite(margins)):
        flips = np.zeros((1, 60), bool)
        flips[0, t] = True
        again = trellis.decode(run, flips)
        assert again["score"][0] == pytest.approx(best["score"][0] - margins[t])
        np.testing.assert_array_equal(again["path"][0, t:], best["path"][0, t:])
        assert again["path"][0, t - 1] != best["path"][0, t - 1]


def as_dict(moves, states):
    return {(tuple(states[w]), tuple(states[i])): round(lp, 12) for i in range(len(states)) for w, lp in zip(moves.who[moves.of(i)], moves.log_p[moves.of(i)], strict=True)}


def test_ring_matrices_give_the_ways_of_rings():
    for n, active in ((2, 1), (2, 2), (3, 2)):
        states, p = hmm.joint_states(n, 4, active), np.array([0.1, 0.2, 0.05])[:n]
        assert as_dict(hmm.ring_moves(states, [hmm.ring_matrix(4, v) for v in p]), states) == as_dict(hmm.predecessors(states, 4, p), states)


def test_own_transitions_and_a_forced_end_are_those_of_enumeration():
    r = np.random.default_rng(2)
    states = hmm.joint_states(2, 3, 2)
    matrices = [m / m.sum(1, keepdims=True) for m in (r.random((4, 4)) * (r.random((4, 4)) < 0.6) + np.eye(4) * 0.1 for _ in range(2))]
    joint = {((0, 0), (1, 1)): 0.0, ((0, 0), (2, 3)): 0.25}
    moves = hmm.ring_moves(states, matrices, joint)
    chance = {k: np.exp(v) for k, v in as_dict(moves, states).items()}
    for (a, b), c in chance.items():
        assert c == pytest.approx(joint.get((a, b), matrices[0][a[0], b[0]] * matrices[1][a[1], b[1]]))
    assert ((0, 0), (1, 1)) not in chance
    x = np.array([0.0, 1.5, -0.7, 2.2, 0.4])
    out = lanes.Trellis(states, moves, TEMPLATES, PRECISION).decode(run_of(x, 10, 1), end=0)
    score, path = all_paths(states, moves, x, end=0)[0]
    assert out["score"][0] == pytest.approx(score) and tuple(out["path"][0]) == path
    assert tuple(lanes.Trellis(states, moves, TEMPLATES, PRECISION).decode(run_of(x, 10, 1))["path"][0]) == all_paths(states, moves, x)[0][1]


@pytest.fixture(scope="module")
def sig(spark):
    rows = [(c, t + 5, float(v)) for c, seed in (("a", 1), ("b", 2)) for t, v in enumerate(recording(700 if c == "a" else 333, seed))]
    return spark.createDataFrame(rows, "ch string, t long, x double").cache()


def whole_paths(sig):
    states, moves = model()
    rows = sig.toPandas().sort_values(["ch", "t"])
    return {c: hmm.viterbi(g["x"].to_numpy(), states, moves, TEMPLATES, PRECISION) for c, g in rows.groupby("ch")}


@pytest.mark.parametrize("patch,halo", [(97, None), (50, 2), (2000, None)])
def test_channels_decoded_in_chunks(sig, patch, halo):
    """A halo that is too short is seen and made longer."""
    states, moves = model()
    done = hmm.decoded_chunks(sig, states, moves, TEMPLATES, PRECISION, patch, halo)
    assert done.count() == sum(-(-n // patch) for n in (700, 333))
    for c, (path, score) in whole_paths(sig).items():
        parts = done.where(F.col("ch") == c).orderBy("k").collect()
        assert [v for part in parts for v in part.path] == path.tolist()
        assert sum(part.score for part in parts) == pytest.approx(score)


def test_sums_do_not_depend_on_chunks(sig):
    whole = hmm.posterior_sums(sig, TEMPLATES, P, PRECISION, chunk=5000).toPandas().sort_values("state")
    for chunk, halo in ((64, None), (90, 2)):
        part = hmm.posterior_sums(sig, TEMPLATES, P, PRECISION, chunk, halo).toPandas().sort_values("state")
        np.testing.assert_allclose(part.to_numpy(float), whole.to_numpy(float), rtol=1e-7)
    x = sig.where("ch = 'a'").orderBy("t").toPandas()["x"].to_numpy()
    y = sig.where("ch = 'b'").orderBy("t").toPandas()["x"].to_numpy()
    g = sum(hmm.forward_backward(v, TEMPLATES, P, PRECISION).sum(1) for v in (x, y))
    np.testing.assert_allclose(whole["g"], g, rtol=1e-9)
    assert set(whole["samples"]) == {1033}


def test_uncertain_decisions_are_flipped(sig):
    states, moves = model()
    weak = hmm.uncertain(sig, TEMPLATES, P, PRECISION, 1.0, patch=120).collect()
    assert weak
    for c, (path, _) in whole_paths(sig).items():
        x = sig.where(F.col("ch") == c).orderBy("t").toPandas()["x"].to_numpy()
        margins = hmm.path_margins(x, path, states, moves, TEMPLATES, PRECISION)
        assert sorted(w.t - 5 for w in weak if w.ch == c) == np.flatnonzero(margins < 1.0).tolist()
    one = sig.sparkSession.createDataFrame([(weak[0].ch, weak[0].t)], "ch string, t long")
    flipped = {tuple(r) for r in hmm.redecode(sig, one, TEMPLATES, P, PRECISION, patch=120).collect()}
    best = {tuple(r) for r in hmm.decode(sig, TEMPLATES, P, PRECISION, patch=120).collect()}
    assert flipped != best and {r for r in flipped ^ best if r[0] != weak[0].ch or r[2] > weak[0].t} == set()


def test_alternatives_of_stretches(sig):
    states, moves = model()
    found = hmm.alternatives(sig, TEMPLATES, P, PRECISION, 3, patch=100).collect()
    best = {(r.ch, r.template_id, r.t) for r in hmm.decode(sig, TEMPLATES, P, PRECISION).where("state = 1").collect()}
    assert {(f.ch, s.template_id, s.t) for f in found if f.place == 1 for s in f.spikes} == best
    assert all(f.loss >= 0 and (f.loss == 0 or f.place > 1) for f in found)
    one = next(f for f in found if f.place == 2)
    x = sig.where((F.col("ch") == one.ch) & F.col("t").between(one.t0 - 1, one.t1 + 1)).orderBy("t").toPandas()["x"].to_numpy()
    every = all_paths(states, moves, x, 0)
    assert one.loss == pytest.approx(every[0][0] - every[1][0])


def test_decoding_with_own_transitions(sig):
    matrices = [hmm.ring_matrix(3, p) for p in P]
    states, moves = model()
    x = sig.where("ch = 'b'").orderBy("t").toPandas()["x"].to_numpy()
    got = {(r.template_id, r.t - 5, r.state) for r in hmm.decode_rings(sig, TEMPLATES, matrices, PRECISION, patch=80).where("ch = 'b'").collect()}
    path = lanes.Trellis(states, moves, TEMPLATES, PRECISION).decode(run_of(x, 1000, 1), end=0)["path"][0]
    at, ring = np.nonzero(states[path])
    assert got == {(int(r), int(t), int(states[path[t]][r])) for t, r in zip(at, ring, strict=True)} and path[-1] == 0


def test_groups_in_chunks_are_the_whole(spark):
    from voltair.operators import groups

    r = np.random.default_rng(17)
    waves = np.stack([TEMPLATES, -TEMPLATES[::-1] * 0.7], 1)  # (rings, channels, length)
    precision = np.linalg.inv(np.array([[0.5, 0.2], [0.2, 0.6]]))
    x = r.normal(0, 0.6, (420, 2))
    for t in range(7, 410, 13):
        x[t : t + 3] += waves[t % 2].T
    times = np.sort(r.choice(600, 420, replace=False))  # instants with gaps
    rows = [("g", c, int(t), float(x[i, c])) for i, t in enumerate(times) for c in range(2)] + [("g", 0, 700, 1.0)]
    sig = spark.createDataFrame(rows, "grp string, ch long, t long, x double")
    states, moves = model()
    whole, _ = hmm.viterbi(x, states, moves, waves, precision)
    margins = hmm.path_margins(x, whole, states, moves, waves, precision)
    at, ring = np.nonzero(states[whole])
    got = {(g.template_id, g.t): (g.state, g.margin) for g in groups.decode(sig, [0, 1], waves, P, precision, patch=60).collect()}
    assert set(got) == {(int(k), int(times[t])) for t, k in zip(at, ring, strict=True)}
    for t, k in zip(at, ring, strict=True):
        state, margin = got[int(k), int(times[t])]
        assert state == states[whole[t]][k] and margin == pytest.approx(margins[t])
    rows = groups.side_by_side(sig, [0, 1])
    g = hmm.forward_backward(x, waves, P, precision)
    part = {k: v.sort_values("i")["value"].to_numpy() for k, v in groups.sums(rows, waves, P, precision, chunk=50).toPandas().groupby("kind")}
    np.testing.assert_allclose(part["g"], g.sum(1), rtol=1e-7)
    np.testing.assert_allclose(part["gx"].reshape(-1, 2), g @ x, rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(part["xx"].reshape(2, 2), x.T @ x, rtol=1e-9)
    assert part["n"][0] == 420


def test_learning_until_stable_merges_equal_templates(spark):
    r = np.random.default_rng(5)
    wave = np.array([-4.0, -9.0, 6.0, 2.0])
    x = r.normal(0, 0.5, 1500)
    for t in range(15, 1480, 25):
        x[t : t + 4] += wave
    sig = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "ch string, t long, x double")
    templates, p, _ = hmm.learn_until_stable(sig, iterations=6, rounds=3, rings=2, length=8, start=1e-2, update_p=True)
    padded = np.concatenate([wave, np.zeros(4)])
    assert 1 <= len(templates) <= 2
    assert min(((np.roll(t, s) - padded) ** 2).sum() / (wave**2).sum() for t in templates for s in range(8)) < 0.1


def test_neighbours_across_buckets(spark):
    from pyspark.sql import Window

    from voltair.operators.ordered import beside

    r = np.random.default_rng(3)
    rows = [(str(r.integers(3)), int(t), int(i), float(r.normal())) for i, t in enumerate(r.integers(-50, 900, 200))]
    df = spark.createDataFrame(rows, "unit string, us long, spike long, v double")
    w = Window.partitionBy("unit").orderBy("us", "spike")
    want = df.select("*", F.lag("v").over(w).alias("b"), F.lead("us").over(w).alias("a"))
    for width in (1, 40, 10_000):
        got = beside(df, "unit", ["us", "spike"], width, before={"b": "v"}, after={"a": "us"})
        assert got.exceptAll(want).count() == 0 and got.count() == 200
