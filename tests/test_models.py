"""Models on seeded synthetic data."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from pitchlake.config import ChangepointConfig, HmmConfig, MixtureConfig, PreprocessConfig
from pitchlake.models import changepoint, labels, mixture, preprocessing, sequence


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centres = [(0, 0), (8, 0), (4, 8)]
    rows = [(i, "m", "t", i % 3, *map(float, rng.normal(centres[i % 3], 0.5))) for i in range(300)]
    return spark.createDataFrame(rows, "i int, match_id string, team_id string, truth int, t1_x double, t1_y double").repartition(4).persist()


def test_selection_and_agreement(spark, blobs):
    m, table = mixture.select_mixture(blobs, ["t1_x", "t1_y"], MixtureConfig(2, 4, n_init=2, max_iter=30))
    assert m.k == 3 and len(table) == 3
    found = m.predict(blobs, ["i", "truth"])
    assert all(abs(sum(r[f"state_prob_{k}"] for k in range(3)) - 1) < 1e-9 for r in found.collect())
    a = labels.agreement(found, "state_label", "truth").first()
    assert a.ari == pytest.approx(1) and a.nmi == pytest.approx(1)
    again = mixture.GaussianMixture.from_json(m.to_json())
    assert again.bic == pytest.approx(m.bic)


@pytest.mark.parametrize("kind", ["tied", "diag", "spherical"])
def test_covariances(blobs, kind):
    m = mixture.fit_mixtures(blobs, ["t1_x", "t1_y"], [3], MixtureConfig(3, 3, kind, n_init=2, max_iter=20))[3]
    assert np.isfinite(m.bic) and m.n == 300


def test_hmm(spark):
    rng = np.random.default_rng(1)
    rows = [(f"m{s}", "t", i, float(rng.normal((i // 10) % 2 * 10, 0.5)), float(rng.normal(0, 0.5)), (i // 10) % 2) for s in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "match_id string, team_id string, i int, x double, y double, truth int").persist()
    seed = mixture.fit_mixtures(df, ["x", "y"], [2], MixtureConfig(2, 2, n_init=2, max_iter=20))[2]
    hmm = sequence.fit_hmm(df, ["x", "y"], ["match_id", "team_id"], ["i"], seed, HmmConfig(2, max_iter=5))
    assert hmm.move.sum(1) == pytest.approx(np.ones(2))
    out = hmm.decode(df, ["match_id", "team_id"], ["i"]).join(df.select("match_id", "i", "truth"), ["match_id", "i"])
    assert labels.agreement(out, "hmm_state_label", "truth").first().ari > 0.9
    assert hmm.transitions(spark).count() == 4


def test_preprocessing(spark, blobs):
    p = preprocessing.Preprocessor(PreprocessConfig("t", "drop_rows", None)).fit(blobs)
    z = np.array([(r.z0, r.z1) for r in p.transform(blobs, ["i"]).collect()])
    assert z.mean(0) == pytest.approx([0, 0], abs=1e-9) and z.std(0) == pytest.approx([1, 1])
    assert preprocessing.Preprocessor.from_json(p.to_json()).mean == pytest.approx(p.mean)
    q = preprocessing.Preprocessor(PreprocessConfig("t", "drop_rows", 1.0)).fit(blobs)
    assert q.explained.sum() == pytest.approx(1)
    with pytest.raises(RuntimeError):
        preprocessing.Preprocessor(PreprocessConfig()).transform(blobs, ["i"])
    with pytest.raises(ValueError):
        preprocessing.feature_columns(spark.range(1))


@pytest.mark.parametrize(("method", "cost", "penalty"), [("pelt", "rbf", 10), ("binseg", "rbf", 10), ("window", "l2", 5), ("pelt", "l2", 50), ("pelt", "linear", 50)])
def test_mean_shift(method, cost, penalty):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.3, (50, 4)), rng.normal(10, 0.3, (50, 4))])
    assert any(abs(i - 50) <= 5 for i in changepoint.changepoints(x, ChangepointConfig(method, cost, penalty, 10)))


def plain_pelt(x, c):
    """PELT without pruning, and costs from all pairs."""
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    g = np.exp(-np.clip(d / np.median(d[np.triu_indices(len(x), 1)]), 0.01, 100))
    np.fill_diagonal(g, 1)
    cost = lambda a, b: (b - a) - g[a:b, a:b].sum() / (b - a)
    best = {0: (0.0, [])}
    for e in [*[i for i in range(0, len(x), c.jump) if c.min_size <= i <= len(x) - c.min_size], len(x)]:
        if found := [(t + cost(s, e) + c.penalty, [*cuts, s]) for s, (t, cuts) in best.items() if e - s >= c.min_size]:
            best[e] = min(found)
    return best[len(x)][1][1:]


@pytest.mark.parametrize("seed", range(4))
def test_pairs_in_blocks(monkeypatch, seed):
    """Median and cuts as from all pairs at once, whatever the blocks and bounds."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (150, 2)) + np.repeat(rng.normal(0, 2, (5, 2)), 30, 0)
    x = x.round(0) if seed % 2 else x
    want = np.median(((x[:, None] - x[None]) ** 2).sum(2)[np.triu_indices(150, 1)])
    for block, at_once, some in ((7, 0, 3), (64, 50, 20), (256, 2_000_000, 1500)):
        monkeypatch.setattr(changepoint, "BLOCK", block)
        monkeypatch.setattr(changepoint, "AT_ONCE", at_once)
        monkeypatch.setattr(changepoint, "SOME", some)
        assert changepoint.median_distance(x) == pytest.approx(want, rel=1e-12)
        c = ChangepointConfig("pelt", "rbf", 1.5, 10)
        assert len(plain_pelt(x, c)) > 1 and changepoint.changepoints(x, c) == plain_pelt(x, c)
    assert changepoint.median_distance(np.ones((90, 3))) == 0


@pytest.mark.parametrize("method", ["pelt", "binseg", "window"])
def test_long_sequence_needs_no_memory_for_pairs(method):
    """4,000 rows: 128 MB for one number per pair, of which there were several."""
    x = np.random.default_rng(6).normal(0, 0.3, (4000, 2)) + np.repeat([[0.0], [8.0], [3.0], [11.0]], 1000, 0)
    tracemalloc.start()
    found = changepoint.changepoints(x, ChangepointConfig(method, "rbf", 3.0, 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {1000, 2000, 3000} <= set(found) and peak < 120e6


def test_work_of_long_sequences(monkeypatch):
    """Equal rows are compared once, also in the search, and short sequences take few steps; the cuts are those of all pairs."""
    rng = np.random.default_rng(8)
    sizes, squared = [], changepoint.squared
    monkeypatch.setattr(changepoint, "squared", lambda a, b: sizes.append(len(a) * len(b)) or squared(a, b))
    c = ChangepointConfig("pelt", "rbf", 3.0, 10)
    x = rng.normal(0, 1, (40, 2))[rng.integers(0, 40, 6000)]
    changepoint.changepoints(x, c)
    assert sum(sizes) < 2_500_000  # of 18,000,000 pairs
    sizes.clear()
    changepoint.changepoints(rng.normal(0, 1, (1600, 2)), c)
    assert len(sizes) < 250  # of 318 places, and the blocks of the median
    monkeypatch.setattr(changepoint, "BLOCK", 32)
    for part in (x[:500], np.vstack([x[:200], x[200:350] + 2, x[350:500]])):
        assert changepoint.changepoints(part, c) == plain_pelt(part, c)


def test_constant():
    x = np.random.default_rng(3).normal(5, 0.01, (100, 4))
    assert changepoint.changepoints(x, ChangepointConfig("pelt", "rbf", 1000, 10)) == []


def test_labels(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([0, 1, 0, 0, 0])], "g string, i int, s int")
    assert [r.s_smoothed for r in labels.smooth(df, "s", ["g"], ["i"], 3).orderBy("i").collect()] == [0, 0, 0, 0, 0]
    for values, rate in (([1, 1, 1], 0.0), ([0, 1, 0, 1], 1.0), ([1], 0.0)):
        one = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, s int")
        assert labels.flicker_rate(one, "s", ["g"], ["i"]).first().flicker_rate == rate
