"""Discovery, latent codes, studies, signals and exact quantiles, on seeded data and against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.config import ChangepointConfig, HmmConfig, MixtureConfig, PreprocessConfig, VaeConfig
from pitchlake.errors import FeatureError, ModelError
from pitchlake.models import base, changepoint, discovery, labels, latent, mixture, preprocessing, sequence, study
from pitchlake.operators import features, quality
from pitchlake.operators.quantiles import exact_quantiles
from pitchlake.plans.feature_queries import CONFIG, events

SF = "/root/testdata/sf0.001"
KEYS = ["match_id", "team_id", "segment_type", "period", "segment"]


@pytest.fixture(scope="module")
def table(spark):
    """Windows of two teams in three matches that stay in one of three states for a while."""
    rng = np.random.default_rng(5)
    centres = np.array([(0, 0, 0, 1), (6, 0, 3, 1), (0, 7, -3, 1)], float)
    rows = []
    for m in range(3):
        for t in ("a", "b"):
            for i in range(60):
                s = (i // 15 + m) % 3
                x = centres[s] + rng.normal(0, 0.6, 4)
                rows.append((f"m{m}", t, "window", 1, i, float(10 * i), i / 6, s, *map(float, x[:3]), None if i % 20 == 3 else float(x[3]), 1.0))
    schema = "match_id string, team_id string, segment_type string, period int, segment long, start_time double, match_minute double, truth int, t1_a double, t1_b double, t2_c double, t2_d double, t3_e double"
    return spark.createDataFrame(rows, schema).repartition(4).persist()


@pytest.fixture(scope="module")
def states(table):
    return discovery.discover_states(table, config=MixtureConfig(2, 4, n_init=2, max_iter=40), silhouettes=True)


def test_states(table, states):
    s = states.summary
    assert (s["best_k"], s["best_k_silhouette"], s["n_windows"], s["n_windows_retained"]) == (3, 3, 360, 342)
    assert s["n_features_in"] == 4 and s["flicker_rate_smoothed"] <= s["flicker_rate_raw"] < 0.2
    assert discovery.faults(states.rows, "state_label", "state_prob", 3, "state_label_smoothed").first().asDict() == {"n_rows": 342, "n_not_one": 0, "n_outside": 0, "n_unlikely": 0, "n_unsmooth": 0}
    wrong = states.rows.withColumn("state_prob_0", F.lit(2.0)).withColumn("state_label_smoothed", F.lit(7))
    assert discovery.faults(wrong, "state_label", "state_prob", 3, "state_label_smoothed").first().n_unsmooth == 342
    assert labels.agreement(base.labelled(table, states.rows.select(*KEYS, "state_label"), KEYS), "state_label", "truth").first().ari > 0.95
    kept = states.preprocessor.retained(table, KEYS)
    assert kept.where("retained").count() == 342 and kept.count() == 360
    with pytest.raises(ValueError):
        discovery.discover_states(table.limit(0))


def test_sequences(spark, table, states):
    found = discovery.discover_sequences(table, states.preprocessor, config=HmmConfig(3, max_iter=20), seed=states.model, states=states.rows)
    assert found.summary["n_sequences"] == 6 and found.summary["gmm_agreement_ari"] > 0.9 and found.summary["flicker_rate"] < 0.1
    assert found.model.n_states == 3 and found.model.state_means(spark).count() == 3 * len(states.preprocessor.columns_out)
    alone = discovery.discover_sequences(table, states.preprocessor, config=HmmConfig(3, max_iter=20))
    assert alone.summary["gmm_agreement_ari"] is None
    assert labels.agreement(base.labelled(table, alone.rows.select(*KEYS, "hmm_state_label"), KEYS), "hmm_state_label", "truth").first().ari > 0.6


def test_models_are_stored_by_kind(spark, states, tmp_path):
    base.save_model(spark, states.model, f"{tmp_path}/m.json")
    assert base.load_model(spark, mixture.GaussianMixture, f"{tmp_path}/m.json").bic == pytest.approx(states.model.bic)
    for kind in (sequence.HiddenMarkovModel, latent.VariationalEncoder, preprocessing.Preprocessor):
        with pytest.raises(ModelError):
            base.load_model(spark, kind, f"{tmp_path}/m.json")


def test_gradients():
    """Against differences, with the same noise and dropout."""
    c = VaeConfig(latent=2, hidden=(5, 4), dropout=0.3, beta=1.5)
    rng = np.random.default_rng(0)
    x, w = rng.normal(0, 1, (12, 6)), latent.first_weights(6, c, rng)

    def loss(w):
        return latent.loss_and_gradients(x, {k: v.copy() for k, v in w.items()}, c, np.random.default_rng(9))

    _, grads = loss(w)
    for k, g in grads.items():
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(3)]:
            up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[at] == pytest.approx((loss(up)[0] - loss(down)[0]) / 2e-6, abs=1e-6), (k, at)


def test_encoder_and_clusters(spark, table, tmp_path):
    pre = preprocessing.Preprocessor(PreprocessConfig("t", "impute_median", None)).fit(table)
    z = pre.transform(table, [*KEYS, "truth"]).persist()
    encoder = latent.VariationalEncoder(VaeConfig(latent=2, hidden=(16, 8), dropout=0.0, beta=1e-3, epochs=60, batch=64, rate=5e-3)).fit(z, pre.columns_out)
    assert len(encoder.losses) == 60 and encoder.losses[-1] < 0.6 * encoder.losses[0]
    codes = encoder.encode(z, [*KEYS, "truth"]).persist()
    assert codes.count() == 360
    found = latent.fit_clusters(codes, encoder.columns_out, 3, n_init=3).predict(codes, ["truth"])
    assert labels.agreement(found, "cluster", "truth").first().ari > 0.8
    assert discovery.faults(found, "cluster", "prob", 3).first().n_unlikely == 0
    base.save_model(spark, encoder, f"{tmp_path}/v.json")
    again = base.load_model(spark, latent.VariationalEncoder, f"{tmp_path}/v.json")
    x = np.random.default_rng(1).normal(0, 1, (5, len(pre.columns_out)))
    assert again.codes(x) == pytest.approx(encoder.codes(x))
    direct = mixture.fit_mixtures(z, pre.columns_out, [3], MixtureConfig(3, 3, n_init=2))[3]
    hybrid = discovery.discover_latent(z, pre.columns_out, codes.drop("truth"), encoder.columns_out, direct, direct.predict(z, KEYS))
    rows = discovery.comparison_table(spark, hybrid.comparison).collect()
    assert [r.model for r in rows] == ["Direct-GMM", "VAE-GMM"] and rows[0].silhouette_latent is None and rows[0].agreement_ari == round(hybrid.comparison["agreement_ari"], 4)
    assert hybrid.comparison["silhouette_latent"] > 0.3 and hybrid.rows.count() == 360
    with pytest.raises(ValueError, match="differ"):
        discovery.discover_latent(z, pre.columns_out, codes.drop("truth").limit(5), encoder.columns_out, direct, direct.predict(z, KEYS))
    with pytest.raises(RuntimeError):
        latent.VariationalEncoder(VaeConfig()).encode(z, KEYS)


def test_bayesian_mixture_empties_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.5, (400, 2)) + np.array([(0, 0), (8, 0), (4, 8)])[np.arange(400) % 3]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "x double, y double")
    m = mixture.fit_mixtures(df, ["x", "y"], [6], MixtureConfig(6, 6, n_init=3, max_iter=200, tol=1e-5, bayesian=True))[6]
    big = sorted(m.weights)[::-1]
    assert sum(big[:3]) > 0.95 and np.isfinite(m.bic)
    with pytest.raises(ValueError):
        MixtureConfig(covariance="diag", bayesian=True)
    assert mixture._digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-9)


def test_failed_numbers_of_components_are_skipped(spark, table, monkeypatch):
    sound = mixture._sound
    monkeypatch.setattr(mixture, "_sound", lambda p: len(p[0]) != 3 and sound(p))
    found = mixture.select_k(table, ["t1_a", "t1_b"], MixtureConfig(2, 4, n_init=1, max_iter=5))
    assert [t[0] for t in found.table] == [2, 4] and found.best_silhouette is None
    monkeypatch.setattr(mixture, "_sound", lambda p: False)
    with pytest.raises(ModelError):
        mixture.select_k(table, ["t1_a", "t1_b"], MixtureConfig(2, 4, n_init=1, max_iter=5))
    with pytest.raises(ValueError):
        mixture.select_k(table, ["t1_a"], MixtureConfig(4, 2))


def test_signals(table, states):
    sequences = discovery.discover_sequences(table, states.preprocessor, config=HmmConfig(3, max_iter=5), seed=states.model).rows
    minutes = table.select(*KEYS, "match_minute")
    at = lambda df: minutes.join(df.drop("start_time"), KEYS)
    signals = changepoint.four_signals(at(states.rows), at(sequences), table.select(*KEYS, "match_minute"), table, ["t1_a", "t1_b", "t2_d"])
    found, missing = changepoint.detect_signals(signals, ["match_id", "team_id"], ["match_minute", "segment"])
    assert list(missing) == ["vae"] and {r.signal for r in found.select("signal").distinct().collect()} == {"gmm", "hmm", "raw"}
    raw = {(r.match_id, r.team_id): [] for r in found.collect()}
    for r in found.where("signal = 'raw'").orderBy("cp_index").collect():
        raw[r.match_id, r.team_id].append(r.cp_index)
        assert r.sequence_id == f"{r.match_id}_{r.team_id}" and r.deltas.count(";") == 2
    assert all(v == [15, 30, 45] for v in raw.values())
    s = {r.signal: r for r in changepoint.summary(found, ["signal"]).collect()}
    assert (s["raw"].n_groups, s["raw"].total, s["raw"].median, s["raw"].most) == (6, 18, 3, 3)
    with pytest.raises(ValueError):
        changepoint.detect_signals({"x": changepoint.Signal(table, ["absent"], ChangepointConfig())}, ["match_id"], ["segment"])


def test_studies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 6))
    x[:, 1] = x[:, 0] + rng.normal(0, 0.1, 200)
    x[:, 2] = -x[:, 0] + rng.normal(0, 0.2, 200)
    x[:, 4] = x[:, 3] + rng.normal(0, 0.9, 200)
    names = [f"t1_{c}" for c in "abcdef"]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"{n} double" for n in names)).withColumn("t1_g", F.lit(2.0))
    r, n = study.correlation_matrix(df, [*names, "t1_g"])
    assert n == 200 and r[:6, :6] == pytest.approx(np.corrcoef(x.T)) and (r[6, :6] == 0).all()
    pre = preprocessing.Preprocessor(PreprocessConfig("t", "drop_rows", 1.0)).fit(df.drop("t1_g"))
    d, values = study.dimensions(pre), np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
    assert d["participation_ratio"] == pytest.approx(values.sum() ** 2 / (values**2).sum()) and d["n_above_mean"] == (values > 1).sum()
    assert d["n_90"] == np.searchsorted(np.cumsum(values) / 6, 0.9) + 1
    top = study.loadings(pre, 2, 3)
    assert {f for c, _, f, _ in top if c == 1} == {"t1_a", "t1_b", "t1_c"} and [r for _, r, _, _ in top] == [1, 2, 3] * 2
    assert sum(v for _, v in study.importance(pre, 1.0)) == pytest.approx(1)
    assert {tuple(g.features) for g in study.redundant_groups(df.drop("t1_g"), names).collect()} == {("t1_a", "t1_b", "t1_c"), ("t1_d",), ("t1_e",), ("t1_f",)}
    c = quality.pair_counts(study.correlation_pairs(df, names)).first()
    upper = np.abs(np.corrcoef(x.T))[np.triu_indices(6, 1)]
    assert (c.n_pairs, c.n_strong, c.n_moderate) == (15, (upper > 0.85).sum(), (upper > 0.7).sum())
    found = study.correlates(df, ["t1_a"], names[1:], 3).collect()
    assert [f.feature for f in found[:2]] == ["t1_b", "t1_c"] and found[0].p_value < 1e-50
    assert study.correlates_pivot(study.correlates(df, ["t1_a"], names[1:], 5)).first().no_1.startswith("t1_b (+0.99")
    assert study.correlation_p(0.5, 10) == pytest.approx(0.1411, abs=1e-4) and study.correlation_p(0.632, 10) == pytest.approx(0.05, abs=5e-4)
    assert study.correlation_p(0.0, 50) == pytest.approx(1) and study.correlation_p(1.0, 50) == 0 and study.correlation_p(0.3, 2) is None
    assert study.dominant(df, names[:3], ["t1_g"]).where("dominant_dim BETWEEN 0 AND 2").count() == 200


def test_average_linkage_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(20):
        p = rng.uniform(0, 1, (9, 2))
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        groups = [[i] for i in range(9)]
        while len(groups) > 1:
            far, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if far > 0.3:
                break
            groups[i] = sorted(groups[i] + groups.pop(j))
        assert study.average_linkage(d, 0.3) == sorted(groups)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(0, 1, 5000), rng.integers(0, 3, 5000).astype(float)
    rows = [(float(x), None if i % 7 == 0 else float(y), None, float(i % 2) * 1e9) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    shares = (0.0, 0.013, 0.25, 0.5, 0.75, 1.0)
    got = exact_quantiles(df, ["a", "b", "c", "d"], shares)
    assert got["a"] == pytest.approx(np.quantile(a, shares)) and got["c"] == [None] * 6
    assert got["b"] == pytest.approx(np.quantile([y for i, y in enumerate(b) if i % 7], shares)) and got["d"][3] == pytest.approx(5e8)
    assert exact_quantiles(df.limit(0), ["a"], (0.5,)) == {"a": [None]}
    assert quality.distribution(df, "b").startswith("n=4285 min=0.0") and quality.distribution(df, "c") == "no values"
    assert preprocessing.medians(df, ["c", "d"]) == {"c": 0.0, "d": 5e8}


def test_corpus_extraction(spark):
    e = events(spark, SF)
    found, failed = features.extract_corpus({"a": e.where("match_id < '2024-01-04'"), "none": e.limit(0), "odd": e.drop("event_type"), "b": e.where("match_id = '2024-01-10'")}, CONFIG, 1)
    assert set(failed) == {"none", "odd"} and {r.dataset_slug for r in found.select("dataset_slug").distinct().collect()} == {"a", "b"}
    assert math.isclose(found.where("dataset_slug = 'b'").count() / found.count(), 0.25, abs_tol=0.1)
    with pytest.raises(FeatureError):
        features.extract_corpus({"none": e.limit(0)}, CONFIG, 1)
