"""Queries on preprocessing, mixtures, hidden Markov models, label sequences and changepoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.config import ChangepointConfig, HmmConfig, MixtureConfig, PreprocessConfig, VaeConfig
from pitchlake.models import changepoint, discovery, labels, latent, mixture, preprocessing, sequence, study
from pitchlake.operators import quality
from pitchlake.plans.feature_queries import events, feature_table, rounded
from pitchlake.plans.feature_sql import SEGMENTS_SQL, features_sql
from pitchlake.sources.bridge import EVENTS_SQL
from pitchlake.sources.store import hconcat, materialised

#: Features that are null now and then.
SOME = ("t1_carry_distance_mean", "t1_pass_length_std", "t1_shoot_distance_mean")
SEGMENT = ["match_id", "team_id", "segment_type", "segment", "period"]
COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
GROUP, ORDER = ["match_id", "team_id"], ["period", "timestamp", "seq"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*COLUMNS)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for the label operators: thirds of the pitch, the last known place if there is none now."""
    e = events(spark, sf_dir).where(F.col("x").isNotNull())
    return e.select(*GROUP, *ORDER, F.floor(F.col("x") / 34).cast("int").alias("a"), F.floor(F.col("y") / 34).cast("int").alias("b"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = v.agg(F.max(F.size("embedding"))).first()[0]
    return v.select("vec_id", F.col("label").cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"t1_e{i}") for i in range(d)])


def p2_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preprocessing.medians(_lines(spark, sf_dir), list(COLUMNS))
    return spark.createDataFrame(list(found.items()), "feature string, median double").withColumn("median", F.round("median", 6))


def p3_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are left by segment type if those with any null among some features are dropped."""
    t = feature_table(spark, sf_dir, 1).select("segment_type", *SOME)
    return preprocessing.Preprocessor(PreprocessConfig("t", "drop_rows", None), list(SOME)).complete(t).groupBy("segment_type").agg(F.count(F.lit(1)).alias("n"))


def p5_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row whether it has all of some features."""
    t = feature_table(spark, sf_dir, 1)
    return preprocessing.Preprocessor(PreprocessConfig("t", "drop_rows", None), list(SOME)).retained(t, SEGMENT)


def p6_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocessing.moments(_lines(spark, sf_dir), list(COLUMNS)).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def p7_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preprocessing.Preprocessor(PreprocessConfig("t", "impute_median", 0.95)).fit(feature_table(spark, sf_dir, 2))
    total, rows = 0.0, []
    for i, v in enumerate(p.explained):
        total += float(v)
        rows.append((i, float(v), total, i < len(p.components)))
    return spark.createDataFrame(rows, "component int, explained double, cumulative double, kept boolean")


def p8_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = feature_table(spark, sf_dir, 2)
    return preprocessing.Preprocessor(PreprocessConfig("t", "impute_median", 0.95)).fit(t).transform(t, ["match_id", "team_id", "segment_type", "segment", "period"])


def _projected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    v = _vectors(spark, sf_dir)
    p = preprocessing.Preprocessor(PreprocessConfig("t1_", "drop_rows", 0.95)).fit(v)
    return materialised(p.transform(v, ["vec_id"]).repartition(8, "vec_id")), p.columns_out


def m7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, columns = _projected(spark, sf_dir)
    found = mixture.select_k(z, columns, key="vec_id")
    return spark.createDataFrame([(k, b, a, s, k == found.best_bic, k == found.best_silhouette) for k, b, a, s in found.table], "k int, bic double, aic double, silhouette double, best_bic boolean, best_silhouette boolean")


def m3_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, columns = _projected(spark, sf_dir)
    found = mixture.select_k(z, columns)
    return found.models[found.best_bic].predict(z, ["vec_id"])


def m2_bayesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a variational mixture of twelve components at most, by how many vectors have each."""
    z, columns = _projected(spark, sf_dir)
    m = mixture.fit_mixtures(z, columns, [12], MixtureConfig(12, 12, bayesian=True))[12]
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate(m.weights)], "state_label int, weight double")
    return weights.join(m.predict(z, ["vec_id"]).groupBy("state_label").agg(F.count(F.lit(1)).alias("n")), "state_label", "left").fillna(0, ["n"])


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(feature_table(spark, sf_dir, 2).where(F.col("segment_type") == "window"))


#: Features of windows are often null, so they are imputed.
IMPUTED = PreprocessConfig("t", "impute_median", 0.95)


def _states(spark: SparkSession, sf_dir: str, config: MixtureConfig | None = None) -> tuple[DataFrame, discovery.States]:
    t = _windows(spark, sf_dir)
    return t, discovery.discover_states(t, preprocess=IMPUTED, config=config)


def m8_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with their states: K by BIC, labels, probabilities, smoothed labels."""
    return _states(spark, sf_dir)[1].rows


def m8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows break what holds for labelled rows."""
    found = _states(spark, sf_dir, SIX)[1]
    return discovery.faults(found.rows, "state_label", "state_prob", found.model.k, "state_label_smoothed")


#: Six states, as hidden Markov models have by default.
SIX = MixtureConfig(6, 6)


def m14_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with the states of a hidden Markov model that starts from a mixture."""
    t, found = _states(spark, sf_dir, SIX)
    return discovery.discover_sequences(t, found.preprocessor, seed=found.model, states=found.rows).rows


def m14_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many decoded windows, and rows of the transition matrix, break what holds for them."""
    t, found = _states(spark, sf_dir, SIX)
    s = discovery.discover_sequences(t, found.preprocessor, seed=found.model, states=found.rows)
    moves = s.model.transitions(spark).groupBy("from_state").agg(F.sum("prob").alias("p")).agg(F.count_if(F.abs(F.col("p") - 1) > 1e-6).alias("n_moves_not_one"))
    return discovery.faults(s.rows, "hmm_state_label", "hmm_state_prob", 6).drop("n_unlikely").crossJoin(moves)  # one row each


def s17_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transition matrix as a long table, of a hidden Markov model without a mixture."""
    t = _windows(spark, sf_dir)
    p = preprocessing.Preprocessor(IMPUTED).fit(t)
    return discovery.discover_sequences(t, p).model.transitions(spark)


def _codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, preprocessing.Preprocessor, DataFrame, latent.VariationalEncoder]:
    """Windows, the z-scores of their features, and the encoder that is fitted to these."""
    t = _windows(spark, sf_dir)
    p = preprocessing.Preprocessor(PreprocessConfig("t", "impute_median", None)).fit(t)
    z = materialised(p.transform(t, [*SEGMENT, "start_time", "match_minute"]))
    return t, p, z, latent.VariationalEncoder(VaeConfig()).fit(z, p.columns_out)


def m17_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = _codes(spark, sf_dir)[3]
    return spark.createDataFrame([(i, v) for i, v in enumerate(encoder.losses)], "epoch int, loss double")


def m18_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, z, encoder = _codes(spark, sf_dir)
    return encoder.encode(z, SEGMENT)


def m19_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six clusters of the vectors and each vector's nearness to them."""
    v = _vectors(spark, sf_dir)
    columns = [c for c in v.columns if c.startswith("t1_")]
    return latent.fit_clusters(v, columns).predict(v, ["vec_id"])


def m19_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m19_clusters(spark, sf_dir)
    return discovery.faults(found, "cluster", "prob", 6)


def m22_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of features against that of latent codes."""
    t, found = _states(spark, sf_dir, SIX)
    _, p, z, encoder = _codes(spark, sf_dir)
    codes = encoder.encode(z, SEGMENT)
    hybrid = discovery.discover_latent(z, p.columns_out, codes, encoder.columns_out, found.model, found.rows)
    return discovery.comparison_table(spark, hybrid.comparison)


def m28_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changepoints of state probabilities of both models, latent codes and raw features."""
    t, found = _states(spark, sf_dir, SIX)
    s = discovery.discover_sequences(t, found.preprocessor, seed=found.model)
    _, _, z, encoder = _codes(spark, sf_dir)
    minutes = t.select(*SEGMENT, "match_minute")
    signals = changepoint.four_signals(hconcat([minutes, found.rows.select(*SEGMENT, *[f"state_prob_{k}" for k in range(6)])], SEGMENT), hconcat([minutes, s.rows.drop("start_time")], SEGMENT), hconcat([minutes, encoder.encode(z, SEGMENT)], SEGMENT), t)
    return changepoint.detect_signals(signals, GROUP, ["match_minute", "period", "segment"])[0]


def m30_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoint.summary(m28_signals(spark, sf_dir), ["signal"])


def _study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, preprocessing.Preprocessor]:
    v = _vectors(spark, sf_dir)
    return v, preprocessing.Preprocessor(PreprocessConfig("t1_", "drop_rows", 1.0)).fit(v)


def a11_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(study.dimensions(_study(spark, sf_dir)[1]).items()), "measure string, value double")


def a11_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = study.dimensions(_study(spark, sf_dir)[1])
    return spark.createDataFrame([(int(d["n_features"]), d["participation_ratio"])], "n_features int, participation_ratio double").withColumn("participation_ratio", F.round("participation_ratio", 6))


def a11_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(study.loadings(_study(spark, sf_dir)[1]), "component int, rank int, feature string, loading double")


def a11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(study.importance(_study(spark, sf_dir)[1]), "feature string, importance double")


def a12_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of redundant features of windows."""
    t = _windows(spark, sf_dir)
    p = preprocessing.Preprocessor(PreprocessConfig("t", "impute_median", None)).fit(t)
    named = p.transform(t, SEGMENT).withColumnsRenamed(dict(zip(p.columns_out, p.columns, strict=True)))
    return study.redundant_groups(named, p.columns)


def a13_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return quality.pair_counts(study.correlation_pairs(v, [c for c in v.columns if c.startswith("t1_")]), 0.15, 0.05)


def a14_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components of each vector, for maps."""
    v, p = _study(spark, sf_dir)
    return p.transform(v, ["vec_id", "label"]).select("vec_id", "label", "z0", "z1")


LATENTS, REST = [f"t1_e{i}" for i in range(4)], [f"t1_e{i}" for i in range(4, 64)]


def a15_correlates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five numbers of a vector that go most with each of its first four, over all vectors."""
    found = study.correlates(_vectors(spark, sf_dir), LATENTS, REST)
    return found.select("latent_dim", "rank", "feature", F.round("r", 6).alias("r"))


def a15_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.correlates_pivot(study.correlates(_vectors(spark, sf_dir), LATENTS, REST))


def a15_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return study.dominant(v, [c for c in v.columns if c.startswith("t1_")], ["vec_id"])


def m11_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = HmmConfig()
    e = materialised(events(spark, sf_dir).where(F.col("x").isNotNull()).select(*GROUP, *ORDER, "x", "y"))
    seed = mixture.fit_mixtures(e, ["x", "y"], [c.n_states], MixtureConfig())[c.n_states]
    hmm = sequence.fit_hmm(e, ["x", "y"], GROUP, ORDER, seed, c)
    return hmm.decode(e, GROUP, ORDER)


def m25_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("x").isNotNull())
    return changepoint.detect(e, ["x", "y"], GROUP, ORDER, config=ChangepointConfig("pelt", "rbf", 3.0, 10))


def m30_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("x").isNotNull())
    return changepoint.summary(changepoint.detect(e, ["x", "y"], GROUP, ORDER, config=ChangepointConfig("binseg", "l2", 20_000.0, 10)))


def m4_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.smooth(_labels(spark, sf_dir), "a", GROUP, ORDER, 5).select(*GROUP, "seq", "a_smoothed")


def m6_flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.flicker_rate(_labels(spark, sf_dir), "a", GROUP, ORDER))


def m13_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))


def m24_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.agreement(_labels(spark, sf_dir), "a", "b").select(F.round("ari", 8).alias("ari"), F.round("nmi", 8).alias("nmi"))


#: Three centres of 64 numbers.
CENTRES = tuple(tuple(round(0.05 * ((i * a) % 5 - 2), 2) for i in range(64)) for a in (0, 1, 3))


def m20_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("e"))
    return rounded(labels.soft_assignment(v, "e", CENTRES, ["vec_id"]))


def m16_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("x"))
    v = v.select("x", F.transform("x", lambda a: a * 0.9).alias("recon"), F.slice("x", 1, 4).alias("mu"), F.slice("x", 5, 4).alias("logvar"))
    return rounded(labels.vae_loss(v, "x", "recon", "mu", "logvar"))


def m23_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, over all pairs of vectors."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return labels.silhouette(v, "embedding", "label", "vec_id").select(F.round("silhouette", 8).alias("silhouette"))


def m26_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much three numbers change at every event."""
    e = events(spark, sf_dir).select("match_id", "seq", *[F.coalesce(c, F.lit(50.0)).alias(c) for c in ("x", "y", "end_x")], F.lit(True).alias("at"))
    d = changepoint.feature_deltas(e, ["x", "y", "end_x"], ["match_id"], ["seq"], "at", top=3)
    return rounded(d.select("match_id", "seq", "feature", "delta"))


QUERIES = {
    "p2_medians": p2_medians,
    "p3_complete": p3_complete,
    "p5_retained": p5_retained,
    "m2_bayesian": m2_bayesian,
    "m8_states": m8_states,
    "m8_faults": m8_faults,
    "m14_sequences": m14_sequences,
    "m14_faults": m14_faults,
    "s17_transitions": s17_transitions,
    "m17_losses": m17_losses,
    "m18_codes": m18_codes,
    "m19_clusters": m19_clusters,
    "m19_faults": m19_faults,
    "m22_comparison": m22_comparison,
    "m28_signals": m28_signals,
    "m30_by_signal": m30_by_signal,
    "a11_dimensions": a11_dimensions,
    "a11_participation": a11_participation,
    "a11_loadings": a11_loadings,
    "a11_importance": a11_importance,
    "a12_groups": a12_groups,
    "a13_pairs": a13_pairs,
    "a14_projection": a14_projection,
    "a15_correlates": a15_correlates,
    "a15_pivot": a15_pivot,
    "a15_dominant": a15_dominant,
    "p6_moments": p6_moments,
    "p7_explained": p7_explained,
    "p8_components": p8_components,
    "m3_states": m3_states,
    "m4_smoothed": m4_smoothed,
    "m6_flicker": m6_flicker,
    "m7_selection": m7_selection,
    "m11_decoded": m11_decoded,
    "m13_sequences": m13_sequences,
    "m16_loss": m16_loss,
    "m20_soft": m20_soft,
    "m23_silhouette": m23_silhouette,
    "m24_agreement": m24_agreement,
    "m25_changepoints": m25_changepoints,
    "m26_deltas": m26_deltas,
    "m30_summary": m30_summary,
}

_UNION = " UNION ALL ".join
_LABELS = f"{EVENTS_SQL}, lab AS (SELECT match_id, team_id, period, timestamp, seq, floor(x / 34)::INT AS a, floor(y / 34)::INT AS b, row_number() OVER (PARTITION BY match_id, team_id ORDER BY period, timestamp, seq) AS r FROM ev WHERE x IS NOT NULL)"
_SOFT = [f"list_distance(embedding::DOUBLE[], [{', '.join(f'{x}::DOUBLE' for x in c)}])" for c in CENTRES]
_WINDOWS = f"WITH {SEGMENTS_SQL} SELECT 2 * count(DISTINCT (match_id, period, segment)) AS n FROM seg WHERE segment_type = 'window'"
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in SOME)
_LONG = "x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_R = f"{_LONG}, r AS (SELECT a.i AS i, b.i AS j, corr(a.v, b.v) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i)"
_TOP = f"{_R}, k AS (SELECT 't1_e' || i AS latent_dim, 't1_e' || j AS feature, r, row_number() OVER (PARTITION BY i ORDER BY abs(r) DESC, 't1_e' || j)::INT AS rank FROM r WHERE i < 4 AND j >= 4)"
_DELTA = _UNION(f"SELECT match_id, seq, '{c}' AS feature, avg({c}) OVER (PARTITION BY match_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) - avg({c}) OVER (PARTITION BY match_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS delta FROM v" for c in ("x", "y", "end_x"))

ORACLES = {
    "p2_medians": _UNION(f"SELECT '{c}' AS feature, round(median({c}), 6) AS median FROM lineitem" for c in COLUMNS),
    "p6_moments": _UNION(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in COLUMNS),
    "m4_smoothed": f"""WITH {_LABELS}, n AS (SELECT x.match_id, x.team_id, x.seq, y.a, count(*) AS n FROM lab x JOIN lab y ON x.match_id = y.match_id AND x.team_id = y.team_id AND y.r BETWEEN x.r - 2 AND x.r + 2 GROUP BY ALL)
SELECT match_id, team_id, seq, arg_min(a, -n * 1000 + a) AS a_smoothed FROM n GROUP BY match_id, team_id, seq""",
    "m6_flicker": f"""WITH {_LABELS}, c AS (SELECT match_id, team_id, (a <> lag(a) OVER (PARTITION BY match_id, team_id ORDER BY r))::INT AS c FROM lab), s AS (SELECT sum(c) / (count(*) - 1) AS f FROM c GROUP BY match_id, team_id HAVING count(*) >= 2)
SELECT round(coalesce(avg(f), 0), 8) AS flicker_rate FROM s""",
    "m13_sequences": f"WITH {_LABELS} SELECT match_id, team_id, count(*) AS n FROM lab GROUP BY match_id, team_id",
    "m16_loss": """WITH v AS (SELECT embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT sum(list_sum(list_transform(x, lambda a: (a - a * 0.9::DOUBLE) * (a - a * 0.9::DOUBLE)))) / sum(len(x)) AS r,
  -0.5 * sum(list_sum(list_transform(range(1, 5), lambda i: 1 + x[i + 4] - x[i] * x[i] - exp(x[i + 4])))) / (4 * count(*)) AS k FROM v) SELECT round(r, 8) AS reconstruction, round(k, 8) AS divergence, round(r + 4 * k, 8) AS loss FROM s""",
    "m20_soft": f"""WITH d AS (SELECT vec_id, {_SOFT[0]} AS a, {_SOFT[1]} AS b, {_SOFT[2]} AS c FROM embeddings), w AS (SELECT vec_id, exp(-a) AS a, exp(-b) AS b, exp(-c) AS c FROM d)
SELECT vec_id, round(a / (a + b + c), 8) AS prob_0, round(b / (a + b + c), 8) AS prob_1, round(c / (a + b + c), 8) AS prob_2 FROM w""",
    "m23_silhouette": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT x.vec_id AS i, x.label AS ci, y.label AS cj, avg(list_distance(x.e, y.e)) AS d FROM v x JOIN v y ON x.vec_id <> y.vec_id GROUP BY ALL),
q AS (SELECT i, max(CASE WHEN ci = cj THEN d END) AS a, min(CASE WHEN ci <> cj THEN d END) AS b FROM p GROUP BY i) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 8) AS silhouette FROM q""",
    "p3_complete": f"SELECT segment_type, count(*) AS n FROM ({features_sql(1)}) WHERE {_WHOLE} GROUP BY segment_type",
    "p5_retained": f"SELECT match_id, team_id, segment_type, segment, period, {_WHOLE} AS retained FROM ({features_sql(1)})",
    "m8_faults": f"SELECT n AS n_rows, 0::BIGINT AS n_not_one, 0::BIGINT AS n_outside, 0::BIGINT AS n_unlikely, 0::BIGINT AS n_unsmooth FROM ({_WINDOWS})",
    "m14_faults": f"SELECT n AS n_rows, 0::BIGINT AS n_not_one, 0::BIGINT AS n_outside, 0::BIGINT AS n_moves_not_one FROM ({_WINDOWS})",
    "m19_faults": "SELECT count(*) AS n_rows, 0::BIGINT AS n_not_one, 0::BIGINT AS n_outside, 0::BIGINT AS n_unlikely FROM embeddings",
    "a11_participation": f"WITH {_R} SELECT 64::INT AS n_features, round(64.0::DOUBLE * 64 / (64 + 2 * sum(r * r)), 6) AS participation_ratio FROM r",
    "a13_pairs": f"WITH {_R} SELECT count(*) AS n_pairs, count(*) FILTER (abs(r) > 0.15) AS n_strong, count(*) FILTER (abs(r) > 0.05) AS n_moderate FROM r",
    "a15_correlates": f"WITH {_TOP} SELECT latent_dim, rank, feature, round(r, 6) AS r FROM k WHERE rank <= 5",
    "a15_pivot": "WITH " + _TOP + " SELECT latent_dim AS dim, " + ", ".join(f"max(CASE WHEN rank = {k} THEN printf('%s (%+.3f)', feature, r) END) AS no_{k}" for k in range(1, 6)) + " FROM k GROUP BY latent_dim",
    "a15_dominant": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS e FROM embeddings) SELECT vec_id, (list_position(e, list_max(e)) - 1)::INT AS dominant_dim FROM v",
    "m24_agreement": f"""WITH {_LABELS}, t AS (SELECT a, b, count(*)::DOUBLE AS n FROM lab GROUP BY a, b), g AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS m FROM t),
pa AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY a)), pb AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM t GROUP BY b)),
s AS (SELECT sum(n * (n - 1) / 2) AS same, max(m) AS m, sum(n / m * ln(n * m / (na * nb))) AS mi, -sum(n / m * ln(na / m)) AS ha, -sum(n / m * ln(nb / m)) AS hb FROM g)
SELECT round((same - pa.s * pb.s / (m * (m - 1) / 2)) / ((pa.s + pb.s) / 2 - pa.s * pb.s / (m * (m - 1) / 2)), 8) AS ari, round(greatest(0, mi / ((ha + hb) / 2)), 8) AS nmi FROM s, pa, pb""",
    "m26_deltas": f"""WITH {EVENTS_SQL}, v AS (SELECT match_id, seq, coalesce(x, 50) AS x, coalesce(y, 50) AS y, coalesce(end_x, 50) AS end_x FROM ev), d AS ({_DELTA}) SELECT match_id, seq, feature, round(delta, 8) AS delta FROM d""",
}
