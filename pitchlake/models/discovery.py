"""Discovery of tactical states: from a feature table to labelled rows and a summary, as compositions of the models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.config import HmmConfig, MixtureConfig, PreprocessConfig
from pitchlake.models.labels import agreement, flicker_rate, silhouette, smooth
from pitchlake.models.mixture import GaussianMixture, Selection, fit_mixtures, select_k
from pitchlake.models.preprocessing import Preprocessor, drop_tiers_above
from pitchlake.models.sequence import HiddenMarkovModel, fit_hmm
from pitchlake.sources.store import materialised

#: A segment's keys, the sequence that it is in, and its place there.
KEYS = ("match_id", "team_id", "segment_type", "period", "segment")
GROUP, ORDER = ("match_id", "team_id"), ("period", "start_time", "segment_type", "segment")


@dataclass(frozen=True)
class States:
    """Labelled rows (keys, state_label, state_prob_k, state_label_smoothed), what led to them, and the summary."""

    rows: DataFrame
    preprocessor: Preprocessor
    model: GaussianMixture
    selection: Selection
    summary: dict[str, object]


def _order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*[c for c in order if c in df.columns], *keys]))


def discover_states(table: DataFrame, label: str = "all", max_tier: int = 2, preprocess: PreprocessConfig | None = None, config: MixtureConfig | None = None, smooth_size: int = 5, keys: Sequence[str] = KEYS, group: Sequence[str] = GROUP, order: Sequence[str] = ORDER, silhouettes: bool = False) -> States:
    """Drop higher tiers, complete and project the features, choose K by BIC, label, smooth within sequences, measure the flicker.

    Rows that preprocessing drops aren't labelled. ``silhouettes`` measures each K over all pairs of rows. An empty table raises ValueError.
    """
    kept = drop_tiers_above(table, max_tier)
    pre = Preprocessor(preprocess or PreprocessConfig("t", "drop_rows", 0.95)).fit(kept)
    carried = _order(kept, keys, order)
    z = materialised(pre.transform(kept, carried))
    one = F.xxhash64(*keys) if silhouettes else None
    found = select_k(z if one is None else z.withColumn("_key", one), pre.columns_out, config, None if one is None else "_key")
    model = found.models[found.best_bic]
    rows = smooth(model.predict(z, carried), "state_label", group, [c for c in carried if c not in group], smooth_size)
    rows = materialised(rows)
    at = [c for c in carried if c not in group]
    summary = {
        "dataset_label": label,
        "best_k": found.best_bic,
        "best_k_silhouette": found.best_silhouette,
        "n_windows": table.count(),
        "n_windows_retained": rows.count(),
        "n_features_in": len(pre.columns),
        "n_features_out": len(pre.columns_out),
        "flicker_rate_raw": flicker_rate(rows, "state_label", group, at).first()[0],
        "flicker_rate_smoothed": flicker_rate(rows, "state_label_smoothed", group, at).first()[0],
    }
    return States(rows, pre, model, found, summary)


@dataclass(frozen=True)
class Sequences:
    """Labelled rows (keys, hmm_state_label, hmm_state_prob_k), the model, and the summary."""

    rows: DataFrame
    model: HiddenMarkovModel
    summary: dict[str, object]


def discover_sequences(table: DataFrame, pre: Preprocessor, label: str = "all", config: HmmConfig | None = None, seed: GaussianMixture | None = None, states: DataFrame | None = None, keys: Sequence[str] = KEYS, group: Sequence[str] = GROUP, order: Sequence[str] = ORDER) -> Sequences:
    """Fit a hidden Markov model to the sequences of projected rows (from a mixture or without), decode, and compare with ``states`` (keys, state_label)."""
    config = config or HmmConfig()
    carried = _order(table, keys, order)
    z = materialised(pre.transform(table, carried))
    at = [c for c in carried if c not in group]
    model = fit_hmm(z, pre.columns_out, list(group), at, seed, config)
    rows = materialised(model.decode(z, list(group), at))
    agreed = None if states is None else agreement(rows.join(states.select(*keys, "state_label"), list(keys)), "hmm_state_label", "state_label").first()
    summary = {
        "dataset_label": label,
        "n_states": model.n_states,
        "n_sequences": rows.select(*group).distinct().count(),
        "n_windows": table.count(),
        "n_windows_retained": rows.count(),
        "gmm_agreement_ari": agreed and agreed.ari,
        "gmm_agreement_nmi": agreed and agreed.nmi,
        "flicker_rate": flicker_rate(rows, "hmm_state_label", group, at).first()[0],
    }
    return Sequences(rows, model, summary)


@dataclass(frozen=True)
class Hybrid:
    """Labelled rows (keys, vae_gmm_state_label, vae_gmm_state_prob_k), the mixture of codes, and the comparison with the direct mixture."""

    rows: DataFrame
    model: GaussianMixture
    comparison: dict[str, object]


def discover_latent(z: DataFrame, columns: Sequence[str], codes: DataFrame, code_columns: Sequence[str], direct: GaussianMixture, labels: DataFrame, n_states: int | None = None, config: MixtureConfig | None = None, keys: Sequence[str] = KEYS) -> Hybrid:
    """A mixture on latent codes against the direct mixture's labels (keys, state_label): silhouettes, BICs, agreement.

    Rows are matched by keys. If codes and rows differ in number ValueError is raised.
    """
    keys, codes = list(keys), materialised(codes)
    if codes.count() != z.count():
        raise ValueError("codes and rows differ in number")
    k = n_states or direct.n_states
    c = config or MixtureConfig(k, k)
    model = fit_mixtures(codes, list(code_columns), [k], c)[k]
    found = model.predict(codes, keys)
    renamed = [F.col(f"state_prob_{i}").alias(f"vae_gmm_state_prob_{i}") for i in range(k)]
    rows = materialised(found.select(*keys, F.col("state_label").alias("vae_gmm_state_label"), *renamed))
    both = rows.join(labels.select(*keys, "state_label"), keys)

    def separation(table: DataFrame, vector: Sequence[str], label: str) -> float:
        own = table.select(*keys, F.array(*[F.col(x).cast("double") for x in vector]).alias("_v")).join(both.select(*keys, label), keys)
        return float(silhouette(own.withColumn("_key", F.xxhash64(*keys)), "_v", label, "_key").first()[0])

    agreed = agreement(both, "state_label", "vae_gmm_state_label").first()
    comparison = {
        "n_states_direct": direct.n_states,
        "n_states_latent": k,
        "bic_direct": float(direct.bic),
        "bic_latent": float(model.bic),
        "silhouette_direct": separation(z, columns, "state_label"),
        "silhouette_original": separation(z, columns, "vae_gmm_state_label"),
        "silhouette_latent": separation(codes, code_columns, "vae_gmm_state_label"),
        "agreement_ari": agreed.ari,
        "agreement_nmi": agreed.nmi,
    }
    return Hybrid(rows, model, comparison)


def comparison_table(spark: SparkSession, c: dict[str, object]) -> DataFrame:
    """Two rows, the direct mixture and that of codes, with scores of four digits."""
    rows = [
        ("Direct-GMM", c["n_states_direct"], c["bic_direct"], c["silhouette_direct"], None, c["agreement_ari"], c["agreement_nmi"]),
        ("VAE-GMM", c["n_states_latent"], c["bic_latent"], c["silhouette_original"], c["silhouette_latent"], c["agreement_ari"], c["agreement_nmi"]),
    ]
    table = spark.createDataFrame(rows, "model string, n_states int, bic double, silhouette double, silhouette_latent double, agreement_ari double, agreement_nmi double")
    return table.withColumns({x: F.round(x, 4) for x in ("silhouette", "silhouette_latent", "agreement_ari", "agreement_nmi")})


def faults(rows: DataFrame, label: str, prob: str, k: int, smoothed: str | None = None, group: Sequence[str] = GROUP, order: Sequence[str] = ORDER, size: int = 5) -> DataFrame:
    """One row: n_rows, and how many rows have probabilities that don't add up to 1, a label outside 0 to k - 1, a label that isn't the likeliest state, or a smoothed label that isn't the window's mode."""
    p = F.array(*[F.col(f"{prob}_{i}") for i in range(k)])
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    checks: list[Column] = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(total - 1) > 1e-6).alias("n_not_one"), F.count_if(~F.col(label).between(0, k - 1)).alias("n_outside"), F.count_if(F.get(p, F.col(label)) < F.array_max(p) - 1e-9).alias("n_unlikely")]
    if smoothed:
        at = [c for c in order if c in rows.columns]
        rows = smooth(rows, label, group, at, size, out="_again")
        checks.append(F.count_if(F.col("_again") != F.col(smoothed)).alias("n_unsmooth"))
    return rows.agg(*checks)
