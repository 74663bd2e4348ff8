"""Queries do the whole job: all groups, all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.config import MixtureConfig
from pitchlake.models import labels
from pitchlake.plans import model_queries, registry
from pitchlake.plans.feature_queries import events

SF = "/root/testdata/sf0.001"


def test_changepoints_of_all_matches(spark):
    e = events(spark, SF)
    groups = {f"{r.match_id}_{r.team_id}" for r in e.where("x IS NOT NULL").select("match_id", "team_id").distinct().collect()}
    assert len({g[:10] for g in groups}) == 30
    assert {r.sequence_id for r in registry.queries()["m25_changepoints"](spark, SF).collect()} == groups
    assert registry.queries()["m30_summary"](spark, SF).first().n_groups == len(groups)


def test_deltas_of_every_row(spark):
    e = events(spark, SF).select("match_id", "seq", *[F.coalesce(c, F.lit(50.0)).alias(c) for c in ("x", "y", "end_x")]).toPandas()
    found = registry.queries()["m26_deltas"](spark, SF).toPandas()
    assert len(found) == 3 * len(e)
    at = found.set_index(["match_id", "seq", "feature"]).delta
    for match, rows in e.groupby("match_id"):
        rows = rows.sort_values("seq")
        for c in ("x", "y", "end_x"):
            v = rows[c].to_numpy()
            for i in range(1, len(v)):
                assert abs(at[match, rows.seq.iloc[i], c] - (v[i : i + 5].mean() - v[max(0, i - 5) : i].mean())) < 1e-7


def silhouette(x, c):
    """By brute force."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        mean = {k: d[i, (c == k) & (np.arange(len(x)) != i)].mean() for k in set(c) if ((c == k) & (np.arange(len(x)) != i)).any()}
        a, b = mean.get(c[i]), min(v for k, v in mean.items() if k != c[i])
        out.append(0.0 if a is None else (b - a) / max(a, b))
    return np.mean(out)


def test_silhouette_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(labels, "BLOCK", 60)
    rng = np.random.default_rng(4)
    c = np.append(rng.integers(0, 3, 250), 3)
    x = rng.normal(0, 1, (251, 5)) + c[:, None]
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "i bigint, e array<double>, c int")
    assert labels.silhouette(df, "e", "c", "i").first().silhouette == pytest.approx(silhouette(x, c), abs=1e-12)
    assert labels.silhouette(df.where("c = 1"), "e", "c", "i").first().silhouette == -1


def test_silhouette_query_reads_all_rows(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    want = silhouette(np.array(v.embedding.tolist(), dtype=float), v.label.to_numpy())
    assert registry.queries()["m23_silhouette"](spark, "/root/testdata/sf0.1").first().silhouette == pytest.approx(want, abs=1e-7)


def test_silhouette_beyond_5000_rows(spark):
    rows = spark.range(6000).select("id", F.array(F.when(F.col("id") % 2 == 0, F.col("id") * 0.001).otherwise(10 - F.col("id") * 0.0005)).alias("e"), (F.col("id") % 2).alias("c"))
    p = rows.toPandas()
    x, c = np.array(p.e.tolist()), p.c.to_numpy()
    assert labels.silhouette(rows, "e", "c", "id").first().silhouette == pytest.approx(silhouette(x, c), abs=1e-9)


def test_mixture_of_whole_vectors(spark):
    z, columns = model_queries._projected(spark, SF)
    assert len(columns) > 50 and z.count() == 500
    found = registry.queries()["m7_selection"](spark, SF).collect()
    assert [r.k for r in found] == list(range(MixtureConfig().k_min, MixtureConfig().k_max + 1))
    assert sum(r.best_bic for r in found) == sum(r.best_silhouette for r in found) == 1


def test_decoded_states(spark):
    assert [c for c in registry.queries()["m11_decoded"](spark, SF).columns if c.startswith("hmm_state_prob")] == [f"hmm_state_prob_{k}" for k in range(6)]
