"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from pitchlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries that take many passes; the others cover their parts.
SLOW = {"m3_states", "m7_selection", "m8_states", "m14_sequences", "s17_transitions", "m18_codes", "m28_signals", "m30_by_signal", "a11_loadings", "a11_importance"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) if isinstance(r[i], (list, dict)) else r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
