"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from driftwell.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(float) if df[c].dtype.kind in "fiu" or str(df[c].dtype).startswith(("Int", "Float")) else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_auc_has_an_interval_in_bootstrap_auc(spark):
    got = [r for r in registry.queries()["bootstrap_auc"](spark, SF).collect() if r.metric == "auc"]
    assert got and all(r.low <= r.high for r in got if r.low is not None)


def test_number_of_states_goes_up_to_four(spark):
    fits = registry.queries()["hmm_fit"](spark, SF)
    assert {r.k for r in fits.select("k").distinct().collect()} == {1, 2, 3, 4}
    assert "converged" in fits.columns
    assert registry.queries()["regimes_by_bic"](spark, SF).columns == ["series", "k_1", "k_2", "k_3", "k_4"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = plain(registry.queries()[name](spark, SF).toPandas()), plain(duck.sql(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float and want[c].dtype == float:
            assert np.allclose(got[c], want[c], rtol=0, atol=2e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
