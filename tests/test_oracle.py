"""Every registered query with SQL gives the SQL's rows on the smallest tables; the others run and have rows."""

import os

import numpy as np
import pytest

from spillway import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SLOW = {"learned_scores", "posterior", "coverage", "lp3_intervals", "r_hat", "combined_intervals", "station_checklist", "parameter_spread", "monte_carlo_refit", "posterior_bins"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=2e-3, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_matches_sql(spark, duck, name):
    _same(q.QUERIES[name](spark, SF).toPandas(), duck.execute(q.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE) - SLOW))
def test_runs(spark, duck, name):
    assert q.QUERIES[name](spark, SF).count() > 0
