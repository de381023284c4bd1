"""Joins on nearly equal numbers against the definition."""

import numpy as np
import pytest

from spillway.operators import lookup


@pytest.mark.parametrize("rtol,atol", [(1e-5, 1e-8), (1e-2, 1e-3), (1e-9, 1e-12)])
def test_every_close_pair_is_found_once(spark, rtol, atol):
    r = np.random.default_rng(1)
    base = np.concatenate([[0.0, 1e-9, -1e-9, 1.0, 2.0, 1000.0, -5.0, 1e12, 1e-7], r.normal(0, 100, 40), 10 ** r.uniform(-9, 9, 40)])
    edge = atol + rtol * np.abs(base)
    asked = np.concatenate([base, base + edge * 0.999999, base - edge * 0.999999, base + edge * 1.000001, base - edge * 1.000001])
    left = [(k % 2, float(x), k) for k, x in enumerate(asked)] + [(0, None, -1), (0, float("nan"), -2), (0, float("inf"), -3)]
    right = [(s, float(x), k) for s in (0, 1) for k, x in enumerate(base)] + [(0, None, -1), (0, float("inf"), -2)]
    a = spark.createDataFrame(left, "series_id int, a double, i int")
    b = spark.createDataFrame(right, "series_id int, b double, j int")
    got = sorted((x["i"], x["j"]) for x in lookup.close_join(a, b, "a", "b", rtol=rtol, atol=atol).collect())
    want = sorted((i, j) for s, x, i in left for z, y, j in right if s == z and x is not None and y is not None and np.isfinite(x) and np.isfinite(y) and abs(x - y) <= atol + rtol * abs(y))
    assert got == want and len(got) >= len(asked) // 2
    kept = lookup.close_join(a, b, "a", "b", rtol=rtol, atol=atol, how="left").collect()
    assert sorted((x["i"], x["j"]) for x in kept if x["j"] is not None) == want
    assert {x["i"] for x in kept} == {i for _, _, i in left} and all(x["j"] is None for x in kept if x["i"] < 0)
