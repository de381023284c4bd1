"""Ranks, percentiles and running sums in buckets against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import one

from spillway.operators import peaks, ranks, thresholds


def records(seed=0):
    r = np.random.default_rng(seed)
    return {"a": r.gumbel(100, 20, 400), "ties": np.where(r.random(300) < 0.4, 7.0, r.integers(0, 30, 300)).astype(float), "one": np.full(60, 3.0), "short": np.array([5.0]), "wide": np.exp(r.normal(0, 6, 250))}


def table(spark, rec):
    return spark.createDataFrame([(k, float(v)) for k, x in rec.items() for v in x], "series_id string, x double").repartition(4)


@pytest.fixture(params=[(200_000, 200), (50, 9)])
def buckets(request, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET", request.param[0])
    monkeypatch.setattr(ranks, "CUTS", request.param[1])


def test_percentiles(spark, buckets):
    rec, at = records(), (0.0, 0.1, 0.5, 0.92, 0.999, 1.0)
    df = table(spark, rec).unionByName(spark.createDataFrame([("a", None)], "series_id string, x double"))
    got = {r["series_id"]: r for r in ranks.percentiles(df, at).collect()}
    for k, x in rec.items():
        assert np.allclose(got[k]["values"], np.percentile(x, [100 * p for p in at]), rtol=1e-12) and got[k]["n"] == len(x)


def test_ranks_and_running_sums(spark, buckets):
    rec = records(1)
    rows = ranks.running(table(spark, rec), {"s": F.col("x"), "l": F.log(F.col("rank").cast("double"))}).collect()
    for k, x in rec.items():
        own = sorted((r for r in rows if r["series_id"] == k), key=lambda r: r["rank"])
        z = np.sort(x)[::-1]
        assert [r["rank"] for r in own] == list(range(1, len(x) + 1)) and np.allclose([r["x"] for r in own], z) and own[0]["n"] == len(x)
        assert np.allclose([r["s"] for r in own], np.concatenate([[0], np.cumsum(z)[:-1]]))
        assert np.allclose([r["l"] for r in own], np.concatenate([[0], np.cumsum(np.log(np.arange(1, len(x) + 1)))[:-1]]))


def scan(z):
    """The search as defined: every order statistic, all excesses."""
    z, m, best = np.sort(z), len(z), None
    for k in range(max(2, int(0.05 * m)), min(max(3, int(0.95 * m)), m - 1) + 1):
        y = z[k:] - z[k - 1]
        if m >= 10 and len(y) >= 3 and y.mean() > 0:
            d = round(float(((y + np.log1p(-np.arange(1, len(y) + 1) / (len(y) + 1.0)) * y.mean()) ** 2).sum()), 9)
            if best is None or d < best[3]:
                best = (k, float(z[k - 1]), len(y), d)
    return best or (None,) * 4


def test_exponential_distance(spark, buckets):
    rec = {k: v for k, v in records(2).items() if k != "wide"}
    got = {r["series_id"]: r for r in peaks.jenkinson_collison(table(spark, rec)).collect()}
    for k, x in rec.items():
        want, r = scan(x), got[k]
        assert (r["k"], r["n"]) == (want[0], want[2]), k
        if want[0]:
            assert np.isclose(r["threshold"], want[1]) and np.isclose(r["distance"], want[3], rtol=1e-6, atol=1e-6)


def test_moments_over_thresholds(spark, buckets):
    rec = records(3)
    rows = {(r["series_id"], r["k"]): r for r in thresholds.mean_residual_life(table(spark, rec)).collect()}
    x = rec["a"]
    for k, u in enumerate(np.linspace(x.min(), np.percentile(x, 92), 40)):
        y = x[x > u] - u
        r = rows["a", k]
        assert r["n"] == len(y) and np.isclose(r["mean_excess"], y.mean()) and np.isclose(r["sd"], y.std(ddof=1))
    fits = {(r["series_id"], r["at"]): r for r in thresholds.threshold_stability(table(spark, rec)).collect()}
    for at in (0.7, 0.95):
        u = np.percentile(x, 100 * at)
        y = np.sort(x[x > u] - u)
        n = len(y)
        a0, a1 = y.mean(), (y * (n - np.arange(1, n + 1)) / (n - 1)).mean()
        r = fits["a", at]
        assert r["n"] == n and np.isclose(r["xi"], 2 - a0 / (a0 - 2 * a1)) and np.isclose(r["beta"], 2 * a0 * a1 / (a0 - 2 * a1))
    over = one(thresholds.gpd_pwm(thresholds.exceedances(table(spark, {"a": x}), 0.95)))
    assert np.isclose(over["xi"], fits["a", 0.95]["xi"]) and over["n_base"] == len(x)


def test_percentile_between_equal_values_is_that_value(spark, buckets):
    rec = {f"s{i}": np.repeat(v, 61) for i, v in enumerate((127.71, 60.67, 0.1, 115.26, 68.61, 113.35))}
    at = tuple(i / 97 for i in range(98))
    for r in ranks.percentiles(table(spark, rec), at).collect():
        assert set(r["values"]) == {rec[r["series_id"]][0]}
    x = np.repeat(np.round(np.random.default_rng(5).exponential(50, 40), 2), 60)
    for r in thresholds.threshold_stability(table(spark, {"copies": x})).collect():
        lo, hi = (np.percentile(x, 100 * r["at"], method=m) for m in ("lower", "higher"))
        assert r["n"] == (x > (lo if lo == hi else (lo + hi) / 2)).sum()


def test_sums_over_thresholds_read_the_records_once_and_rank_no_row(spark, buckets, tmp_path, monkeypatch):
    rec = records(4)
    table(spark, rec).write.parquet(f"{tmp_path}/base")
    base = spark.read.parquet(f"{tmp_path}/base")
    monkeypatch.setattr(ranks, "_long", lambda df: pytest.fail("a job of its own over the records"))
    counted = {r["series_id"]: r for r in thresholds.gpd_pwm(thresholds.counted_exceedances(base)).collect()}
    plain = {r["series_id"]: r for r in thresholds.gpd_pwm(thresholds.exceedances(base)).collect()}
    assert counted.keys() == plain.keys() and {"a", "ties", "wide"} <= counted.keys()
    for k, r in plain.items():
        assert (counted[k]["n"], counted[k]["n_base"]) == (r["n"], r["n_base"]) and np.isclose(counted[k]["beta"], r["beta"]) and np.isclose(counted[k]["xi"], r["xi"])
    assert thresholds.mean_residual_life(base).count() and thresholds.threshold_stability(base).count()
