"""Statistics over all pairs, gamma and Student laws against brute force, closed forms and tables."""

import math

import numpy as np
import pytest
from test_operators import frame, one

from spillway.functions.special import gamma_steps, pearson3_factor_steps, pearson3_steps, student_steps
from spillway.operators import candidates, frequency, inversions, kernels, trend


def brute_slopes(t, q):
    i, j = np.triu_indices(len(t), 1)
    return np.sort((q[j] - q[i]) / (t[j] - t[i]))


def test_counting_and_listing():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 50, 301):
        for most in (3, 50, 10**6):
            x = r.integers(0, most, n)
            want = np.array([(x[:k] > x[k]).sum() for k in range(n)])
            assert (inversions.counted(x) == want).all()
            i, j = inversions.listed(x)
            assert len(i) == want.sum() == len(set(zip(i, j, strict=True))) and (x[i] > x[j]).all() and (i < j).all()


@pytest.mark.parametrize("bucket,most,together", [(20_000, 500, 100_000), (20, 8, 30), (7, 40, 10)])
def test_inversions_in_buckets(spark, monkeypatch, bucket, most, together):
    monkeypatch.setattr(inversions, "BUCKET", bucket)
    monkeypatch.setattr(inversions, "MOST", most)
    monkeypatch.setattr(inversions, "TOGETHER", together)
    r = np.random.default_rng(1)
    rows, want = [], {}
    for s, n in enumerate((2, 9, 60, 200, 300)):
        x = r.integers(0, n, n) if s % 2 else np.arange(n)
        y = np.where(r.random(n) < 0.4, 5, r.integers(0, 40, n))  # one value fills much of the record
        rows += [(f"s{s}", float(a), float(b)) for a, b in zip(x, y, strict=True)]
        d = sum(((x[k] - x) * (y[k] - y) < 0).sum() for k in range(n)) // 2
        want[f"s{s}"] = d
    rows += [("s0", None, 1.0), ("s0", 1.0, None)]
    got = inversions.inversions(spark.createDataFrame(rows, "series_id string, x double, y double").repartition(3), "x", "y").groupBy("series_id").sum("d").collect()
    assert {g[0]: g[1] for g in got} == want


def test_slopes_of_rank():
    r = np.random.default_rng(2)
    for n in (250, 700):
        t = np.cumsum(r.integers(1, 4, n)).astype(float)
        for q in (r.normal(size=n), r.integers(0, 5, n).astype(float), 2 * t, 3 * t + r.integers(0, 3, n), np.zeros(n)):
            s = brute_slopes(t, q)
            for k in (0, 5, len(s) // 3, len(s) // 2, len(s) - 1):
                assert math.isclose(inversions.slope_of_rank(t, q, k), s[k], rel_tol=1e-12, abs_tol=1e-12)


def test_theil_sen_beyond_all_slopes(spark, monkeypatch):
    monkeypatch.setattr(inversions, "LISTED", 50)
    r = np.random.default_rng(3)
    q = 0.5 * np.arange(1, 121) + r.normal(size=120)
    s = brute_slopes(np.arange(1, 121).astype(float), q)
    row = one(trend.theil_sen(frame(spark, q.tolist())))
    assert math.isclose(row["slope"], np.median(s), rel_tol=1e-12) and row["pairs"] == len(s)
    assert row["slope_low"] < 0.5 < row["slope_high"] and row["slope_low"] in s and row["slope_high"] in s


def test_a_hundred_thousand_values(spark):
    r = np.random.default_rng(4)
    n = 100_000
    q = 1e-4 * np.arange(n) + r.normal(size=n)
    df = spark.createDataFrame([(int(t) + 1, float(v)) for t, v in enumerate(q)], "t int, q double").selectExpr("'a' AS series_id", "t", "q")
    row = one(trend.mann_kendall(df))
    assert row["s"] == n * (n - 1) // 2 - 2 * int(inversions.counted(q).sum()) and row["p"] < 1e-12
    assert abs(one(trend.theil_sen(df))["slope"] - 1e-4) < 1e-6


def test_exact_null_laws(spark):
    assert inversions.inversion_counts(4) == [1, 3, 5, 6, 5, 3, 1] and sum(inversions.inversion_counts(12)) == math.factorial(12)
    kendall = {(r["n"], r["d"]): r["p"] for r in inversions.kendall_law(spark, 10).collect()}
    assert abs(kendall[10, 11] / 2 - 0.023) < 5e-4 and abs(kendall[10, 12] / 2 - 0.036) < 5e-4  # tabulated tails of S = 23 and 21
    assert math.isclose(kendall[4, 0], 2 / 24) and kendall[4, 3] == 1.0
    spearman = {(r["n"], r["d2"]): r["p"] for r in inversions.spearman_law(spark, 6).collect()}
    assert math.isclose(spearman[5, 0], 2 / 120) and math.isclose(spearman[6, 4], 2 * 12 / 720)  # tabulated tails
    row = one(trend.kendall(frame(spark, [1.0, 3, 2, 5, 4, 7, 6, 9, 8, 10])))
    assert row["is_exact"] and math.isclose(row["tau"], 1 - 2 * 4 / 45) and math.isclose(row["p"], kendall[10, 4])
    tied = one(trend.kendall(frame(spark, [1.0, 1, 2, 2, 3, 3, 4, 4])))
    assert not tied["is_exact"] and math.isclose(tied["tau"], 24 / math.sqrt(28 * 24))
    assert one(trend.spearman(frame(spark, [2.0, 1, 3, 5, 4])))["is_exact"]


def _at(spark, df, steps, *cols):
    return [tuple(r) for r in frequency.staged(df, steps).select(*cols).collect()]


def test_gamma_student_and_pearson(spark):
    pairs = [(a, a * f) for a in (0.4, 1.0, 6.0, 90.0, 110.0, 5000.0) for f in (0.3, 0.97, 1.0, 1.02, 1.6)]
    for a, x, p, q in _at(spark, spark.createDataFrame(pairs, "a double, x double"), gamma_steps("a", "x", "g"), "a", "x", "g_p", "g_q"):
        assert math.isclose(p, kernels.reg_gamma(a, x), rel_tol=1e-8, abs_tol=1e-12) and math.isclose(p + q, 1, abs_tol=1e-12)
        if a == 1:
            assert math.isclose(q, math.exp(-x), rel_tol=1e-12)
    # Two-sided 5 % and 1 % points of Student's law from its tables.
    table = [(12.7062047, 1.0, 0.05), (4.3026527, 2.0, 0.05), (2.2281389, 10.0, 0.05), (2.0859634, 20.0, 0.05), (2.7499957, 30.0, 0.01)]
    for _t, _df, want, p in _at(spark, spark.createDataFrame(table, "t double, df double, want double"), student_steps("t", "df", "p"), "t", "df", "want", "p"):
        assert math.isclose(p, want, rel_tol=2e-7)
    factors = [(p, g) for p in (0.01, 0.5, 0.99, 0.999) for g in (-2.0, -0.3, 0.0, 0.05, 0.5, 1.5)]
    for p, g, k in _at(spark, spark.createDataFrame(factors, "p double, g double"), pearson3_factor_steps("p", "g", "k"), "p", "g", "k"):
        assert math.isclose(k, kernels.pearson3_factor(p, g), abs_tol=3e-6)
    back = spark.createDataFrame([(kernels.pearson3_factor(p, g), 0.0, 1.0, g, p) for p, g in factors], "y double, m double, s double, g double, p double")
    for p, cdf, sf in _at(spark, back, pearson3_steps("y", "m", "s", "g", "w"), "p", "w_cdf", "w_sf"):
        assert math.isclose(cdf, p, abs_tol=1e-9) and math.isclose(sf, 1 - p, abs_tol=1e-9)


def test_implied_period_beyond_the_table(spark):
    q = [100 + 3 * k for k in range(30)] + [5000.0]
    s = frame(spark, [float(x) for x in q])
    row = one(frequency.implied_periods(s, frequency.lp3(s, factors=kernels.exact_factors(frequency.log_moments(s).withColumnRenamed("skew_log", "skew"))).filter("period <= 50")))
    assert row["implied_period"] > 2 * 32 and not row["passed"]
    total = sum(r["density"] * 1.0 for r in frequency.lp3_distribution(s).collect())
    assert total > 0


def test_fits_after_loci(spark):
    """What the loci compute in the driver must not stay in what the fits are pickled with."""
    candidates.locus_points()
    assert candidates.fit_all(frame(spark, [float(10 + k % 7 + k) for k in range(12)]), 20).count() == 9
