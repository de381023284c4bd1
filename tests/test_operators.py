"""Operators against closed forms, NumPy and planted cases."""

import math
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from spillway.functions import special
from spillway.operators import battery, candidates, dependence, features, frequency, kernels, moments, quality, resampling, series, station, thresholds, trend, uncertainty


def frame(spark, *records, names=None):
    rows = [(names[k] if names else f"s{k}", i + 1, datetime(2000, 1, 1) + timedelta(days=i), float(v)) for k, r in enumerate(records) for i, v in enumerate(r)]
    return spark.createDataFrame(rows, "series_id string, t int, block timestamp, q double")


def one(df):
    return df.collect()[0].asDict()


def test_normal_functions(spark):
    p = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(x,) for x in p], "p double").selectExpr("p", f"{special.norm_ppf('p')} AS z").selectExpr("p", "z", f"{special.norm_cdf('z')} AS back")
    for r in df.collect():
        assert math.isclose(r["z"], NormalDist().inv_cdf(r["p"]), rel_tol=1e-8, abs_tol=1e-9)
        assert math.isclose(r["back"], r["p"], rel_tol=1e-8)


def test_chi2_tail(spark):
    got = spark.sql(f"SELECT {special.chi2_sf('CAST(18.307038 AS DOUBLE)', 10)} AS a, {special.chi2_sf('CAST(11.0704977 AS DOUBLE)', 5)} AS b, {special.chi2_sf('CAST(3.84145882 AS DOUBLE)', 1)} AS c").first()
    assert all(math.isclose(x, 0.05, rel_tol=1e-6) for x in got)


def test_exponential_quantiles_have_known_lmoments(spark):
    n = 5000
    r = one(moments.lmoments(frame(spark, [-math.log(1 - (i - 0.35) / n) for i in range(1, n + 1)])))
    assert math.isclose(r["tau3"], 1 / 3, abs_tol=5e-3) and math.isclose(r["tau4"], 1 / 6, abs_tol=5e-3) and math.isclose(r["lcv"], 0.5, abs_tol=5e-3)
    assert r["ratios_reliable"]


def test_moments_of_short_and_constant_series(spark):
    df = moments.moment_coefficients(frame(spark, [1, 2, 3], [5] * 20))
    assert all(r["skew"] is None and r["ck"] is None for r in df.collect())
    assert one(trend.mann_kendall(frame(spark, [5] * 20)))["z"] is None
    assert all(r["r"] is None for r in dependence.acf(frame(spark, [5] * 20)).collect())


def test_planted_trend_change_outlier(spark):
    r = np.random.default_rng(1)
    rising = frame(spark, 100 + 2 * np.arange(40) + r.normal(0, 3, 40))
    assert one(trend.mann_kendall(rising))["p"] < 1e-6
    assert abs(one(trend.theil_sen(rising))["slope"] - 2) < 0.2
    step = frame(spark, np.concatenate([r.normal(10, 1, 25), r.normal(20, 1, 25)]))
    c = one(trend.pettitt(step))
    assert c["change_at"] == 25 and c["p"] < 1e-3
    x = r.normal(100, 5, 40)
    x[17] = 200
    g = one(quality.grubbs(frame(spark, x)))
    assert g["t"] == 18 and g["is_outlier"]


def test_acf_and_pacf_match_numpy(spark):
    r = np.random.default_rng(4)
    x = [0.0]
    for e in r.normal(size=300):
        x.append(0.6 * x[-1] + e)
    s = frame(spark, x)
    got = {a["lag"]: a["r_biased"] for a in dependence.acf(s).collect()}
    d = np.array(x) - np.mean(x)
    for k in range(1, 15):
        assert math.isclose(got[k], float((d[k:] * d[:-k]).sum() / (d * d).sum()), rel_tol=1e-9)
    p = {a["lag"]: a["pacf"] for a in dependence.pacf(s, 6).collect()}
    rho = {a["lag"]: a["r"] for a in dependence.acf(s, 6).collect()}
    for k in range(1, 7):
        m = np.array([[1.0 if i == j else rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert math.isclose(p[k], np.linalg.solve(m, [rho[i] for i in range(1, k + 1)])[-1], rel_tol=1e-8)


def test_memory_of_noise_is_one_half(spark):
    r = np.random.default_rng(6)
    h = one(dependence.hurst(frame(spark, r.normal(size=2000))))["hurst"]
    assert abs(h - 0.5) < 0.08
    ids = spark.createDataFrame([(f"n{i}",) for i in range(4)], "series_id string")
    noise = kernels.fractional_noise(ids, 1500, 0.8).withColumn("block", F.timestamp_seconds("t"))
    assert abs(np.mean([x["hurst"] for x in dependence.hurst(noise).collect()]) - 0.8) < 0.1


def test_order_guard(spark):
    assert one(series.order_guard(frame(spark, [1, 2, 3, 4])))["looks_sorted"]
    assert not one(series.order_guard(frame(spark, [1, 3, 2, 4])))["looks_sorted"]
    with pytest.raises(Exception, match="time order"):
        series.require_time_order(frame(spark, [1, 2, 3, 4])).collect()
    assert series.require_time_order(frame(spark, [1, 3, 2, 4])).count() == 4


def test_no_feature_knows_its_target(spark):
    x = [float(v) for v in np.random.default_rng(0).uniform(200, 900, 30)]
    base = {r["t"]: r for r in features.lag_features(frame(spark, x)).drop("q").collect()}
    y = list(x)
    y[15] *= 1e6
    for t, r in {r["t"]: r for r in features.lag_features(frame(spark, y)).drop("q").collect()}.items():
        assert (r == base[t]) == (t <= 16)


def test_plotting_positions(spark):
    with pytest.raises(KeyError):
        series.plotting_position(F.lit(1), F.lit(2), "nobody")
    rows = series.probabilities(frame(spark, [3, 1, 2])).orderBy("rank").collect()
    assert [r["q"] for r in rows] == [1, 2, 3] and [r["p_weibull"] for r in rows] == [0.25, 0.5, 0.75]


def test_exact_factor_near_approximation_and_symmetric():
    for g in (0.3, 1.0, 2.5):
        for p in (0.01, 0.5, 0.99):
            assert math.isclose(kernels.pearson3_factor(p, g), -kernels.pearson3_factor(1 - p, -g), rel_tol=1e-9, abs_tol=1e-12)
    assert math.isclose(kernels.pearson3_factor(0.99, 2.0), -math.log(0.01) - 1, rel_tol=1e-9)  # skew 2 is the exponential
    assert math.isclose(kernels.pearson3_factor(0.99, 0.0), NormalDist().inv_cdf(0.99))


def test_searched_fits_find_their_parents(spark):
    u = (np.arange(1, 801) - 0.5) / 800
    gumbel = 100 - 20 * np.log(-np.log(u))
    fits = {r["family"]: r for r in candidates.fit_all(frame(spark, gumbel), 200).collect()}
    assert abs(fits["gumbel"]["p1"] - 100) < 1 and abs(fits["gumbel"]["p2"] - 20) < 1 and abs(fits["gev"]["p3"]) < 0.05
    weibull = 50 * (-np.log(1 - u)) ** (1 / 1.7)
    w = {r["family"]: r for r in candidates.fit_all(frame(spark, weibull), 200).collect()}["weibull"]
    assert abs(w["p1"] - 50) < 1 and abs(w["p2"] - 1.7) < 0.05


def test_pareto_by_both_methods(spark):
    u = (np.arange(1, 2001) - 0.5) / 2000
    y = 10 / 0.2 * ((1 - u) ** -0.2 - 1)
    base = spark.createDataFrame([("a", datetime(2000, 1, 1), float(v)) for v in y], "series_id string, ts timestamp, x double")
    over = thresholds.exceedances(base, 0.0)
    a, b = one(thresholds.gpd_pwm(over)), one(kernels.gpd_profile(over, 101))
    assert abs(a["xi"] - 0.2) < 0.03 and abs(a["beta"] - 10) < 0.5
    assert abs(b["xi"] - 0.2) < 0.06 and b["xi_low"] < 0.2 < b["xi_high"]
    levels = [r["q"] for r in thresholds.return_levels(thresholds.gpd_pwm(over)).orderBy("period").collect()]
    assert levels == sorted(levels)


def test_return_level_limit(spark):
    fit = spark.createDataFrame([("a", 5.0, 0.0, 2.0, 1.0), ("b", 5.0, 1e-6, 2.0, 1.0)], "series_id string, u double, xi double, beta double, rate double")
    r = {(x["series_id"], x["period"]): x["q"] for x in thresholds.return_levels(fit).collect()}
    assert all(math.isclose(r["a", t], r["b", t], rel_tol=1e-4) for t in (2.0, 1000.0))


def test_rating_curve_and_level(spark):
    rows = [("s", i, 3 * (1 + i / 10) ** 1.7, 1 + i / 10) for i in range(40)]
    pairs = spark.createDataFrame(rows, "series_id string, t int, q double, h double")
    c = quality.rating_curve(pairs)
    r = one(c)
    assert math.isclose(r["b"], 1.7, rel_tol=1e-9) and math.isclose(r["a"], math.log10(3), rel_tol=1e-9)
    lv = quality.level(spark.createDataFrame([("s", 3 * 2.5**1.7), ("s", 1e6)], "series_id string, q double"), c).orderBy("q").collect()
    assert math.isclose(lv[0]["h"], 2.5, rel_tol=1e-9) and not lv[0]["extrapolated"] and lv[1]["extrapolated"]
    with pytest.raises(Exception, match="datum"):
        quality.discharge(spark.createDataFrame([("s", 0.0)], "series_id string, h double"), c).collect()


def test_quality_flags(spark):
    good = frame(spark, np.random.default_rng(3).lognormal(3, 0.6, 40))
    assert one(quality.status_counts(quality.checks(good)))["admissible"]
    gap = good.filter("t <> 20")
    assert {r["check"]: r["status"] for r in quality.checks(gap).collect()}["record_contiguous"] == "FAIL"
    assert one(quality.dixon(frame(spark, [1.0] + [100.0 + i for i in range(9)])))["is_outlier"]
    assert one(quality.dixon(frame(spark, range(11))))["is_outlier"] is None


def test_draws_do_not_depend_on_partitions(spark):
    s = frame(spark, np.arange(57.0) + 1)
    a = sorted(map(tuple, resampling.case_resamples(s, 20).collect()))
    b = sorted(map(tuple, resampling.case_resamples(s.repartition(7), 20).collect()))
    assert a == b
    u = spark.range(2000).select(resampling.uniform("cast(id div 57 as bigint)", "cast(id % 57 as bigint)").alias("u"))
    m = u.agg(F.avg("u"), F.stddev("u"), F.min("u"), F.max("u")).first()
    assert abs(m[0] - 0.5) < 0.02 and abs(m[1] - 12**-0.5) < 0.02 and m[2] > 0 and m[3] < 1


def test_intervals_hold_their_point(spark):
    s = frame(spark, np.random.default_rng(8).lognormal(7, 0.5, 57))
    q = resampling.quantile_replicates(resampling.case_resamples(s, 100))
    iv = {r["period"]: r for r in resampling.percentile_interval(q).collect()}
    assert all(r["low"] <= r["median"] <= r["high"] for r in iv.values())
    points = spark.createDataFrame([("s0", t, r["median"]) for t, r in iv.items()], "series_id string, period double, point double")
    for r in resampling.bias_corrected_interval(q, points).collect():
        assert r["low"] <= r["point"] <= r["high"]


def test_chains_agree(spark):
    s = frame(spark, np.random.default_rng(9).lognormal(7, 0.5, 57))
    chains = kernels.mcmc(s, 3, 1500, 500).cache()
    assert all(r["r_hat"] < 1.2 for r in resampling.split_r_hat(chains).collect())
    mean = {r["parameter"]: r["mean"] for r in resampling.posterior(chains).collect()}
    fit = one(moments.log_moments(s))
    assert abs(mean["mean_log"] - fit["mean_log"]) < 0.2 and abs(mean["sd_log"] - fit["sd_log"]) < 0.15


def test_gates_and_ranking(spark):
    u = (np.arange(1, 101) - 0.5) / 100
    x = np.exp([7 + 0.5 * NormalDist().inv_cdf(p) for p in u])
    r = {a["family"]: a for a in frequency.ranking(frame(spark, x)).collect()}
    assert r["ln2"]["accepted"] and r["ln2"]["rank"] == 1
    assert not r["exponential"]["accepted"] and "ks" in r["exponential"]["reject_reasons"]
    assert math.isclose(sum(a["weight"] for a in r.values() if a["accepted"]), 1)


def test_synthetic_series_are_positive_and_fixed(spark):
    a = series.synthetic(spark, 200, seed=3, loc=1.0, scale=5.0)
    assert a.filter("q <= 0").count() == 0
    b = series.synthetic(spark, 200, seed=3, loc=1.0, scale=5.0).repartition(5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_the_references_numbers_are_the_defaults():
    import inspect

    from spillway.operators import learning

    default = lambda f, k: inspect.signature(f).parameters[k].default
    for f in (resampling.case_resamples, resampling.moment_replicates, resampling.parametric_resamples, resampling.lp3_intervals, resampling.block_resamples):
        assert default(f, "reps") == 2000
    assert default(resampling.fan, "reps") == 500
    assert (default(resampling.coverage, "reps"), default(resampling.coverage, "inner")) == (200, 500)
    assert [default(kernels.mcmc, k) for k in ("chains", "draws", "burn", "pilot")] == [4, 30_000, 10_000, 5_000]
    assert default(learning.forecasts, "k") == 5


def test_posterior_quantiles_are_withheld_from_chains_that_do_not_mix(spark):
    r = np.random.default_rng(1)
    rows = [(sid, "p", c, i, float(r.standard_normal() + (3 * c if sid == "bad" else 0)), 0.3) for sid in ("good", "bad") for c in range(4) for i in range(1500)]
    out = {x["series_id"]: x for x in resampling.posterior(spark.createDataFrame(rows, "series_id string, parameter string, chain int, draw int, value double, acceptance double")).collect()}
    assert out["good"]["accepted"] and abs(out["good"]["median"]) < 0.1 and out["good"]["ess"] > 2000
    assert not out["bad"]["accepted"] and out["bad"]["low"] is None and out["bad"]["median"] is None


def test_a_maximum_held_by_two_blocks_is_not_consistent(spark):
    q = {"one": [3.0, 9.0, 4.0], "two": [9.0, 2.0, 9.0], "none": [None, None, None]}
    rows = [(k, t + 1, f"2000-01-0{t + 1}", v) for k, vs in q.items() for t, v in enumerate(vs)]
    series = spark.createDataFrame(rows, "series_id string, t int, block string, q double").selectExpr("series_id", "t", "CAST(block AS TIMESTAMP) AS block", "q")
    got = {r["series_id"]: (r["status"], r["value"]) for r in quality.checks(series).filter("check = 'maximum_consistent'").collect()}
    assert got == {"one": ("PASS", 1.0), "two": ("FAIL", 2.0), "none": ("FAIL", 0.0)}
