"""Candidate families, the test battery, peaks and station rules against closed forms and planted cases."""

import math
from datetime import datetime

import numpy as np
import pytest
from test_operators import frame, one

from spillway.operators import battery, candidates, dependence, kernels, peaks, station, uncertainty
from spillway.plans import report
from spillway.sources import files


def test_gamma_is_bounded_and_continuous():
    for a in (0.5, 3.0, 400.0, 9999.0, 10001.0, 3.9e12):
        assert math.isclose(kernels.reg_gamma(a, a), 0.5 + 1 / (3 * math.sqrt(2 * math.pi * a)), abs_tol=0.04 / a + 1e-7)
    assert math.isclose(kernels.reg_gamma(1.0, 2.0), 1 - math.exp(-2), rel_tol=1e-12)
    for p in (0.01, 0.9, 0.99, 0.999):
        z = kernels.pearson3_factor(p, 0.0)
        assert math.isclose(kernels.pearson3_factor(p, 3e-6), z + (z * z - 1) * 5e-7, abs_tol=1e-11)
        assert math.isclose(kernels.pearson3_factor(p, 0.02001), kernels.pearson3_factor(p, 0.01999), abs_tol=3e-5)


def test_nine_families_are_gated_and_ranked(spark):
    u = np.arange(1, 81) / 81  # both ends carry more than the 1 / 2n that the gates ask for
    rows = {r["family"]: r for r in candidates.ranking(frame(spark, 100 - 20 * np.log(-np.log(u)))).collect()}
    assert set(rows) == set(candidates.CANDIDATES) and len(rows) == 9
    assert rows["gumbel"]["accepted"] and rows["gumbel"]["rank"] == 1 and rows["gumbel"]["is_best"] and rows["gumbel"]["place"] == 1
    assert "shape" in rows["glogistic"]["reject_reasons"] and "ks" in rows["exponential"]["reject_reasons"]
    assert all(r["place"] > sum(x["accepted"] for x in rows.values()) for r in rows.values() if not r["accepted"])
    q = rows["gumbel"]["quantiles"]
    assert math.isclose(q[5], 100 - 20 * math.log(-math.log(0.99)), rel_tol=0.04) and rows["gumbel"]["qq_r2"] > 0.98
    short = candidates.fit_all(frame(spark, [1.0, 2.0], [5.0] * 20), 50).collect()
    assert len(short) == 18 and all(r["loglik"] is None for r in short)


def test_kolmogorov_tail():
    assert math.isclose(candidates.ks_tail(0.29408, 20), 0.05, abs_tol=2e-4)  # the tabulated 5 % point
    assert math.isclose(candidates.ks_tail(0.096, 200), candidates.ks_tail(0.096, 201), abs_tol=5e-3)


def test_moments_of_known_laws():
    at = {(f, s): (x, y) for f, s, x, y in candidates.locus_points()}
    for name, cs, ck in (("normal", 0.0, 3.0), ("exponential", 2.0, 9.0), ("gumbel", 1.13955, 5.4)):
        assert abs(at[name, None][0] - cs) < 1e-3 and abs(at[name, None][1] - ck) < 1e-3
    assert math.isnan(at["gev", -0.3][1]) and math.isnan(at["log_pearson3", 2.0][0]) and at["log_pearson3", -2.0][1] > 0


def test_shapiro_and_others_on_planted_samples():
    from statistics import NormalDist

    normal = np.array([NormalDist().inv_cdf((i - 0.5) / 50) for i in range(1, 51)])
    w, p = battery.shapiro(normal)
    assert w > 0.98 and p > 0.9
    assert battery.shapiro(np.exp(2 * normal))[1] < 1e-6 and battery.k_squared(np.exp(2 * normal))[1] < 1e-4 and battery.k_squared(normal)[1] > 0.5
    assert math.isclose(battery.t_tail2(2.228139, 10), 0.05, rel_tol=1e-5) and math.isclose(battery.chi2_tail(18.307038, 10), 0.05, rel_tol=1e-6)
    walk, noise = (f(np.random.default_rng(3).normal(size=300)) for f in (np.cumsum, np.array))
    assert battery.adf(noise, "c")[1] < 0.01 and battery.adf(walk, "c")[1] > 0.05
    assert battery.kpss(walk, "c")[1] <= 0.01 + 1e-9 and battery.kpss(noise, "c")[1] > 0.05
    assert battery.pettitt(np.r_[np.zeros(25), np.full(25, 5.0)] + noise[:50], 999)[1:] == (25, pytest.approx(0.001))


def test_battery_is_one_long_table(spark):
    r = np.random.default_rng(5)
    rows = battery.tests(frame(spark, 50 + 2 * np.arange(40) + r.normal(0, 3, 40), [1.0, 2.0]), 200, 200).collect()
    assert {x["series_id"] for x in rows} == {"s0"} and len(rows) >= 30
    by = {(x["variable"], x["test"].split(" at ")[0]): x for x in rows}
    assert by["q", "mann-kendall"]["rejects"] and by["q", "kendall"]["statistic"] > 0.9 and abs(by["q", "sen slope"]["statistic"] - 2) < 0.2


def test_peaks_threshold_and_gates(spark):
    u = (np.arange(1, 401) - 0.5) / 400
    y = 10 / 0.2 * ((1 - u) ** -0.2 - 1)
    base = spark.createDataFrame([("a", float(v)) for v in y], "series_id string, x double")
    xi, beta, _ = kernels.fit_gpd(y)
    assert abs(xi - 0.2) < 0.03 and abs(beta - 10) < 0.5
    with pytest.raises(KeyError):
        peaks.threshold(base, "nobody")
    rows = peaks.gated_fit(base, "quantile").collect()
    assert rows[0]["n"] == 80 and rows[0]["xi_low"] < 0.2 < rows[0]["xi_high"] and len(rows) == 9
    assert rows[0]["accepted"] == (not rows[0]["reject_reasons"]) and all((r["q"] is None) != r["accepted"] for r in rows)


def test_station_rules(spark):
    rows = [("s", i, datetime(1950 + i, 6, 1), 3 * float(1 + v) ** 1.7, 11 + float(v), f"y{i}", True) for i, v in enumerate(np.random.default_rng(2).uniform(0.2, 9, 40))]
    rec = spark.createDataFrame(rows, "series_id string, t int, block timestamp, q double, wl double, label string, is_monsoon boolean").selectExpr("*", "cast(block as date) peak_date")
    top = max(rows, key=lambda r: r[3])
    meta = spark.createDataFrame([("s", 10.0, float(top[4]), float(top[3]), True, 40)], "series_id string, datum double, observed_level double, observed_flow double, is_derived boolean, expected int")
    got = {r["check"]: r["status"] for r in station.checks(rec, meta).collect()}
    assert len(got) == 17 and got["flow_provenance"] == "WARN" and "FAIL" not in got.values()
    moved = rec.withColumn("wl", report.F.when(report.F.col("t") == 0, 99.0).otherwise(report.F.col("wl")))
    bad = {r["check"]: r["status"] for r in station.checks(moved, meta).collect()}
    assert bad["maximum_consistent"] == (got["maximum_consistent"] if top[1] == 0 else "FAIL") and bad["observed_maximum_matches"] == "FAIL"
    counts = one(station.clause_counts(station.checklist(rec, quality=station.checks(rec, meta))))
    assert counts["n_pass"] + counts["n_warn"] + counts["n_fail"] + counts["n_manual"] == 18 and counts["n_manual"] >= 10


def test_hurst_estimates_of_noise(spark):
    s = frame(spark, np.random.default_rng(6).normal(size=200))
    r = one(uncertainty.hurst_spread(s, 100))
    assert r["low"] < 0.5 < r["high"] and abs(one(dependence.hurst_rs(s))["hurst"] - r["hurst_rs"]) < 0.3


def test_sources(spark, tmp_path):
    assert files.canonical_names(["Sl. No.", "Year", "Peak WL (m)", "Recorded Date", "Time", "Discharge* (cumecs)", "Other x"]) == {"Sl. No.": "sl_no", "Year": "wy_label", "Peak WL (m)": "wl_m", "Recorded Date": "recorded_date", "Time": "recorded_time", "Discharge* (cumecs)": "q_cumecs", "Other x": "other_x"}
    (tmp_path / "a.csv").write_text("Year,Peak WL (m),Recorded Date,Discharge (cumecs)\n1999-2000,551.2,05-08-1999,12\n2000-2001,551.5,06-08-2000,15\n", encoding="utf-8")
    record, about = files.load(spark, str(tmp_path / "a.csv"), 550.0, digests=("0" * 64,))
    assert about["changed"] and [r["rank"] for r in record.orderBy("t").collect()] == [1, 2]
    spare = files.read_sheet(spark, str(tmp_path / "a.csv"))
    assert files.load(spark, str(tmp_path / "none.csv"), fallback=spare)[1]["source"] == "fallback"
    assert files.sub_annual(spark.createDataFrame([("1.5",), ("x",)], "Flow string"), "t").first()["x"] == 1.5 and files.sub_annual(spark.range(2)) is None
    assert files.jsonable({"a": math.nan, "b": [np.float64(2), datetime(2020, 1, 1)]}) == {"a": None, "b": [2.0, "2020-01-01T00:00:00"]}
    with pytest.raises(ValueError):
        files.finite("nan")


def test_report_of_named_tables(spark, tmp_path):
    s = frame(spark, np.random.default_rng(8).lognormal(5, 0.5, 40))
    found = report.write(s, str(tmp_path), ("design_values", "quality_control"), ("time_series", "probability_paper"))
    assert set(found.values()) == {"ok"}
    text = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/report.md").collect())
    assert "## Design values" in text and "not available" in text and report.number(12345.6) == "12,346" and report.number(None) == ""
