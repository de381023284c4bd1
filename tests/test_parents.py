"""Samples and intervals of all nine families."""

import math

import numpy as np
from test_operators import frame

from spillway.operators import dependence, kernels, parents, uncertainty

LAWS = {
    "gumbel": (100.0, 20.0, None), "ln2": (4.0, 0.5, None), "lp3": (4.0, 0.4, 0.6), "gev": (100.0, 20.0, -0.1), "weibull": (100.0, 2.0, None),
    "exponential": (50.0, None, None), "gnormal": (100.0, 20.0, 1.5), "glogistic": (100.0, 10.0, 2.0), "loglogistic": (100.0, 4.0, None),
}


def laws(spark, n=200):
    return spark.createDataFrame([("s", f, n, *p) for f, p in LAWS.items()], "series_id string, family string, n long, p1 double, p2 double, p3 double")


def exact(family, u):
    p = [v for v in LAWS[family] if v is not None]
    if family == "ln2":
        return math.exp(p[0] + p[1] * kernels.pearson3_factor(u, 0.0))
    return -p[0] * math.log(1 - u) if family == "exponential" else kernels.family_quantile(family, p, u)


def test_points_of_all_families(spark):
    rows = parents.points(laws(spark)).collect()
    assert len(rows) == 9 * 9
    for r in rows:
        assert math.isclose(r["point"], exact(r["family"], 1 - 1 / r["period"]), rel_tol=3e-5), r


def test_samples_follow_their_laws(spark):
    drawn = parents.samples(laws(spark), reps=20).toPandas()
    assert len(drawn) == 9 * 20 * 200
    for family, x in drawn.groupby("family")["q"]:
        x = np.sort(x)
        for u in (0.05, 0.5, 0.95):
            below = np.searchsorted(x, exact(family, u)) / len(x)
            assert abs(below - u) < 0.02, (family, u, below)
    again = parents.samples(laws(spark).repartition(7), reps=20).toPandas()
    key = ["family", "rep", "t"]
    assert drawn.sort_values(key)["q"].tolist() == again.sort_values(key)["q"].tolist()


def test_intervals_hold_the_point(spark):
    rows = parents.intervals(laws(spark, 100), reps=100).collect()
    assert len(rows) == 81 and all(r["low"] < r["point"] < r["high"] for r in rows if r["period"] <= 25)
    r = np.random.default_rng(1)
    table = parents.ln2_intervals(frame(spark, np.exp(r.normal(4, 0.5, 60)), [5.0] * 9), 200).orderBy("period").collect()
    assert len(table) == 9 and all(t["ci_low"] < t["ci_high"] and t["percentile_low"] < t["percentile_high"] for t in table)
    assert table[-1]["case_high"] <= math.exp(4 + 0.5 * 6) and table[3]["relative_width"] > 0


def test_qq_points(spark):
    q = np.sort(np.random.default_rng(2).gumbel(100, 20, 30))
    s = frame(spark, q, names=["s"])
    rows = [r for r in parents.qq_points(s, laws(spark)).collect() if r["family"] in ("gumbel", "lp3")]
    assert len(rows) == 60
    for r in rows:
        assert math.isclose(r["q"], q[r["rank"] - 1]) and math.isclose(r["fitted"], exact(r["family"], r["rank"] / 31), rel_tol=3e-5)


def test_bins_hold_all_draws(spark):
    r = np.random.default_rng(3)
    rows = [("s", c, d, p, float(v)) for c in range(2) for d in range(500) for p, v in (("mean_log", r.normal(4, 0.1)), ("sd_log", abs(r.normal(0.5, 0.02))), ("skew_log", 0.25))]
    chains = spark.createDataFrame(rows, "series_id string, chain int, draw int, parameter string, value double")
    bins = uncertainty.binned(chains.unionByName(uncertainty.predictive(chains))).collect()
    by = {p: [b for b in bins if b["parameter"] == p] for p in ("mean_log", "sd_log", "skew_log", "Q100", "Q1000")}
    assert {p: len(b) for p, b in by.items()} == {"mean_log": 45, "sd_log": 45, "skew_log": 1, "Q100": 45, "Q1000": 45}
    assert all(sum(x["count"] for x in b) == 1000 for b in by.values())
    x = np.array([v for *_, p, v in rows if p == "mean_log"])
    assert [b["count"] for b in sorted(by["mean_log"], key=lambda b: b["bin"])] == np.histogram(x, 45)[0].tolist()
    assert math.isclose(sum(b["density"] * (b["right"] - b["left"]) for b in by["Q100"]), 1.0)


def test_acf_of_residuals_by_family(spark):
    r = np.random.default_rng(4)
    z = r.normal(size=60)
    rows = [("a#b", f, t + 1, float(v)) for f in ("ln2", "gev") for t, v in enumerate(z)]
    out = dependence.residual_acf(spark.createDataFrame(rows, "series_id string, family string, t int, z double")).collect()
    d = z - z.mean()
    one = {(x["family"], x["lag"]): x["r_biased"] for x in out}
    assert {x["series_id"] for x in out} == {"a#b"} and len(out) == 30
    assert math.isclose(one["gev", 3], (d[3:] @ d[:-3]) / (d @ d), rel_tol=1e-9) and one["gev", 3] == one["ln2", 3]
