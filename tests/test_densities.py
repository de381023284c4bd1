"""Binned kernel densities against direct sums, and their summaries."""

import math

import numpy as np
from test_operators import frame, one

from spillway.operators import densities


def direct(x, grid):
    h = x.std(ddof=1) * len(x) ** -0.2
    return np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))


def test_density_against_direct_sums(spark):
    r = np.random.default_rng(0)
    records = [np.exp(r.normal(5, 0.6, 57)), np.round(r.gumbel(100, 20, 300)), np.full(20, 4.0), np.array([3.0])]
    rows = densities.density(frame(spark, *records)).collect()
    assert {x["series_id"] for x in rows} == {"s0", "s1"}
    for k in (0, 1):
        own = sorted((x for x in rows if x["series_id"] == f"s{k}"), key=lambda x: x["i"])
        logs = np.log(records[k])
        grid = np.linspace(logs.min(), logs.max(), 400)
        assert np.allclose([x["x"] for x in own], grid) and np.allclose([x["q"] for x in own], np.exp(grid))
        assert np.allclose([x["density"] for x in own], direct(logs, grid), rtol=2e-5, atol=1e-6)
        assert np.allclose([x["ecdf"] for x in own], np.searchsorted(np.sort(logs), grid, side="right") / len(logs), atol=1.01 / len(logs) * (k == 1))
        assert own[-1]["ecdf"] == 1.0
    raw = densities.density(frame(spark, records[0]), points=50, log=False).orderBy("i").collect()
    grid = np.linspace(records[0].min(), records[0].max(), 50)
    assert np.allclose([x["density"] for x in raw], direct(records[0], grid), rtol=2e-5, atol=1e-9)


def test_summary_and_comparison(spark):
    r = np.random.default_rng(1)
    q = np.exp(r.normal(4, 0.5, 400))
    s = frame(spark, q)
    row = one(densities.density_summary(s))
    logs = np.log(q)
    grid = np.linspace(logs.min(), logs.max(), 400)
    assert abs(row["mode_log"] - grid[direct(logs, grid).argmax()]) < 0.02 and row["n"] == 400 and math.isclose(row["mode"], math.exp(row["mode_log"]))
    table = densities.density_comparison(s).orderBy("i").collect()
    x = np.array([t["q"] for t in table])
    width = x[1] - x[0]
    for column, share in (("kernel", 0.9), ("log_pearson3", 0.97)):
        assert share < sum(t[column] for t in table) * width < 1.03
    assert max(t["log_pearson3"] for t in table) > max(t["normal"] for t in table)  # the normal law is too wide for these
