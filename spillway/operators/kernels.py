"""Iterative kernels in grouped Arrow calls: searches and chains that no aggregate expresses.

One call holds one series, a few thousand values at most; the number of series sets the parallelism. Random numbers
come from a generator seeded by the series and the stage, so results do not depend on where a group runs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import PERIODS

#: Gamma shapes from which the uniform expansion is exact enough, and skews below which a series stands for the factor.
LARGE = 10_000.0
SMALL_SKEW = 0.02


def stream(name: str) -> np.random.Generator:
    return np.random.default_rng(int(hashlib.sha256(f"spillway:{name}".encode()).hexdigest()[:8], 16))


def simplex(f, start: np.ndarray, steps: int = 600) -> tuple[np.ndarray, float]:
    """Nelder and Mead's downhill simplex; infeasible points return infinity."""
    n = len(start)
    points = np.vstack([start, start + np.diag(np.where(start != 0, 0.1 * np.abs(start), 0.05))])
    values = np.array([f(p) for p in points])
    for _ in range(steps):
        order = values.argsort()
        points, values = points[order], values[order]
        if abs(values[-1] - values[0]) < 1e-10 * (1 + abs(values[0])) and np.isfinite(values).all():
            break
        centre = points[:-1].mean(axis=0)
        tried = {s: centre + s * (centre - points[-1]) for s in (1.0, 2.0, 0.5, -0.5)}
        reflected = f(tried[1.0])
        if reflected < values[0]:
            extended = f(tried[2.0])
            points[-1], values[-1] = (tried[2.0], extended) if extended < reflected else (tried[1.0], reflected)
        elif reflected < values[-2]:
            points[-1], values[-1] = tried[1.0], reflected
        else:
            s = 0.5 if reflected < values[-1] else -0.5
            inner = f(tried[s])
            if inner < min(reflected, values[-1]):
                points[-1], values[-1] = tried[s], inner
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    k = int(values.argmin())
    return points[k], float(values[k])


def _nll_gumbel(p, x):
    mu, b = p
    if b <= 0:
        return math.inf
    z = (x - mu) / b
    return float(len(x) * math.log(b) + z.sum() + np.exp(-z).sum())


def _nll_gev(p, x):
    mu, b, k = p
    if b <= 0:
        return math.inf
    if abs(k) < 1e-9:
        return _nll_gumbel((mu, b), x)
    y = 1 - k * (x - mu) / b
    if (y <= 0).any():
        return math.inf
    return float(len(x) * math.log(b) + (1 - 1 / k) * np.log(y).sum() * 1.0 + (y ** (1 / k)).sum()) if k else math.inf


def _nll_weibull(p, x):
    b, c = p
    if b <= 0 or c <= 0:
        return math.inf
    z = x / b
    return float(-len(x) * math.log(c / b) - (c - 1) * np.log(z).sum() + (z**c).sum())


def _nll_loglogistic(p, x):
    b, c = p
    if b <= 0 or c <= 0:
        return math.inf
    z = np.log(x / b)
    return float(-(len(x) * math.log(c) - np.log(x).sum() + (c * z).sum() - 2 * np.logaddexp(0, c * z).sum()))


def _nll_pearson3(p, y):
    """Pearson III with mean, sd and skew p."""
    m, s, g = p
    if s <= 0 or abs(g) > 6:
        return math.inf
    if abs(g) < 1e-6:
        return float(len(y) * math.log(s * math.sqrt(2 * math.pi)) + 0.5 * (((y - m) / s) ** 2).sum())
    a, b = 4 / g**2, s * abs(g) / 2
    z = math.copysign(1, g) * (y - (m - 2 * s / g)) / b
    if (z <= 0).any():
        return math.inf
    return float(len(y) * (math.lgamma(a) + math.log(b)) - (a - 1) * np.log(z).sum() + z.sum())


def _nll_glogistic(p, x):
    """Type-I generalised logistic: location, scale, shape."""
    m, b, c = p
    if b <= 0 or c <= 0:
        return math.inf
    z = (x - m) / b
    return float(-(len(x) * math.log(c / b) - z.sum() - (c + 1) * np.logaddexp(0, -z).sum()))


def _nll_gnormal(p, x):
    """Exponential power: location, scale, shape."""
    m, a, b = p
    if a <= 0 or b <= 0.1 or b > 20:
        return math.inf
    return float(len(x) * (math.log(2 * a / b) + math.lgamma(1 / b)) + (np.abs((x - m) / a) ** b).sum())


def reg_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: series or continued fraction, beyond LARGE its uniform expansion."""
    if x <= 0:
        return 0.0
    if a > LARGE:
        mu = x / a - 1
        eta = math.copysign(math.sqrt(max(2 * (mu - math.log1p(mu)), 0.0)), mu)
        first = 1 / mu - 1 / eta if abs(eta) > 1e-4 else -1 / 3 + eta / 12
        return 0.5 * math.erfc(-eta * math.sqrt(a / 2)) - math.exp(-a * eta * eta / 2) / math.sqrt(2 * math.pi * a) * first
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(20 * int(math.sqrt(LARGE)) + 200):  # terms fall off within a few square roots of a
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def pearson3_factor(p: float, g: float) -> float:
    """The standardised Pearson-III quantile at non-exceedance p, exactly: Newton steps from Wilson and Hilferty's."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    if abs(g) < SMALL_SKEW:  # a series in the skew, exact to the fourth power
        k = g / 6
        return z + (z * z - 1) * k + (z**3 - 6 * z) * k * k / 3 - (z * z - 1) * k**3 + z * k**4
    a = 4 / g**2
    goal = p if g > 0 else 1 - p
    zg = NormalDist().inv_cdf(goal)
    x = max(a * (1 - 1 / (9 * a) + zg / (3 * math.sqrt(a))) ** 3, 1e-8)
    for _ in range(60):
        slope = math.exp((a - 1) * math.log(x) - x - math.lgamma(a))
        step = (reg_gamma(a, x) - goal) / max(slope, 1e-300)
        new = x - step
        x = new if new > 0 else x / 2
        if abs(step) < 1e-13 * (1 + x):
            break
    return math.copysign(1, g) * (x - a) / math.sqrt(a)


def family_quantile(family: str, p: list[float], at: float) -> float:
    if family == "gumbel":
        return p[0] - p[1] * math.log(-math.log(at))
    if family == "gev":
        return p[0] - p[1] * math.log(-math.log(at)) if abs(p[2]) < 1e-9 else p[0] + p[1] / p[2] * (1 - (-math.log(at)) ** p[2])
    if family == "weibull":
        return p[0] * (-math.log(1 - at)) ** (1 / p[1])
    if family == "loglogistic":
        return p[0] * (at / (1 - at)) ** (1 / p[1])
    if family == "lp3":
        return math.exp(p[0] + p[1] * pearson3_factor(at, p[2]))
    if family == "glogistic":
        return p[0] - p[1] * math.log(at ** (-1 / p[2]) - 1)
    a, side = 1 / p[2], math.copysign(1, at - 0.5)
    lo, hi, goal = 0.0, 400.0, abs(2 * at - 1)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if reg_gamma(a, mid) < goal else (lo, mid)
    return p[0] + side * p[1] * lo**a


def exact_factors(skews: DataFrame) -> DataFrame:
    """skews: series_id, skew. Exact Pearson-III factors of every return period, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(s, float(t), pearson3_factor(1 - 1 / t, g)) for s, g in zip(pdf["series_id"], pdf["skew"], strict=True) for t in PERIODS], columns=["series_id", "period", "factor"])

    return skews.select("series_id", "skew").dropna().mapInPandas(run, "series_id string, period double, factor double")


#: Shapes that the search of the generalised Pareto law goes through.
SHAPES = (-0.95, 0.95)


def gpd_nll(xi: float, beta: float, y: np.ndarray) -> float:
    """Negative log-likelihood of excesses; the exponential limit at a shape of zero, infinite outside the support."""
    if beta <= 0:
        return math.inf
    if abs(xi) < 1e-9:
        return float(len(y) * math.log(beta) + y.sum() / beta)
    w = 1 + xi * y / beta
    return math.inf if (w <= 0).any() else float(len(y) * math.log(beta) + (1 + 1 / xi) * np.log(w).sum())


def golden(f, low: float, high: float, tol: float = 1e-9) -> float:
    """The minimum of f by golden sections."""
    r = (math.sqrt(5) - 1) / 2
    a, b = high - r * (high - low), low + r * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tol * (1 + abs(low) + abs(high)):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - r * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + r * (high - low)
            fb = f(b)
    return (low + high) / 2


def profile_scale(xi: float, y: np.ndarray) -> float:
    """The scale of greatest likelihood for a shape: log beta is searched over the support."""
    least = math.log(max(-xi * y.max() * (1 + 1e-9), y.mean() * 1e-3))
    return math.exp(golden(lambda b: gpd_nll(xi, math.exp(b), y), least, math.log(y.mean() * 50)))


def fit_gpd(y: np.ndarray) -> tuple[float, float, float]:
    """Shape, scale and negative log-likelihood at the maximum: a coarse profile of the shape, then golden sections around it."""
    grid = np.linspace(*SHAPES, 39)
    values = [gpd_nll(x, profile_scale(x, y), y) for x in grid]
    k = int(np.argmin(values))
    xi = golden(lambda x: gpd_nll(x, profile_scale(x, y), y), grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)], 1e-7)
    beta = profile_scale(xi, y)
    return xi, beta, gpd_nll(xi, beta, y)


def gpd_profile(over: DataFrame, grid: int = 401) -> DataFrame:
    """Generalised Pareto by maximum likelihood over shapes within SHAPES, and the 95 % interval of the profile of the shape."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].to_numpy()
        cols = ["series_id", "n", "xi", "beta", "neg_loglik", "xi_low", "xi_high", "at_bound"]
        if len(y) < 5 or y.max() <= 0:
            return pd.DataFrame([(key[0], len(y), *[None] * 6)], columns=cols)
        xi, beta, value = fit_gpd(y)
        shapes = np.linspace(*SHAPES, grid)
        near = [x for x in shapes if gpd_nll(x, profile_scale(x, y), y) <= value + 3.841458820694124 / 2]
        edge = min(xi - SHAPES[0], SHAPES[1] - xi) < 1e-3
        return pd.DataFrame([(key[0], len(y), xi, beta, value, min([*near, xi]), max([*near, xi]), edge)], columns=cols)

    return over.select("series_id", "y").groupBy("series_id").applyInPandas(fit, "series_id string, n long, xi double, beta double, neg_loglik double, xi_low double, xi_high double, at_bound boolean")


def mcmc(series: DataFrame, chains: int = 4, draws: int = 30_000, burn: int = 10_000, prior_sd: float = 2.0, pilot: int = 5_000) -> DataFrame:
    """Random-walk Metropolis for the log-Pearson parameters, one group a series and chain: chain, draw, parameter, value.

    A pilot run, the same for all chains of a series, gives the covariance of the proposals; draws are counted after burn.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sid, chain = key
        y = np.log(pdf["q"].to_numpy())
        rng = stream(f"mcmc:{sid}:{chain}")
        m, s, g = y.mean(), y.std(ddof=1), 0.0
        at0 = np.array([m, math.log(s), g])
        width = np.array([prior_sd * s, prior_sd, prior_sd])

        def logp(p):
            v = _nll_pearson3((p[0], math.exp(p[1]), p[2]), y)
            return -v - 0.5 * (((p - at0) / width) ** 2).sum()

        step = np.array([s / math.sqrt(len(y)), 1 / math.sqrt(2 * len(y)), math.sqrt(6 / len(y))])

        def walk(p, n, root, rng):
            lp, path, taken = logp(p), np.empty((n, 3)), 0
            for i in range(n):
                new = p + root @ rng.standard_normal(3)
                ln = logp(new)
                if math.log(rng.random()) < ln - lp:
                    p, lp, taken = new, ln, taken + 1
                path[i] = p
            return path, taken

        tried, _ = walk(at0, pilot, np.diag(step), stream(f"mcmc:{sid}:pilot"))
        cov = np.cov(tried[pilot // 2 :].T) + 1e-12 * np.diag(step**2)
        root = np.linalg.cholesky(cov * 2.38**2 / 3)
        path, taken = walk(tried[-1] + np.linalg.cholesky(cov) @ rng.standard_normal(3), burn + draws, root, rng)
        kept = path[burn:].copy()
        kept[:, 1] = np.exp(kept[:, 1])
        names = ("mean_log", "sd_log", "skew_log")
        return pd.DataFrame({"series_id": sid, "chain": chain, "draw": np.tile(np.arange(draws), 3), "parameter": np.repeat(names, draws), "value": kept.T.ravel(), "acceptance": taken / (burn + draws)})

    grid = series.select("series_id", "q").withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    return grid.groupBy("series_id", "chain").applyInPandas(run, "series_id string, chain int, draw int, parameter string, value double, acceptance double")


def fractional_noise(series_ids: DataFrame, n: int, h: float) -> DataFrame:
    """Fractional Gaussian noise of Hurst exponent h for every series_id, by the Cholesky factor of its covariance."""
    k = np.arange(n)
    cov = 0.5 * (np.abs(k + 1.0) ** (2 * h) - 2 * np.abs(k * 1.0) ** (2 * h) + np.abs(k - 1.0) ** (2 * h))
    root = np.linalg.cholesky(cov[np.abs(k[:, None] - k[None, :])] + 1e-12 * np.eye(n))

    def run(batches):
        for pdf in batches:
            for sid in pdf["series_id"]:
                yield pd.DataFrame({"series_id": sid, "t": k + 1, "q": root @ stream(f"fgn:{sid}:{h}").standard_normal(n)})

    return series_ids.select("series_id").mapInPandas(run, "series_id string, t int, q double")


def adf(series: DataFrame, lags: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller t-value with a constant, and the 5 % critical value of the response surface."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["q"].to_numpy()
        d = np.diff(x)
        n = len(d) - lags
        if n < 8:
            return pd.DataFrame([(key[0], len(x), None, None, None)], columns=["series_id", "n", "stat", "critical", "stationary"])
        a = np.column_stack([np.ones(n), x[lags:-1], *[d[lags - j : -j] for j in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(a, d[lags:], rcond=None)
        e = d[lags:] - a @ beta
        cov = np.linalg.pinv(a.T @ a) * (e @ e) / (n - a.shape[1])
        t, c = float(beta[1] / math.sqrt(cov[1, 1])), -2.86154 - 2.8903 / n - 4.234 / n**2
        return pd.DataFrame([(key[0], len(x), t, c, t < c)], columns=["series_id", "n", "stat", "critical", "stationary"])

    return series.select("series_id", "t", "q").groupBy("series_id").applyInPandas(run, "series_id string, n long, stat double, critical double, stationary boolean")
