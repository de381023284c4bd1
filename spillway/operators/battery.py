"""The whole battery of hypothesis tests on each series, as one long table.

One grouped Arrow call holds one series: group, variable (q or ln q), test, statistic, p and whether it rejects at alpha.
Definitions are the published ones; p-values that need simulation draw from a generator named by the series' length, so
they do not depend on where a group runs.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import anderson, ks_tail
from .kernels import stream

_N = NormalDist()


def _cdf(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(_N.cdf, np.ravel(x)), float, np.size(x)).reshape(np.shape(x))


def chi2_tail(x: float, df: int) -> float:
    """The upper tail of chi-square, by the finite sums for even and odd df."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))
    total, term = 0.0, 1.0
    for i in range(1, (df - 1) // 2 + 1):
        term /= 2 * i - 1
        total += term * math.sqrt(x) ** (2 * i - 1)
    return 2 * _N.cdf(-math.sqrt(x)) + math.sqrt(2 / math.pi) * math.exp(-x / 2) * total


def t_tail2(t: float, df: int) -> float:
    """Student's two-sided tail: the incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 300):
            for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + e * d or 1e-300)
                c = 1 + e / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    if not 0 < x < 1:
        return 1.0 if t == 0 else 0.0
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """Shapiro and Wilk's W with Royston's (1995) weights and p-value, from 4 values on."""
    x, n = np.sort(x), len(x)
    if n < 4 or x[0] == x[-1]:
        return math.nan, math.nan
    m = np.array([_N.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = float(m @ m), 1 / math.sqrt(n)
    # Royston's polynomials, lowest power first.
    last = m[-1] / math.sqrt(ss) + sum(c * u**k for k, c in enumerate((0.221157, -0.147981, -2.071190, 4.434685, -2.706056), 1))
    a = m.copy()
    if n > 5:
        second = m[-2] / math.sqrt(ss) + sum(c * u**k for k, c in enumerate((0.042981, -0.293762, -1.752461, 5.682633, -3.582633), 1))
        a /= math.sqrt((ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a[-2], a[1] = second, -second
    else:
        a /= math.sqrt((ss - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[-1], a[0] = last, -last
    w = min(float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()), 1 - 1e-15)
    if n > 11:
        v = math.log(n)
        mu = -1.5861 - 0.31082 * v - 0.083751 * v**2 + 0.0038915 * v**3
        z = (math.log(1 - w) - mu) / math.exp(-0.4803 - 0.082676 * v + 0.0030302 * v**2)
    else:
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        g = -2.273 + 0.459 * n
        if math.log(1 - w) >= g:
            return w, 1e-6
        z = (-math.log(g - math.log(1 - w)) - mu) / math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    return w, _N.cdf(-z)


def k_squared(x: np.ndarray) -> tuple[float, float]:
    """D'Agostino and Pearson's K^2: the squared normal scores of skewness and kurtosis."""
    n, d = len(x), x - x.mean()
    m2 = float((d**2).mean())
    if n < 20 or m2 == 0:
        return math.nan, math.nan
    g, b = float((d**3).mean()) / m2**1.5, float((d**4).mean()) / m2**2
    y = g * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    v = (b - 3 * (n - 1) / (n + 1)) / math.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    base = (1 - 2 / a) / (1 + v * math.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))
    k = z1**2 + z2**2
    return k, math.exp(-k / 2)


def anderson_normal(x: np.ndarray, reps: int) -> tuple[float, float]:
    """A^2 against the fitted normal, p from `reps` normal samples of the same length fitted anew."""
    def stat(v: np.ndarray) -> np.ndarray:
        z = (v - v.mean(axis=-1, keepdims=True)) / v.std(axis=-1, ddof=1, keepdims=True)
        return anderson(_cdf(np.sort(z, axis=-1)))

    a = float(stat(x))
    sims = stat(stream(f"normal:{len(x)}").standard_normal((reps, len(x))))
    return a, float((np.sum(sims >= a) + 1) / (reps + 1))


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, y - x @ beta, np.linalg.pinv(x.T @ x)


# MacKinnon's polynomials for the p-value of the unit-root t (bounds, small and large), by trend terms.
_TAU = {
    "c": (2.74, -18.83, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "ct": (0.70, -16.18, -2.89, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
}
# Critical values of the stationarity statistic at 10, 5, 2.5 and 1 %.
_KPSS = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def adf(x: np.ndarray, trend: str) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller t, p and the number of lagged differences, chosen by AIC on a common sample."""
    d, n = np.diff(x), len(x)
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3))

    def design(k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(first, len(d))
        cols = [np.ones(len(rows)), *([rows + 1.0] if trend == "ct" else []), x[rows], *[d[rows - j] for j in range(1, k + 1)]]
        return d[rows], np.column_stack(cols)

    if n < 12 or x.std() == 0:
        return math.nan, math.nan, 0

    def aic(k: int) -> float:
        y, a = design(k, most)
        e = _ols(y, a)[1]
        return len(y) * math.log(max(float(e @ e), 1e-300) / len(y)) + 2 * a.shape[1]

    lags = min(range(most + 1), key=aic)
    y, a = design(lags, lags)
    beta, e, inv = _ols(y, a)
    at = 2 if trend == "ct" else 1
    s2 = float(e @ e) / max(1, len(y) - a.shape[1])
    t = float(beta[at] / math.sqrt(max(s2 * inv[at, at], 1e-300)))
    high, low, star, small, large = _TAU[trend]
    p = 1.0 if t > high else 0.0 if t < low else _N.cdf(sum(c * t**k for k, c in enumerate(small if t <= star else large)))
    return t, p, lags


def kpss(x: np.ndarray, trend: str) -> tuple[float, float, int]:
    """Stationarity about a level or trend: statistic, p interpolated within 1 and 10 %, and the automatic number of lags."""
    n = len(x)
    if n < 8 or x.std() == 0:
        return math.nan, math.nan, 0
    e = x - x.mean() if trend == "c" else _ols(x, np.column_stack([np.ones(n), np.arange(n)]))[1]
    s0, s1 = float(e @ e) / n, 0.0
    for k in range(1, int(n ** (2 / 9)) + 1):
        c = float(e[k:] @ e[:-k]) / (n / 2)
        s0, s1 = s0 + c, s1 + k * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0, n - 1)
    long_run = float(e @ e) + 2 * sum((1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum()) / n / long_run if long_run > 0 else math.nan
    return stat, float(np.interp(stat, _KPSS[trend], (0.10, 0.05, 0.025, 0.01))), lags


def _average_ranks(x: np.ndarray) -> np.ndarray:
    _, at, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[at]


def _ties(x: np.ndarray) -> np.ndarray:
    c = np.unique(x, return_counts=True)[1].astype(float)
    return c[c > 1]


def mann_kendall(x: np.ndarray) -> tuple[float, float, float, float]:
    """S, its variance, z with continuity correction and two-sided p."""
    n = len(x)
    s = float(sum(np.sign(x[i + 1 :] - x[i]).sum() for i in range(n - 1)))
    c = _ties(x)
    v = (n * (n - 1) * (2 * n + 5) - (c * (c - 1) * (2 * c + 5)).sum()) / 18
    z = (s - np.sign(s)) / math.sqrt(v) if v > 0 else math.nan
    return s, v, z, 2 * _N.cdf(-abs(z)) if v > 0 else math.nan


def sen_slope(x: np.ndarray) -> float:
    return float(np.median(np.concatenate([(x[i + 1 :] - x[i]) / np.arange(1, len(x) - i) for i in range(len(x) - 1)])))


def hamed_rao(x: np.ndarray, alpha: float) -> tuple[float, float]:
    """z and p of Mann-Kendall with the variance corrected by the significant autocorrelations of the detrended ranks."""
    n = len(x)
    s, v, _, _ = mann_kendall(x)
    r = _average_ranks(x - sen_slope(x) * np.arange(n))
    d, total = r - r.mean(), 0.0
    for k in range(1, min(10, max(n // 4, 1)) + 1):
        c = float(d[k:] @ d[:-k]) / float(d @ d) if float(d @ d) else 0.0
        if abs(c) > _N.inv_cdf(1 - alpha / 2) / math.sqrt(n):
            total += (n - k) * (n - k - 1) * (n - k - 2) * c
    v *= max(1 + 2 / (n * (n - 1) * (n - 2)) * total, 1e-9)
    z = (s - np.sign(s)) / math.sqrt(v) if v > 0 else math.nan
    return float(z), 2 * _N.cdf(-abs(z))


def pettitt(x: np.ndarray, reps: int) -> tuple[float, int, float]:
    """The greatest |U_k|, its k, and p from `reps` permutations."""
    n, r = len(x), _average_ranks(x)
    k = np.arange(1, n + 1)
    u = np.abs(2 * np.cumsum(r) - k * (n + 1))
    rng = stream(f"pettitt:{n}")
    drawn = np.abs(2 * np.cumsum(rng.permuted(np.tile(r, (reps, 1)), axis=1), axis=1) - k * (n + 1)).max(axis=1)
    return float(u.max()), int(u.argmax()) + 1, float((np.sum(drawn >= u.max() - 1e-9) + 1) / (reps + 1))


def _rows(x: np.ndarray, reps: int, permutations: int, alpha: float):
    n = len(x)
    logs = np.log(x) if (x > 0).all() else None
    for label, v in (("q", x), *((("ln q", logs),) if logs is not None else ())):
        if v.std() == 0:
            continue
        d = v - v.mean()
        m2 = float((d**2).mean())
        jb = n / 6 * ((float((d**3).mean()) / m2**1.5) ** 2 + (float((d**4).mean()) / m2**2 - 3) ** 2 / 4)
        yield "normality", label, "shapiro-wilk", *shapiro(v)
        yield "normality", label, "k-squared", *k_squared(v)
        yield "normality", label, "jarque-bera", jb, math.exp(-jb / 2)
        if label == "q":
            u, i = _cdf(np.sort((v - v.mean()) / v.std(ddof=1))), np.arange(1, n + 1)
            ks = float(max((i / n - u).max(), (u - (i - 1) / n).max()))
            yield "normality", label, "kolmogorov-smirnov", ks, ks_tail(ks, n)
            yield "normality", label, "anderson-darling", *anderson_normal(v, reps)
        for trend in ("c", "ct"):
            yield "stationarity", label, f"adf {trend}", *adf(v, trend)[:2]
            yield "stationarity", label, f"kpss {trend}", *kpss(v, trend)[:2]
    d, g = x - x.mean(), np.sign(x - np.median(x))
    g = g[g != 0]
    a, b = float((g > 0).sum()), float((g < 0).sum())
    runs, expected = int((np.diff(g) != 0).sum()) + 1, 2 * a * b / (a + b) + 1 if a + b else math.nan
    v = 2 * a * b * (2 * a * b - a - b) / ((a + b) ** 2 * (a + b - 1)) if a + b > 1 else 0.0
    z = (runs - expected) / math.sqrt(v) if v > 0 else math.nan
    yield "randomness", "q", "runs", z, 2 * _N.cdf(-abs(z)) if v > 0 else math.nan
    if float(d @ d):
        dw = float((np.diff(x) ** 2).sum() / (d @ d))
        yield "randomness", "q", "durbin-watson", dw, 2 * _N.cdf(-abs((dw - 2) / math.sqrt(4 / n)))
        box = 0.0
        for k in range(1, min(10, n - 1) + 1):
            box += (float(d[k:] @ d[:-k]) / float(d @ d)) ** 2 / (n - k)
            yield "randomness", "q", f"ljung-box {k}", n * (n + 2) * box, chi2_tail(n * (n + 2) * box, k)
    s, var, z, p = mann_kendall(x)
    yield "trend", "q", "mann-kendall", z, p
    yield "trend", "q", "hamed-rao", *hamed_rao(x, alpha)
    t = np.arange(n, dtype=float)
    rank, tt = _average_ranks(x), t + 1
    sx = float(((rank - rank.mean()) ** 2).sum())
    rho = float(((rank - rank.mean()) * (tt - tt.mean())).sum() / math.sqrt(sx * ((tt - tt.mean()) ** 2).sum())) if sx else math.nan
    yield "trend", "q", "spearman", rho, math.nan if math.isnan(rho) else 0.0 if abs(rho) >= 1 else t_tail2(rho * math.sqrt((n - 2) / (1 - rho**2)), n - 2)
    c, pairs = _ties(x), n * (n - 1) / 2
    free = pairs - (c * (c - 1) / 2).sum()
    yield "trend", "q", "kendall", s / math.sqrt(free * pairs) if free > 0 else math.nan, 2 * _N.cdf(-abs(s / math.sqrt(var))) if var > 0 else math.nan
    slope = sen_slope(x)
    yield "trend", "q", "sen slope", slope, p
    rest = x - slope * t
    yield "trend", "q", "mann-kendall detrended", *mann_kendall(rest)[2:]
    e = rest - rest.mean()
    r1 = float(e[1:] @ e[:-1]) / float(e @ e) * n / (n - 1) if float(e @ e) else 0.0
    yield "trend", "q", "trend-free prewhitened", *mann_kendall(rest[1:] - r1 * rest[:-1] + slope * t[1:])[2:]
    u, at, p = pettitt(x, permutations)
    yield "change", "q", f"pettitt at {at}", u, p


def tests(series: DataFrame, reps: int = 2000, permutations: int = 5000, alpha: float = 0.05) -> DataFrame:
    """series_id, family, variable, test, statistic, p, rejects. Series of fewer than 8 values have no rows."""
    cols = ["series_id", "family", "variable", "test", "statistic", "p", "rejects"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["q"].dropna().to_numpy(float)
        rows = []
        for family, variable, test, stat, p in _rows(x, reps, permutations, alpha) if len(x) >= 8 else ():
            ok = p is not None and not math.isnan(p)
            rows.append((key[0], family, variable, test, stat if not math.isnan(stat) else None, p if ok else None, bool(p < alpha) if ok else None))
        return pd.DataFrame(rows, columns=cols)

    return series.select("series_id", "t", "q").groupBy("series_id").applyInPandas(run, "series_id string, family string, variable string, test string, statistic double, p double, rejects boolean")


def warnings(skewness: DataFrame, moments: DataFrame, spread: float = 0.5, skew: float = 0.9) -> DataFrame:
    """What to be careful about: skewness estimators that differ by more than `spread`, and a skew beyond `skew`.

    skewness: series_id, estimator, value; moments: series_id, skew.
    """
    wide = skewness.groupBy("series_id").agg((F.max("value") - F.min("value")).alias("_spread"))
    df = wide.join(moments.select("series_id", F.col("skew").alias("_skew")), "series_id")
    found = F.array_compact(F.array(F.when(F.col("_spread") > spread, "skewness estimators disagree"), F.when(F.abs("_skew") > skew, "the skew is governed by few values")))
    return df.select("series_id", F.col("_spread").alias("spread"), F.col("_skew").alias("skew"), found.alias("warnings"))
