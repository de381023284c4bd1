"""All candidate families through one path: maximum likelihood, goodness, gates, rank, curves and moment loci.

The searches run in grouped Arrow calls, one series a call; gates, rank and weights are Column expressions over the
table of fits. Exponential and log-normal fits are closed, the others are searched by a simplex from moment starts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels
from .kernels import pearson3_factor, simplex, stream
from .series import PERIODS



def _elementwise(f: Callable, *values) -> np.ndarray:
    """f of every element. Functions of a module are pickled by name; a NumPy object that caches what it compiled is not."""
    at = np.broadcast_arrays(*values)
    return np.fromiter((f(*map(float, v)) for v in zip(*(a.flat for a in at), strict=True)), float, at[0].size).reshape(at[0].shape)


def _half_erfc(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def reg_gamma(a, x) -> np.ndarray:
    return _elementwise(kernels.reg_gamma, a, x)


def _phi(z) -> np.ndarray:
    return _elementwise(_half_erfc, z)


@dataclass(frozen=True)
class Family:
    """k parameters of x (of ln q if logs); scale and shape are places in them, -1 for none."""

    k: int
    logs: bool
    start: Callable | None
    nll: Callable
    cdf: Callable
    ppf: Callable
    scale: int
    shape: int = -1


def _nll_exponential(p, x):
    return math.inf if p[0] <= 0 else float(len(x) * math.log(p[0]) + x.sum() / p[0])


def _nll_normal(p, y):
    return math.inf if p[1] <= 0 else float(len(y) * math.log(p[1] * math.sqrt(2 * math.pi)) + 0.5 * (((y - p[0]) / p[1]) ** 2).sum())


def _cdf_gev(x, p):
    if abs(p[2]) < 1e-9:
        return np.exp(-np.exp(-(x - p[0]) / p[1]))
    y = np.maximum(1 - p[2] * (x - p[0]) / p[1], 0.0)
    return np.where(y > 0, np.exp(-np.where(y > 0, y, 1.0) ** (1 / p[2])), 1.0 if p[2] > 0 else 0.0)


def _cdf_pearson3(y, p):
    m, s, g = p
    if abs(g) < 1e-6:
        return _phi((y - m) / s)
    u = reg_gamma(4 / g**2, np.sign(g) * (y - (m - 2 * s / g)) / (s * abs(g) / 2))
    return u if g > 0 else 1 - u


def _cdf_gnormal(x, p):
    return 0.5 + 0.5 * np.sign(x - p[0]) * reg_gamma(1 / p[2], (np.abs(x - p[0]) / p[1]) ** p[2])


def _by(name: str) -> Callable:
    return lambda u, p: kernels.family_quantile(name, list(p), u)


def _spread(x: np.ndarray) -> float:
    return float(x.std())


CANDIDATES: dict[str, Family] = {
    "gumbel": Family(2, False, lambda x: [x.mean() - 0.45 * _spread(x), 0.78 * _spread(x)], kernels._nll_gumbel, lambda x, p: np.exp(-np.exp(-(x - p[0]) / p[1])), _by("gumbel"), 1),
    "ln2": Family(2, True, None, _nll_normal, lambda y, p: _phi((y - p[0]) / p[1]), lambda u, p: math.exp(p[0] + p[1] * pearson3_factor(u, 0.0)), 1),
    "lp3": Family(3, True, lambda y: [y.mean(), y.std(ddof=1), 0.1], kernels._nll_pearson3, _cdf_pearson3, _by("lp3"), 1, 2),
    "gev": Family(3, False, lambda x: [x.mean() - 0.45 * _spread(x), 0.78 * _spread(x), 0.01], kernels._nll_gev, _cdf_gev, _by("gev"), 1, 2),
    "weibull": Family(2, False, lambda x: [x.mean() * 1.1, 1.8], kernels._nll_weibull, lambda x, p: 1 - np.exp(-((x / p[0]) ** p[1])), _by("weibull"), 0),
    "exponential": Family(1, False, None, _nll_exponential, lambda x, p: 1 - np.exp(-x / p[0]), lambda u, p: -p[0] * math.log(1 - u), 0),
    "gnormal": Family(3, False, lambda x: [x.mean(), 1.4 * _spread(x), 2.0], kernels._nll_gnormal, _cdf_gnormal, _by("gnormal"), 1),
    "glogistic": Family(3, False, lambda x: [x.mean() - 0.5 * _spread(x), 0.6 * _spread(x), 2.0], kernels._nll_glogistic, lambda x, p: (1 + np.exp(-(x - p[0]) / p[1])) ** -p[2], _by("glogistic"), 1, 2),
    "loglogistic": Family(2, False, lambda x: [np.median(x), 3.0], kernels._nll_loglogistic, lambda x, p: 1 / (1 + (x / p[0]) ** -p[1]), _by("loglogistic"), 0),
}


def fitted(family: Family, x: np.ndarray) -> list[float]:
    if family.start is None:
        return [float(x.mean())] if family.k == 1 else [float(x.mean()), float(x.std())]
    best = np.array(family.start(x))
    for _ in range(2):
        best, _value = simplex(lambda p: family.nll(p, x), best)
    return [*map(float, best)]


def ks_tail(d: float, n: int) -> float:
    """P(D_n >= d) of the one-sample Kolmogorov-Smirnov statistic: Marsaglia, Tsang and Wang's matrix, or its limit."""
    s = d * d * n
    if n > 200 or s > 7.24:
        t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
        return float(min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * (j * t) ** 2) for j in range(1, 101)))))
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    a = np.tril(np.ones((m, m)), 1)
    a[:, 0] -= h ** np.arange(1, m + 1)
    a[-1, :] -= h ** np.arange(m, 0, -1)
    a[-1, 0] += max(2 * h - 1, 0) ** m
    i, j = np.indices((m, m))
    fact = np.array([math.factorial(v) for v in range(m + 1)], float)
    a = np.where(i - j + 1 > 0, a / fact[np.clip(i - j + 1, 0, m)], a)
    power, scale = np.eye(m), 0.0
    for _ in range(n):
        power = power @ a
        if power[k - 1, k - 1] > 1e140:
            power, scale = power * 1e-140, scale + 140
    value = power[k - 1, k - 1]
    logs = math.log(max(value, 1e-300)) + scale * math.log(10) + sum(math.log(v / n) for v in range(1, n + 1))
    return float(min(1.0, max(0.0, 1 - math.exp(min(logs, 0.0)))))


def anderson(u: np.ndarray) -> np.ndarray:
    """A^2 of uniform values, sorted along the last axis."""
    u = np.clip(u, 1e-12, 1 - 1e-12)
    n = u.shape[-1]
    return -n - ((2 * np.arange(1, n + 1) - 1) * (np.log(u) + np.log(1 - u[..., ::-1]))).sum(axis=-1) / n


FITS = (
    "series_id string, family string, n long, k int, fitted_on string, p1 double, p2 double, p3 double, scale double, shape double, loglik double, aic double, bic double, aicc double, hqic double, "
    "ks double, ks_p double, a2 double, a2_p double, cdf_min double, cdf_max double, q_max double, qq_r2 double, quantiles array<double>"
)
_COLUMNS = [c.split()[0] for c in FITS.split(", ")]


def fit_all(series: DataFrame, reps: int = 2000) -> DataFrame:
    """Every family on every series, likelihoods on the scale of q; quantiles at PERIODS.

    a2_p compares with `reps` uniform samples of the same length. Series of fewer than 8 values, without spread or with values
    that are not positive give rows of nulls.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.sort(pdf["q"].dropna().to_numpy(float))
        n, rows = len(q), []
        usable = n >= 8 and q.std() > 0 and (q > 0).all()
        drawn = np.sort(anderson(np.sort(stream(f"uniform:{n}").random((reps, n)), axis=1))) if usable else None
        for name, f in CANDIDATES.items():
            row = dict.fromkeys(_COLUMNS) | {"series_id": key[0], "family": name, "n": n, "k": f.k, "fitted_on": "ln q" if f.logs else "q"}
            if usable:
                x = np.log(q) if f.logs else q
                with np.errstate(all="ignore"):
                    p = fitted(f, x)
                    loglik = -f.nll(p, x) - (np.log(q).sum() if f.logs else 0.0)
                    u = np.clip(f.cdf(x, p), 1e-12, 1 - 1e-12)
                    i = np.arange(1, n + 1)
                    d, a2 = float(max((i / n - u).max(), (u - (i - 1) / n).max())), float(anderson(u))
                    try:
                        levels = [float(f.ppf(1 - 1 / t, p)) for t in PERIODS]
                        line = np.array([f.ppf(v, p) for v in i / (n + 1)])
                        r2 = float(1 - ((q - line) ** 2).sum() / ((q - q.mean()) ** 2).sum())
                    except (ValueError, OverflowError, ZeroDivisionError):
                        levels, r2 = [math.nan] * len(PERIODS), math.nan
                aic = 2 * f.k - 2 * loglik
                row |= dict(zip(("p1", "p2", "p3"), p, strict=False)) | {"scale": p[f.scale], "shape": p[f.shape] if f.shape >= 0 else None, "loglik": loglik, "aic": aic, "bic": f.k * math.log(n) - 2 * loglik}
                row |= {"aicc": aic + 2 * f.k * (f.k + 1) / (n - f.k - 1), "hqic": 2 * f.k * math.log(math.log(n)) - 2 * loglik, "ks": d, "ks_p": ks_tail(d, n), "a2": a2}
                row |= {"a2_p": float((reps - np.searchsorted(drawn, a2) + 1) / (reps + 1)), "cdf_min": float(u[0]), "cdf_max": float(u[-1]), "q_max": float(q[-1]), "qq_r2": r2, "quantiles": levels}
            rows.append(row)
        return pd.DataFrame(rows, columns=_COLUMNS)

    return series.select("series_id", "q").groupBy("series_id").applyInPandas(run, FITS)


def gates(fits: DataFrame, factor: float = 0.5, max_shape: float = 2.0, alpha: float = 0.05) -> DataFrame:
    """Adds reject_reasons and accepted: parameters, likelihood, scale, shape, cover of both ends, Q1000, increase, A^2, KS."""
    bad = lambda c: F.coalesce(F.isnan(c), F.lit(True))
    last, guard = F.get("quantiles", F.lit(len(PERIODS) - 1)), 1 / (2 * F.col("n"))
    finite = F.coalesce(F.forall("quantiles", lambda v: ~F.isnan(v) & (F.abs(v) < 1e300)), F.lit(False))
    rising = F.forall(F.sequence(F.lit(1), F.lit(len(PERIODS) - 1)), lambda i: F.get("quantiles", i) > F.get("quantiles", i - 1))
    rules: list[tuple[str, Column]] = [
        ("parameters", bad(F.col("p1")) | F.coalesce(F.isnan("p2") | F.isnan("p3"), F.lit(False))),
        ("likelihood", bad(F.col("loglik")) | F.coalesce(F.abs("loglik") > 1e300, F.lit(True))),
        ("scale", F.coalesce(F.col("scale") <= 0, F.lit(True))),
        ("shape", F.coalesce(F.abs("shape") > max_shape, F.lit(False))),
        ("lower end not covered", F.coalesce(F.col("cdf_min") < guard, F.lit(False))),
        ("upper end not covered", F.coalesce(F.col("cdf_max") > 1 - guard, F.lit(False))),
        ("q1000 below the record", F.coalesce(last < factor * F.col("q_max"), F.lit(False))),
        ("quantiles not finite", ~finite),
        ("quantiles not increasing", finite & ~rising),
        ("anderson-darling", bad(F.col("a2"))),
        ("ks", F.coalesce(F.col("ks_p") < alpha, F.lit(False))),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))
    return fits.withColumn("reject_reasons", reasons).withColumn("accepted", F.size("reject_reasons") == 0)


def ranked(fits: DataFrame) -> DataFrame:
    """Gated fits with rank by AICc and Akaike weight among the accepted, the best marked; accepted ones first in place."""
    w = W.partitionBy("series_id", "accepted")
    order = W.partitionBy("series_id").orderBy(F.desc("accepted"), F.col("aicc").asc_nulls_last(), "family")
    e = F.exp(-(F.col("aicc") - F.min("aicc").over(w)) / 2)
    rank = F.when(F.col("accepted"), F.rank().over(w.orderBy(F.round("aicc", 9))))
    df = fits.withColumns({"rank": rank, "weight": F.when(F.col("accepted"), e / F.sum(e).over(w)), "place": F.row_number().over(order)})
    return df.withColumn("is_best", F.col("accepted") & (F.col("place") == 1))


def ranking(series: DataFrame) -> DataFrame:
    """All nine families fitted, gated and ranked."""
    return ranked(gates(fit_all(series)))


def best(fits: DataFrame) -> DataFrame:
    """The accepted family of least AICc of each series."""
    return fits.filter("is_best").select("series_id", "family", "aicc", "weight")


def residuals(series: DataFrame, fits: DataFrame) -> DataFrame:
    """Each value's normal score under each fit: the normal quantile of its distribution function."""
    both = series.select("series_id", "t", "q").join(fits.select("series_id", "family", "p1", "p2", "p3").filter("p1 is not null"), "series_id")

    def run(batches):
        for pdf in batches:
            z = np.full(len(pdf), np.nan)
            for (_, name), at in pdf.groupby(["series_id", "family"]).indices.items():
                f, one = CANDIDATES[name], pdf.iloc[at[0]]
                x = pdf["q"].to_numpy()[at]
                u = np.clip(f.cdf(np.log(x) if f.logs else x, [one["p1"], one["p2"], one["p3"]][: f.k]), 1e-12, 1 - 1e-12)
                z[at] = [pearson3_factor(float(v), 0.0) for v in u]
            yield pdf[["series_id", "family", "t"]].assign(z=z)

    return both.mapInPandas(run, "series_id string, family string, t int, z double")


def curves(fits: DataFrame, points: int = 400, low: float = 1.01, high: float = 1000.0, top: float = 20.0) -> DataFrame:
    """Return-level curves on a log grid of periods, held within 0 and `top` times the record's greatest value; a row each for
    accepted and other fits."""
    periods = np.geomspace(low, high, points)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                f = CANDIDATES[r.family]
                q = [f.ppf(1 - 1 / t, [r.p1, r.p2, r.p3][: f.k]) for t in periods]
                yield pd.DataFrame({"series_id": r.series_id, "family": r.family, "accepted": r.accepted, "period": periods, "q": np.clip(q, 0, top * r.q_max)})

    own = fits.filter("p1 is not null and not exists(quantiles, v -> isnan(v))").select("series_id", "family", "accepted", "p1", "p2", "p3", "q_max")
    return own.mapInPandas(run, "series_id string, family string, accepted boolean, period double, q double")


def quantile_matrix(fits: DataFrame) -> DataFrame:
    """A row a series and period with a column for each family."""
    names = F.array(*[F.lit(float(t)) for t in PERIODS])
    long = fits.select("series_id", "family", F.explode(F.arrays_zip(names.alias("period"), F.col("quantiles").alias("q"))).alias("x")).select("series_id", "family", "x.period", "x.q")
    return long.groupBy("series_id", "period").pivot("family", list(CANDIDATES)).agg(F.first("q"))


def moments_difference(fits: DataFrame, by_moments: DataFrame) -> DataFrame:
    """The greatest difference in percent of the likelihood fit's log-Pearson values from those by moments (period, q)."""
    ml = quantile_matrix(fits).select("series_id", "period", F.col("lp3").alias("_ml"))
    gap = 100 * F.abs(F.col("_ml") - F.col("q")) / F.col("q")
    return ml.join(by_moments.select("series_id", "period", "q"), ["series_id", "period"]).groupBy("series_id").agg(F.max(gap).alias("max_percent"))


# --- Moments of whole laws and their place on the plane of skewness and kurtosis.


@lru_cache(4)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss and Legendre's nodes and weights: an eigenvalue problem, solved once."""
    return np.polynomial.legendre.leggauss(n)


def population_moments(ppf: Callable[[np.ndarray], np.ndarray], p_low: float = 1e-11, nodes: int = 400) -> dict[str, float]:
    """Mean, sd, skewness and kurtosis of a law by quadrature: the mean of f(Q(Phi(z))) over the normal law, tails below p_low cut."""
    at, weight = _nodes(nodes)
    edge = -pearson3_factor(p_low, 0.0)
    z, w = at * edge, weight * edge * np.exp(-0.5 * (at * edge) ** 2) / math.sqrt(2 * math.pi)
    x = np.asarray(ppf(_phi(z), _phi(-z)), float)
    mean = float(w @ x)
    sd = math.sqrt(float(w @ (x - mean) ** 2))
    return {"mean": mean, "sd": sd, "cs": float(w @ ((x - mean) / sd) ** 3), "ck": float(w @ ((x - mean) / sd) ** 4)}


def _raw(m: list[float]) -> tuple[float, float]:
    """Skewness and kurtosis from the first four raw moments."""
    a, b, c, d = m
    v = b - a * a
    return (c - 3 * a * b + 2 * a**3) / v**1.5, (d - 4 * a * c + 6 * a * a * b - 3 * a**4) / v**2


def _log_pearson_moments(g: float) -> tuple[float, float]:
    """Of exp(Y), Y standard Pearson III with skew g, by its moment generating function; not finite where that has no value."""
    a, b = 4 / g**2, g / 2
    if 1 - 4 * b <= 0:
        return math.nan, math.nan
    return _raw([math.exp(-2 * r / g - a * math.log(1 - r * b)) for r in range(1, 5)])


def locus_points() -> list[tuple[str, float | None, float, float]]:
    """(family, shape, cs, ck): points for laws without a shape, curves for the others."""
    out: list[tuple[str, float | None, float, float]] = []
    laws = {
        "normal": lambda p, s: np.array([pearson3_factor(min(max(v, 1e-12), 1 - 1e-12), 0.0) for v in p]),
        "exponential": lambda p, s: -np.log(s),
        "lognormal": lambda p, s: np.exp([pearson3_factor(min(max(v, 1e-12), 1 - 1e-12), 0.0) for v in p]),
        "gumbel": lambda p, s: -np.log(np.where(p < 0.5, -np.log(p), -np.log1p(-s))),
    }
    for name, ppf in laws.items():
        m = population_moments(ppf)
        out.append((name, None, m["cs"], m["ck"]))
    for k in np.round(np.arange(-0.45, 0.451, 0.05), 3):
        if abs(k) < 1e-9:
            out.append(("gev", 0.0, *out[3][2:]))
            continue
        y = lambda p, s: np.where(p < 0.5, -np.log(p), -np.log1p(-s))
        m = population_moments(lambda p, s, k=k: (1 - y(p, s) ** k) / k)
        # The law has a third moment for k > -1/3 and a fourth for k > -1/4 only.
        out.append(("gev", float(k), m["cs"] if k > -1 / 3 else math.nan, m["ck"] if k > -1 / 4 else math.nan))
    for g in np.round(np.arange(-4.0, 4.001, 0.25), 3):
        if abs(g) > 1e-9:
            out.append(("pearson3", float(g), float(g), 3 + 1.5 * float(g) ** 2))
            out.append(("log_pearson3", float(g), *_log_pearson_moments(float(g))))
    return out


def loci(spark: SparkSession) -> DataFrame:
    """The moment loci of all laws, a constant table of under a hundred rows."""
    rows = [(f, s, *(None if not math.isfinite(v) else v for v in (cs, ck))) for f, s, cs, ck in locus_points()]
    return spark.createDataFrame(rows, "family string, shape double, cs double, ck double")


def nearest_locus(moments: DataFrame, places: DataFrame) -> DataFrame:
    """moments: series_id, cs, ck. The nearest node of each law and its distance on the plane."""
    at = places.filter("cs is not null and ck is not null").select("family", "shape", F.col("cs").alias("_x"), F.col("ck").alias("_y"))
    both = moments.select("series_id", "cs", "ck").dropna().join(F.broadcast(at), F.lit(True))  # a constant table
    d = F.sqrt((F.col("_x") - F.col("cs")) ** 2 + (F.col("_y") - F.col("ck")) ** 2)
    b = both.groupBy("series_id", "family").agg(F.min(F.struct(F.round(d, 12).alias("distance"), F.col("shape"), F.col("_x").alias("cs"), F.col("_y").alias("ck"))).alias("b"), F.count(F.lit(1)).alias("nodes"))
    return b.select("series_id", "family", "b.distance", "b.shape", "b.cs", "b.ck", "nodes")
