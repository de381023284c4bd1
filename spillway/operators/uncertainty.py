"""Intervals from several methods together, refitted Monte Carlo records, posterior design values and Hurst sampling spread."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, resampling
from .frequency import lp3, periods, wilson_hilferty
from .moments import log_moments
from .series import PERIODS


def refitted_records(series: DataFrame, reps: int = 500) -> DataFrame:
    """series_id, rep, period, q: log-Pearson values of simulated records of the same length, each fitted anew by moments."""
    sim = resampling.keyed(resampling.parametric_resamples(series, reps))
    fit = periods(log_moments(sim)).withColumn("p", 1 - 1 / F.col("period"))
    q = F.exp(F.col("mean_log") + wilson_hilferty("skew_log", "p") * F.col("sd_log"))
    return fit.select(resampling.unkeyed("series_id"), resampling.unkeyed("rep"), "period", q.alias("q"), "mean_log", "sd_log", "skew_log")


def monte_carlo(series: DataFrame, reps: int = 500, refit: bool = True) -> DataFrame:
    """Median, limits, bias and width of the design values of simulated records, and how often they lie above the observed.

    Without refit the values are the empirical percentiles of each record, which cannot exceed its own greatest value.
    """
    drawn = refitted_records(series, reps) if refit else resampling.quantile_replicates(resampling.parametric_resamples(series, reps))
    observed = lp3(series).select("series_id", "period", F.col("q").alias("observed"))
    at = (0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975)
    df = drawn.select("series_id", "period", "q").join(observed, ["series_id", "period"])
    g = df.groupBy("series_id", "period").agg(F.first("observed").alias("observed"), F.percentile("q", F.array(*[F.lit(p) for p in at])).alias("_p"), F.avg("q").alias("mean"), F.avg((F.col("q") > F.col("observed")).cast("double")).alias("p_above"), F.avg((F.col("q") < F.col("observed")).cast("double")).alias("p_below"))
    p = lambda k: F.col("_p")[k]
    return g.select("series_id", "period", "observed", p(3).alias("median"), p(0).alias("low"), p(6).alias("high"), (p(3) - F.col("observed")).alias("bias"), (p(3) / F.col("observed") - 1).alias("relative_bias"), ((p(6) - p(0)) / F.col("observed")).alias("relative_width"), "mean", p(1).alias("p05"), p(2).alias("p25"), p(4).alias("p75"), p(5).alias("p95"), "p_above", "p_below")


def parameter_spread(series: DataFrame, reps: int = 2000) -> DataFrame:
    """Mean, sd and limits of the log-Pearson parameters over refitted records."""
    one = refitted_records(series, reps).filter(F.col("period") == float(PERIODS[0])).select("series_id", "mean_log", "sd_log", "skew_log")
    long = one.unpivot("series_id", ["mean_log", "sd_log", "skew_log"], "parameter", "value")
    g = long.groupBy("series_id", "parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"))
    return g.select("series_id", "parameter", "mean", "sd", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def combined_intervals(series: DataFrame, reps: int = 2000) -> DataFrame:
    """Case resampling, parametric and bias-corrected limits beside one another, the widest of them as combined limits."""
    cases = resampling.quantile_replicates(resampling.case_resamples(series, reps))
    params = resampling.quantile_replicates(resampling.parametric_resamples(series, reps))
    points = lp3(series).select("series_id", "period", F.col("q").alias("point"))
    keys = ["series_id", "period"]

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))

    both = points.join(named(resampling.percentile_interval(cases), "cases"), keys).join(named(resampling.percentile_interval(params), "parametric"), keys)
    both = both.join(named(resampling.bias_corrected_interval(cases, points), "corrected"), keys)
    low, high = F.least("cases_low", "parametric_low", "corrected_low"), F.greatest("cases_high", "parametric_high", "corrected_high")
    return both.withColumns({"low": low, "high": high, "relative_width": (high - low) / F.col("point")})


def method_bias(replicates: DataFrame, points: DataFrame) -> DataFrame:
    """The median over periods of the replicates' median relative to the point."""
    m = replicates.groupBy("series_id", "period").agg(F.percentile("q", F.lit(0.5)).alias("m")).join(points, ["series_id", "period"])
    return m.groupBy("series_id").agg(F.percentile(F.col("m") / F.col("point") - 1, F.lit(0.5)).alias("bias"))


def posterior_design(chains: DataFrame, greatest: DataFrame, thin: int = 10) -> DataFrame:
    """Posterior mean, limits and P(above the record's greatest) of every design value, of chains that pass the gates only.

    chains: series_id, chain, draw, parameter, value, acceptance; greatest: series_id, max. Every thin-th draw is evaluated.
    """
    ok = resampling.posterior(chains).filter("accepted").select("series_id").distinct()
    wide = chains.filter(F.col("draw") % thin == 0).groupBy("series_id", "chain", "draw").pivot("parameter", ["mean_log", "sd_log", "skew_log"]).agg(F.first("value"))
    df = periods(wide.join(ok, "series_id", "left_semi").join(greatest, "series_id")).withColumn("p", 1 - 1 / F.col("period"))
    df = df.withColumn("q", F.exp(F.col("mean_log") + wilson_hilferty("skew_log", "p") * F.col("sd_log")))
    g = df.groupBy("series_id", "period").agg(F.count(F.lit(1)).alias("draws"), F.avg("q").alias("mean"), F.percentile("q", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_p"), F.avg((F.col("q") > F.col("max")).cast("double")).alias("p_above_record"))
    return g.select("series_id", "period", "draws", "mean", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("high"), "p_above_record")


def predictive(chains: DataFrame, at: tuple[float, ...] = (100.0, 1000.0), thin: int = 1) -> DataFrame:
    """The chains' design values as further parameters Q100 and Q1000: series_id, chain, draw, parameter, value."""
    wide = chains.filter(F.col("draw") % thin == 0).groupBy("series_id", "chain", "draw").pivot("parameter", ["mean_log", "sd_log", "skew_log"]).agg(F.first("value"))
    df = wide.withColumn("period", F.explode(F.array(*[F.lit(float(t)) for t in at]))).withColumn("p", 1 - 1 / F.col("period"))
    q = F.exp(F.col("mean_log") + wilson_hilferty("skew_log", "p") * F.col("sd_log"))
    return df.select("series_id", "chain", "draw", F.concat(F.lit("Q"), F.col("period").cast("int").cast("string")).alias("parameter"), q.alias("value"))


def binned(draws: DataFrame, bins: int = 45) -> DataFrame:
    """draws: series_id, parameter, value. Even bins with common edges for all chains: bin, left, right, count and density.

    Empty bins are kept; the counts of a parameter sum to its draws. A parameter without spread has one bin.
    """
    ends = draws.filter("value IS NOT NULL").groupBy("series_id", "parameter").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("draws"))
    ends = ends.withColumn("bins", F.when(F.col("hi") > F.col("lo"), bins).otherwise(1)).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    at = F.when(F.col("width") > 0, F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.col("bins") - 1)).otherwise(0).cast("int")
    keys = ["series_id", "parameter"]
    counts = draws.filter("value IS NOT NULL").join(ends, keys).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    out = every.join(counts, [*keys, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    left = F.col("lo") + F.col("bin") * F.col("width")
    return out.select(*keys, "bin", left.alias("left"), (left + F.col("width")).alias("right"), "count", F.when(F.col("width") > 0, F.col("count") / (F.col("draws") * F.col("width"))).alias("density"))


def prior_sensitivity(series: DataFrame, chains: DataFrame, prior_sd: float = 0.5, draws: int = 8000) -> DataFrame:
    """The posterior means under a narrower prior beside those of the chains, and their shift in posterior sds."""
    other = kernels.mcmc(series, draws=draws, burn=draws // 4, prior_sd=prior_sd)
    a = chains.groupBy("series_id", "parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    b = other.groupBy("series_id", "parameter").agg(F.avg("value").alias("mean_narrow"), F.stddev_samp("value").alias("sd_narrow"))
    return a.join(b, ["series_id", "parameter"]).withColumn("shift", F.when(F.col("sd") > 0, (F.col("mean_narrow") - F.col("mean")) / F.col("sd")))


def against_frequentist(chains: DataFrame, series: DataFrame) -> DataFrame:
    """Posterior sds over the analytic standard errors of the estimates by moments."""
    m = log_moments(series)
    n, s, g = F.col("n"), F.col("sd_log"), F.col("skew_log")
    rows = F.array(*[F.struct(F.lit(k).alias("parameter"), e.alias("estimate"), se.alias("se")) for k, e, se in (("mean_log", F.col("mean_log"), s / F.sqrt(n)), ("sd_log", s, s / F.sqrt(2 * n) * F.sqrt(1 + 0.75 * g * g)), ("skew_log", g, F.col("se_skew")))])
    p = chains.groupBy("series_id", "parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return p.join(m.select("series_id", F.inline(rows)), ["series_id", "parameter"]).withColumn("ratio", F.try_divide("sd", "se"))


def _slopes(x: np.ndarray, lags: np.ndarray, sizes: tuple[int, ...]) -> tuple[float, float]:
    """Hurst exponents of a series by the variogram of its cumulative deviations and by the rescaled range."""
    y = np.cumsum(x - x.mean())
    v = np.array([((y[k:] - y[:-k]) ** 2).mean() / 2 for k in lags])
    rs = []
    for m in sizes:
        b = x[: len(x) // m * m].reshape(-1, m)
        d = np.cumsum(b - b.mean(axis=1, keepdims=True), axis=1)
        s = b.std(axis=1)
        rs.append(((np.maximum(d.max(axis=1), 0) - np.minimum(d.min(axis=1), 0))[s > 0] / s[s > 0]).mean())
    fit = lambda a, c: float(np.polyfit(np.log(a), np.log(c), 1)[0])
    return fit(lags, v) / 2, fit(np.array(sizes, float), np.array(rs))


def _noise_root(n: int, h: float) -> np.ndarray:
    k = np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)
    cov = 0.5 * ((k + 1) ** (2 * h) - 2 * k ** (2 * h) + np.abs(k - 1) ** (2 * h))
    return np.linalg.cholesky(cov + 1e-12 * np.eye(n))


def hurst_spread(series: DataFrame, reps: int = 2000, level: float = 0.95) -> DataFrame:
    """Both exponents of each series and their spread over fractional noise of the variogram's exponent, or of 0.5 where that
    is not between 0 and 1; one call a series, its covariance factored once."""
    cols = ["series_id", "n", "hurst", "hurst_rs", "simulated_at", "low", "high", "mean", "sd"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["q"].to_numpy(float)
        n = len(x)
        sizes = tuple(m for m in (4, 5, 8, 10, 15, 20) if m <= n // 2)
        if n < 16 or x.std() == 0:
            return pd.DataFrame([(key[0], n, *[None] * 7)], columns=cols)
        lags = np.arange(2, max(4, min(14, n // 4)) + 1)
        h, rs = _slopes(x, lags, sizes)
        at = h if 0 < h < 1 else 0.5
        paths = kernels.stream(f"hurst:{key[0]}").standard_normal((reps, n)) @ _noise_root(n, at).T
        drawn = np.array([_slopes(p, lags, sizes)[0] for p in paths])
        low, high = np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([(key[0], n, h, rs, at, low, high, drawn.mean(), drawn.std(ddof=1))], columns=cols)

    return series.select("series_id", "t", "q").groupBy("series_id").applyInPandas(run, "series_id string, n long, hurst double, hurst_rs double, simulated_at double, low double, high double, mean double, sd double")


def hurst_recovery(spark, n: int = 57, reps: int = 600, truth: tuple[float, ...] = (0.5, 0.7)) -> DataFrame:
    """Bias, sd and 95 % half-width of both estimators on noise of known exponents, a row each."""
    sizes = tuple(m for m in (4, 5, 8, 10, 15, 20) if m <= n // 2)
    lags = np.arange(2, max(4, min(14, n // 4)) + 1)

    def run(batches):
        for pdf in batches:
            for h in pdf["truth"]:
                paths = kernels.stream(f"recovery:{h}:{n}").standard_normal((reps, n)) @ _noise_root(n, h).T
                found = np.array([_slopes(p, lags, sizes) for p in paths])
                for k, name in enumerate(("variogram", "rescaled range")):
                    yield pd.DataFrame([(float(h), name, found[:, k].mean() - h, found[:, k].std(ddof=1), 1.96 * found[:, k].std(ddof=1))], columns=["truth", "estimator", "bias", "sd", "half_width"])

    return spark.createDataFrame([(float(h),) for h in truth], "truth double").mapInPandas(run, "truth double, estimator string, bias double, sd double, half_width double")
