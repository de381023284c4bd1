"""Moments, L-moments and shape of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import norm_ppf
from .series import ranked, sized


def _central(df: DataFrame, x: str) -> DataFrame:
    """n, mean, m2..m4 (1/n central moments), min and max of x per series, in two passes for accuracy."""
    d = F.col(x) - F.avg(x).over(sized())
    df = df.withColumn("_d", d)
    return df.groupBy("series_id").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), *[F.avg(F.pow("_d", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)], F.min(x).alias("min"), F.max(x).alias("max"))


def summary(series: DataFrame) -> DataFrame:
    """n, extremes, mean, median, sd, cv, log mean and sd, range ratio, first and last block."""
    g = series.groupBy("series_id").agg(
        F.count("q").alias("n"), F.min("q").alias("min"), F.max("q").alias("max"), F.avg("q").alias("mean"), F.percentile("q", F.lit(0.5)).alias("median"), F.stddev_samp("q").alias("sd"),
        F.avg(F.log("q")).alias("log_mean"), F.stddev_samp(F.log("q")).alias("log_sd"), F.min("block").alias("first_block"), F.max("block").alias("last_block"),
    )
    return g.withColumns({"cv": F.col("sd") / F.col("mean"), "cv_percent": 100 * F.col("sd") / F.col("mean"), "range_ratio": F.col("max") / F.col("min")})


def moment_coefficients(series: DataFrame, log: bool = False) -> DataFrame:
    """Skew g1 and G1, kurtosis Ck = m4 / m2^2, excess g2 and G2, and their standard errors; null below 8 values or without variance."""
    df = series.withColumn("_x", F.log("q") if log else F.col("q"))
    c = _central(df, "_x").withColumn("_ok", (F.col("n") >= 8) & (F.col("m2") > 0))
    n = F.col("n")
    g1 = F.when(F.col("_ok"), F.col("m3") / F.pow("m2", F.lit(1.5)))
    ck = F.when(F.col("_ok"), F.col("m4") / F.pow("m2", F.lit(2.0)))
    c = c.withColumns({"g1": g1, "ck": ck})
    d = F.try_divide
    return c.select(
        "series_id", "n", "mean", F.sqrt(d(F.col("m2") * n, n - 1)).alias("sd"), "g1", (d(F.sqrt(n * (n - 1)), n - 2) * F.col("g1")).alias("skew"), "ck", (F.col("ck") - 3).alias("g2"),
        (d(n - 1, (n - 2) * (n - 3)) * ((n + 1) * (F.col("ck") - 3) + 6)).alias("kurtosis_adjusted"), F.sqrt(6 / n).alias("se_skew"), F.sqrt(24 / n).alias("se_kurtosis"),
    )


def skewness_estimators(series: DataFrame) -> DataFrame:
    """Five estimators, long: g1, G1, Bowley, Pearson's second, and the skew of normal scores."""
    base = moment_coefficients(series).select("series_id", "mean", "sd", F.col("g1"), F.col("skew"))
    q = series.groupBy("series_id").agg(F.percentile("q", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("_p"))
    rank = F.rank().over(W.partitionBy("series_id").orderBy("q")) + (F.count(F.lit(1)).over(W.partitionBy("series_id", "q")) - 1) / 2
    scores = series.withColumn("_p", (rank - 0.375) / (F.count(F.lit(1)).over(sized()) + 0.25)).withColumn("_z", F.expr(norm_ppf("_p")))
    z = _central(scores, "_z").select("series_id", F.when(F.col("m2") > 0, F.col("m3") / F.pow("m2", F.lit(1.5))).alias("normal_scores"))
    df = base.join(q, "series_id").join(z, "series_id")
    p = F.col("_p")
    df = df.withColumns({"bowley": F.when(p[2] > p[0], (p[2] + p[0] - 2 * p[1]) / (p[2] - p[0])), "pearson2": F.when(F.col("sd") > 0, 3 * (F.col("mean") - p[1]) / F.col("sd"))})
    return df.unpivot("series_id", ["g1", "skew", "bowley", "pearson2", "normal_scores"], "estimator", "value")


def _weights(j: Column, n: Column, r: int) -> Column:
    """C(j - 1, r) / C(n - 1, r) as a falling product."""
    w = F.lit(1.0)
    for k in range(1, r + 1):
        w = w * (j - k) / (n - k)
    return w


def lmoments(series: DataFrame) -> DataFrame:
    """Unbiased PWMs b0..b3, L-moments and ratios, and whether the ratios are reliable (n >= 20, 0 < L-CV < 2.5, |ratios| < 1)."""
    df = ranked(series)
    j, n = F.col("rank"), F.col("n")
    b = df.groupBy("series_id").agg(F.max("n").alias("n"), *[F.avg(F.col("q") * F.when(n > r, _weights(j, n, r))).alias(f"b{r}") for r in range(4)])
    return _ratios(b)


def _ratios(b: DataFrame) -> DataFrame:
    b = b.withColumns({"l1": F.col("b0"), "l2": 2 * F.col("b1") - F.col("b0"), "l3": 6 * F.col("b2") - 6 * F.col("b1") + F.col("b0"), "l4": 20 * F.col("b3") - 30 * F.col("b2") + 12 * F.col("b1") - F.col("b0")})
    b = b.withColumns({"lcv": F.when(F.col("l1") != 0, F.col("l2") / F.col("l1")), "tau3": F.when(F.col("l2") != 0, F.col("l3") / F.col("l2")), "tau4": F.when(F.col("l2") != 0, F.col("l4") / F.col("l2"))})
    return b.withColumn("ratios_reliable", F.coalesce((F.col("n") >= 20) & (F.col("lcv") > 0) & (F.col("lcv") < 2.5) & (F.abs("tau3") < 1) & (F.abs("tau4") < 1), F.lit(False)))


def consistent_lmoments(series: DataFrame, a: float = 0.35) -> DataFrame:
    """L-moments from plotting-position PWMs, p = (i - a) / n."""
    df = ranked(series).withColumn("_p", (F.col("rank") - a) / F.col("n"))
    return _ratios(df.groupBy("series_id").agg(F.max("n").alias("n"), *[F.avg(F.col("q") * F.pow("_p", F.lit(float(r)))).alias(f"b{r}") for r in range(4)]))


def log_moments(series: DataFrame) -> DataFrame:
    """Mean, sd and adjusted skew of ln q, as the log-Pearson fit by moments takes them."""
    c = moment_coefficients(series, log=True)
    return c.select("series_id", "n", F.col("mean").alias("mean_log"), F.col("sd").alias("sd_log"), F.col("skew").alias("skew_log"), F.col("ck").alias("ck_log"), "se_skew")


def gumbel_moments(series: DataFrame) -> DataFrame:
    """Gumbel scale and location by moments: beta = s sqrt(6) / pi, mu = mean - gamma beta."""
    g = series.groupBy("series_id").agg(F.avg("q").alias("mean"), F.stddev_samp("q").alias("sd"))
    g = g.withColumn("beta", F.col("sd") * F.sqrt(F.lit(6.0)) / F.pi())
    return g.withColumn("mu", F.col("mean") - F.lit(0.5772156649015329) * F.col("beta"))


def histogram(series: DataFrame) -> DataFrame:
    """Equal-width bins by Sturges' rule, the last closed; empty bins are kept."""
    g = series.groupBy("series_id").agg(F.count("q").alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi"))
    g = g.withColumn("bins", F.greatest(F.lit(1), F.ceil(1 + F.log2(F.greatest("n", F.lit(2)).cast("double")))).cast("int")).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    at = F.when(F.col("width") > 0, F.least(F.floor((F.col("q") - F.col("lo")) / F.col("width")), F.col("bins") - 1)).otherwise(0).cast("int")
    counts = series.join(g, "series_id").groupBy("series_id", at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = g.select("series_id", "lo", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    out = every.join(counts, ["series_id", "bin"], "left")
    return out.select("series_id", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("right"), F.coalesce("count", F.lit(0)).alias("count"))


def percentiles(series: DataFrame, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """Exact percentiles with linear interpolation, long."""
    g = series.groupBy("series_id").agg(F.percentile("q", F.array(*[F.lit(p) for p in at])).alias("_p"))
    return g.select("series_id", F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in at]).alias("p"), F.col("_p").alias("value"))).alias("_x")).select("series_id", F.col("_x.p").alias("p"), F.col("_x.value").alias("value"))


def group_shape(series: DataFrame, by: str, least: int = 4) -> DataFrame:
    """Distribution by series and group (decade, season), of groups with enough values."""
    g = series.groupBy("series_id", by).agg(F.count("q").alias("n"), F.avg("q").alias("mean"), F.stddev_samp("q").alias("sd"), F.percentile("q", F.lit(0.25)).alias("q25"), F.percentile("q", F.lit(0.5)).alias("q50"), F.percentile("q", F.lit(0.75)).alias("q75"))
    return g.filter(F.col("n") >= least)
