"""Peaks over threshold: exceedances, mean residual life, thresholds, generalised Pareto by PWMs, return levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import norm_ppf, num
from .frequency import periods
from .ranks import beyond, counted, counted_percentiles, intervals


def exceedances(base: DataFrame, at: float = 0.9) -> DataFrame:
    """base: series_id, ts, x. The values beyond each series' own percentile, as y = x - u."""
    return _over(base, counted(base.select("series_id", "x")), at)


def counted_exceedances(base: DataFrame, at: float = 0.9) -> DataFrame:
    """The same with equal values as one row and their number c; only series_id and x are read."""
    values = counted(base.select("series_id", "x"))
    return _over(values, values, at)


def _over(base: DataFrame, values: DataFrame, at: float) -> DataFrame:
    u = counted_percentiles(values, [at]).select("series_id", F.col("values")[0].alias("u"), F.col("n").alias("n_base"))
    return base.join(u, "series_id").filter("x > u").withColumn("y", F.col("x") - F.col("u"))


def declustered(base: DataFrame, u: float, gap: str = "6 hours") -> DataFrame:
    """The peak of each run of exceedances that are no further apart than the gap."""
    over = base.filter(F.col("x") > u)
    return over.groupBy("series_id", F.session_window("ts", gap).alias("run")).agg(F.max("x").alias("x"), F.count(F.lit(1)).alias("n")).select("series_id", F.col("run.start").alias("start"), "x", "n")


def mean_residual_life(base: DataFrame, points: int = 40, least: int = 5, top: float = 0.92) -> DataFrame:
    """Mean excess, sd and 95 % limits over evenly spaced thresholds from the least value to a percentile.

    A distinct value is summed once, at the last threshold below it; sums about the series' mean keep the digits of the variance.
    """
    values, c = counted(base.select("series_id", "x")), F.col("c")
    g = values.groupBy("series_id").agg(F.min("x").alias("_lo"), (F.sum(F.col("x") * c) / F.sum(c)).alias("_m")).join(counted_percentiles(values, [top]).select("series_id", F.col("values")[0].alias("_hi")), "series_id")
    us = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (points - 1))
    d = F.col("x") - F.col("_m")
    m = intervals(values, g.select("series_id", "_m", us.alias("us")), {"s1": d * c, "s2": d * d * c}).join(g.select("series_id", "_m"), "series_id").filter("n > 0")
    mean = F.col("s1") / F.col("n")
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("s2") - F.col("s1") * mean, F.lit(0.0)) / (F.col("n") - 1)))
    m = m.withColumns({"mean_excess": mean - (F.col("u") - F.col("_m")), "sd": sd})
    half = F.expr(norm_ppf(num(0.975))) * F.col("sd") / F.sqrt("n")
    enough = F.col("n") >= least
    return m.select("series_id", "k", "u", "n", *[F.when(enough, c).alias(name) for name, c in (("mean_excess", F.col("mean_excess")), ("sd", F.col("sd")), ("low", F.col("mean_excess") - half), ("high", F.col("mean_excess") + half))])


def _by_moments(g: DataFrame) -> DataFrame:
    """Adds xi and beta from the probability-weighted moments a0 and a1 of the excesses."""
    d = F.col("a0") - 2 * F.col("a1")
    return g.withColumns({"xi": 2 - F.try_divide(F.col("a0"), d), "beta": F.try_divide(2 * F.col("a0") * F.col("a1"), d)})


def _rank_sum() -> Column:
    """The sum of rank - 1 over the equal rows of a counted value, with rank 1 for the greatest."""
    return F.col("c") * F.col("above") + F.col("c") * (F.col("c") - 1) / 2


def gpd_pwm(over: DataFrame) -> DataFrame:
    """Generalised Pareto by probability-weighted moments of the excesses: shape xi, scale beta, and the rate of exceedance.

    over: exceedances, or counted ones.
    """
    slim = over.select("series_id", "u", "n_base", F.col("y").alias("x"), *[c for c in over.columns if c == "c"])
    df = beyond(slim if "c" in over.columns else counted(slim))
    x, n = F.col("x"), F.sum("c")
    g = df.groupBy("series_id").agg(F.first("u").alias("u"), F.first("n_base").alias("n_base"), n.alias("n"), (F.sum(x * F.col("c")) / n).alias("a0"), F.try_divide(F.sum(x * _rank_sum()), n * (n - 1)).alias("a1"))
    return _by_moments(g.filter("n > 1")).select("series_id", "u", "n_base", "n", "xi", "beta", (F.col("n") / F.col("n_base")).alias("rate"))


def return_levels(fit: DataFrame, per_block: float = 1.0) -> DataFrame:
    """u + beta / xi ((T rate)^xi - 1), and its limit u + beta ln(T rate) for a shape of about zero."""
    df = periods(fit).withColumn("_m", F.col("period") * F.col("rate") * per_block)
    power = F.col("u") + F.col("beta") / F.col("xi") * (F.pow("_m", "xi") - 1)
    return df.select("series_id", "period", F.when(F.abs("xi") < 1e-8, F.col("u") + F.col("beta") * F.log("_m")).otherwise(power).alias("q"))


def threshold_stability(base: DataFrame, at: tuple[float, ...] = (0.7, 0.75, 0.8, 0.85, 0.9, 0.95), least: int = 10) -> DataFrame:
    """The fit at several percentile thresholds, with the penalty mean excess + 6 mean excess / sqrt(n); too few excesses are left out.

    The rank of an excess over a threshold, from the top, is that of its value in the whole record, so the moments at all
    thresholds are sums of x and x (rank - 1) over the values beyond.
    """
    values = counted(base.select("series_id", "x"))
    steps = counted_percentiles(values, at).select("series_id", F.col("values").alias("us"))
    g = intervals(beyond(values), steps, {"s": F.col("x") * F.col("c"), "sr": F.col("x") * _rank_sum()}).filter(F.col("n") >= max(least, 2))
    n, u = F.col("n"), F.col("u")
    g = g.withColumns({"a0": F.col("s") / n - u, "a1": (F.col("sr") - u * n * (n - 1) / 2) / (n * (n - 1))})
    names = F.array(*[F.lit(float(p)) for p in at])
    out = _by_moments(g).withColumn("mean_excess", F.col("a0"))
    return out.select("series_id", F.get(names, F.col("k")).alias("at"), "u", "n", "xi", "beta", "mean_excess", (F.col("mean_excess") + 6 * F.col("mean_excess") / F.sqrt("n")).alias("penalty"))
