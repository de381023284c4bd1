"""The choice of a threshold for peaks, its fit behind gates, and the stability of return levels over thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .frequency import periods
from .kernels import fit_gpd, gpd_profile
from .ranks import percentiles, running
from .series import PERIODS

#: Candidate thresholds, as percentiles of the base.
CANDIDATES = (0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.925, 0.95)
#: Excesses that a fit needs at least.
LEAST = 10
METHODS = ("jenkinson_collison", "profile_penalty", "quantile")


def over_candidates(base: DataFrame, at: tuple[float, ...] = CANDIDATES) -> DataFrame:
    """base: series_id, x. A row for every value and candidate threshold below it: at, u, n_base, y."""
    g = percentiles(base, at).select("series_id", F.col("values").alias("_u"), F.col("n").alias("n_base"))
    steps = F.array(*[F.struct(F.lit(p).alias("at"), F.col("_u")[i].alias("u")) for i, p in enumerate(at)])
    df = base.join(g, "series_id").select("series_id", "x", "n_base", F.inline(F.filter(steps, lambda s: s["u"] < F.col("x"))))
    return df.withColumn("y", F.col("x") - F.col("u"))


def penalty_scan(base: DataFrame, at: tuple[float, ...] = CANDIDATES, penalty: float = 6.0) -> DataFrame:
    """The likelihood fit at every candidate threshold, and mean excess + penalty mean excess / sqrt(n), least first in place.

    Thresholds with fewer than LEAST excesses are listed as not usable.
    """

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.sort(pdf["y"].to_numpy())
        own = [key[0], key[1], float(pdf["u"].iloc[0]), len(y), int(pdf["n_base"].iloc[0])]
        usable = len(y) >= LEAST
        xi, beta, value = fit_gpd(y) if usable else (None, None, None)
        mean = float(y.mean()) if usable else None
        cols = ["series_id", "at", "u", "n", "n_base", "xi", "beta", "neg_loglik", "mean_excess", "penalty", "usable"]
        return pd.DataFrame([(*own, xi, beta, value, mean, mean + penalty * mean / len(y) ** 0.5 if usable else None, usable)], columns=cols)

    found = over_candidates(base, at).groupBy("series_id", "at").applyInPandas(fit, "series_id string, at double, u double, n long, n_base long, xi double, beta double, neg_loglik double, mean_excess double, penalty double, usable boolean")
    return found.withColumn("place", F.row_number().over(W.partitionBy("series_id").orderBy(F.col("penalty").asc_nulls_last(), "at")))


def level_stability(scan: DataFrame, per_block: float = 1.0) -> DataFrame:
    """scan: penalty_scan(). Return levels of every usable threshold and period."""
    df = periods(scan.filter("usable")).withColumn("rate", F.col("n") / F.col("n_base") * per_block).withColumn("_m", F.col("period") * F.col("rate"))
    power = F.col("u") + F.col("beta") / F.col("xi") * (F.pow("_m", "xi") - 1)
    return df.select("series_id", "at", "u", "n", "xi", "rate", "period", F.when(F.abs("xi") < 1e-8, F.col("u") + F.col("beta") * F.log("_m")).otherwise(power).alias("q"))


def jenkinson_collison(base: DataFrame) -> DataFrame:
    """Scans every order statistic from 5 to 95 % of the base as a threshold: the summed squared distance of the excesses
    over it from the quantiles of an exponential law with their mean; the least one, with its rank k and excesses.

    With rank r from the top, the quantile of a value over the threshold of rank R is mean (ln R - ln r), whatever the
    threshold; so all distances follow from running sums of x, x^2, x ln r, ln r and ln^2 r.
    """
    centre = base.groupBy("series_id").agg(F.avg("x").alias("_m"))
    rows = base.select("series_id", "x").join(centre, "series_id").select("series_id", (F.col("x") - F.col("_m")).alias("x"), "_m")
    x, log = F.col("x"), F.log(F.col("rank").cast("double"))
    df = running(rows, {"sx": x, "sxx": x * x, "sxl": x * log, "sl": log, "sll": log * log})
    r, top = F.col("rank") - 1, F.log(F.col("rank").cast("double"))
    y1 = F.col("sx") - r * x
    y2 = F.col("sxx") - 2 * x * F.col("sx") + r * x * x
    ye = F.col("sxl") - x * F.col("sl") - top * y1
    e2 = F.col("sll") - 2 * top * F.col("sl") + r * top * top
    df = df.withColumns({"k": F.col("n") + 1 - F.col("rank"), "over": r, "mean": F.when(r > 0, y1 / r)})
    df = df.withColumn("d", F.round(y2 + 2 * F.col("mean") * ye + F.col("mean") * F.col("mean") * e2, 9))
    low, high = F.greatest(F.lit(2), F.floor(0.05 * F.col("n"))), F.greatest(F.lit(3), F.floor(0.95 * F.col("n")))
    usable = F.col("k").between(low, high) & (F.col("over") >= 3) & (F.col("n") >= 10) & (F.col("mean") > 0)
    g = df.groupBy("series_id").agg(F.min(F.when(usable, F.struct("d", "k", (x + F.col("_m")).alias("u"), F.col("over").cast("long").alias("over")))).alias("b"))
    return g.select("series_id", F.col("b.k").cast("int").alias("k"), F.col("b.u").alias("threshold"), F.col("b.over").alias("n"), F.col("b.d").alias("distance"))


def threshold(base: DataFrame, method: str = "jenkinson_collison") -> DataFrame:
    """series_id, u and source of the threshold by one of METHODS; jenkinson_collison falls back to the penalty where fewer
    than LEAST excesses are left, and source says so."""
    if method not in METHODS:
        raise KeyError(method)
    if method == "quantile":
        at = sorted(CANDIDATES)[len(CANDIDATES) // 2]
        return percentiles(base, [at]).select("series_id", F.col("values")[0].alias("u")).withColumn("source", F.lit(f"percentile {at}"))
    by_penalty = penalty_scan(base).filter("usable and place = 1").select("series_id", F.col("u").alias("_p"))
    if method == "profile_penalty":
        return by_penalty.select("series_id", F.col("_p").alias("u"), F.lit("penalty").alias("source"))
    jc = jenkinson_collison(base).select("series_id", "threshold", "n")
    enough = F.coalesce(F.col("n") >= LEAST, F.lit(False))
    return jc.join(by_penalty, "series_id", "left").select("series_id", F.when(enough, F.col("threshold")).otherwise(F.col("_p")).alias("u"), F.when(enough, "jenkinson-collison").otherwise("penalty after jenkinson-collison").alias("source")).filter("u is not null")


def gated_fit(base: DataFrame, method: str = "jenkinson_collison", per_block: float = 1.0, least: int = 30) -> DataFrame:
    """The fit at the chosen threshold with return levels, and reject_reasons of six gates; the levels are null unless accepted.

    Gates: enough excesses, a shape off the bounds, a shape interval not wholly below zero, levels that are finite and that
    increase, and a longest level that moves by no more than half of itself over the candidate thresholds.
    """
    chosen = threshold(base, method)
    n_base = base.groupBy("series_id").agg(F.count("x").alias("n_base"))
    over = base.select("series_id", "x").join(chosen, "series_id").filter("x > u").withColumn("y", F.col("x") - F.col("u"))
    fit = gpd_profile(over).join(chosen, "series_id").join(n_base, "series_id").withColumn("rate", F.col("n") / F.col("n_base") * per_block)
    m = lambda t: F.lit(float(t)) * F.col("rate")
    level = lambda t: F.when(F.abs("xi") < 1e-8, F.col("u") + F.col("beta") * F.log(m(t))).otherwise(F.col("u") + F.col("beta") / F.col("xi") * (F.pow(m(t), F.col("xi")) - 1))
    fit = fit.withColumn("levels", F.array(*[level(t) for t in PERIODS]))
    spread = level_stability(penalty_scan(base), per_block).filter(F.col("period") == float(PERIODS[-1])).groupBy("series_id").agg((F.max("q") - F.min("q")).alias("_spread"))
    fit = fit.join(spread, "series_id", "left")
    finite = F.coalesce(F.forall("levels", lambda v: ~F.isnan(v) & (F.abs(v) < 1e300)), F.lit(False))
    rising = F.forall(F.sequence(F.lit(1), F.lit(len(PERIODS) - 1)), lambda i: F.get("levels", i) > F.get("levels", i - 1))
    last = F.get("levels", F.lit(len(PERIODS) - 1))
    rules = [
        ("too few exceedances", F.col("n") < least), ("shape at a bound", F.coalesce("at_bound", F.lit(True))), ("bounded tail", F.coalesce(F.col("xi_high") < 0, F.lit(False))),
        ("levels not finite", ~finite), ("levels not increasing", finite & ~rising), ("depends on the threshold", finite & F.coalesce(F.col("_spread") > 0.5 * last, F.lit(False))),
    ]
    df = fit.withColumn("reject_reasons", F.array_compact(F.array(*[F.when(c, name) for name, c in rules])))
    df = df.withColumn("accepted", F.size("reject_reasons") == 0)
    keep = ["series_id", "source", "u", "n", "n_base", "rate", "xi", "beta", "xi_low", "xi_high", "accepted", "reject_reasons"]
    at = F.arrays_zip(F.array(*[F.lit(float(t)) for t in PERIODS]).alias("period"), F.col("levels").alias("q"))
    return df.select(*keep, F.explode(at).alias("_l")).select(*keep, "_l.period", F.when(F.col("accepted"), F.col("_l.q")).alias("q"))
