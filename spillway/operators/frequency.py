"""Candidate distributions: fits, goodness, gates, ranking, and design values by return period.

Closed forms and one-parameter Newton steps run as Column expressions; families that need a search (GEV by its
L-moment equations aside) are fitted in grouped Arrow kernels, see kernels.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import norm_cdf, norm_ppf, num, pearson3_factor_steps, pearson3_steps
from .moments import lmoments, log_moments
from .series import PERIODS, ranked

CLOSED = ("exponential", "ln2", "gumbel_mom", "gumbel_lmom")
EULER = 0.5772156649015329


def periods(df: DataFrame, t: tuple[int, ...] = PERIODS) -> DataFrame:
    """Every row with each return period; the list is a constant of the plan, not a join."""
    return df.withColumn("period", F.explode(F.array(*[F.lit(float(x)) for x in t])))


def closed_fits(series: DataFrame) -> DataFrame:
    """Long: series_id, family, k (parameters), p1, p2 of the families with closed forms.

    exponential: p1 mean. ln2: p1 mean, p2 population sd of ln q. gumbel: p1 location, p2 scale, by moments and L-moments.
    """
    g = series.groupBy("series_id").agg(F.count("q").alias("n"), F.avg("q").alias("m"), F.stddev_samp("q").alias("s"), F.avg(F.log("q")).alias("lm"), F.stddev_pop(F.log("q")).alias("ls"))
    g = g.join(lmoments(series).select("series_id", "l1", "l2"), "series_id")
    beta, alpha = F.col("s") * F.sqrt(F.lit(6.0)) / F.pi(), F.col("l2") / F.log(F.lit(2.0))
    none = F.lit(None).cast("double")
    rows = [("exponential", 1, F.col("m"), none), ("ln2", 2, F.col("lm"), F.col("ls")), ("gumbel_mom", 2, F.col("m") - EULER * beta, beta), ("gumbel_lmom", 2, F.col("l1") - EULER * alpha, alpha)]
    return g.select("series_id", "n", F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(k).alias("k"), a.alias("p1"), b.alias("p2")) for f, k, a, b in rows])))


def quantile(p: str = "1 - 1 / period") -> Column:
    """The quantile of family, p1, p2 at non-exceedance p."""
    return F.expr(f"CASE WHEN family = 'exponential' THEN -p1 * ln(1 - ({p})) WHEN family = 'ln2' THEN exp(p1 + p2 * {norm_ppf(p)}) ELSE p1 - p2 * ln(-ln({p})) END")


def cdf(x: str = "q") -> Column:
    return F.expr(f"CASE WHEN family = 'exponential' THEN 1 - exp(-({x}) / p1) WHEN family = 'ln2' THEN {norm_cdf(f'((ln({x}) - p1) / p2)')} ELSE exp(-exp(-(({x}) - p1) / p2)) END")


def log_density(x: str = "q") -> Column:
    half = num(0.9189385332046727)
    return F.expr(f"CASE WHEN family = 'exponential' THEN -ln(p1) - ({x}) / p1 WHEN family = 'ln2' THEN -ln({x}) - ln(p2) - {half} - power((ln({x}) - p1) / p2, 2) / 2 ELSE -ln(p2) - (({x}) - p1) / p2 - exp(-(({x}) - p1) / p2) END")


def goodness(series: DataFrame, fits: DataFrame) -> DataFrame:
    """Log-likelihood, AIC, BIC, AICc, HQIC, Kolmogorov-Smirnov D and Anderson-Darling A^2 of each fit."""
    df = ranked(series).drop("n").join(fits, "series_id").withColumn("u", F.greatest(F.least(cdf(), F.lit(1 - 1e-12)), F.lit(1e-12))).withColumn("_ld", log_density())
    i, n = F.col("rank"), F.col("n")
    d = F.greatest(i / n - F.col("u"), F.col("u") - (i - 1) / n)
    # The mirrored term of A^2 needs ln(1 - u_(n+1-i)); summed over i it is a weight 2n + 1 - 2i on ln(1 - u_i).
    a2 = (2 * i - 1) * F.log("u") + (2 * n + 1 - 2 * i) * F.log(1 - F.col("u"))
    g = df.groupBy("series_id", "family", "n", "k", "p1", "p2").agg(F.sum("_ld").alias("loglik"), F.max(d).alias("ks"), F.avg(a2).alias("_a"), F.min("u").alias("u_min"), F.max("u").alias("u_max"), F.max("q").alias("q_max"))
    k = F.col("k")
    g = g.withColumns({"a2": -n - F.col("_a"), "aic": 2 * k - 2 * F.col("loglik"), "bic": k * F.log(n) - 2 * F.col("loglik"), "hqic": 2 * k * F.log(F.log(n)) - 2 * F.col("loglik")})
    return g.withColumn("aicc", F.col("aic") + 2 * k * (k + 1) / (n - k - 1)).drop("_a")


def gated(good: DataFrame, factor: float = 0.5) -> DataFrame:
    """reject_reasons and accepted: scale, finite likelihood, tails within the record, Q1000, KS against its 5 % limit."""
    q1000 = quantile("0.999D")
    n = F.col("n")
    rules = [
        ("parameters", F.coalesce(F.isnan("p1") | F.isnan("p2"), F.isnan("p1"))),
        ("scale", F.coalesce(F.col("p2") <= 0, F.lit(False)) | ((F.col("family") == "exponential") & (F.col("p1") <= 0))),
        ("likelihood", F.isnan("loglik") | F.col("loglik").isNull()),
        ("lower tail", F.col("u_min") < 1 / (2.0 * n) * 0.01),
        ("upper tail", F.col("u_max") > 1 - 1 / (2.0 * n) * 0.01),
        ("q1000 below the record", q1000 < F.col("q_max") * factor),
        ("ks", F.col("ks") > 1.358 / F.sqrt(n)),
    ]
    reasons = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules]))
    return good.withColumn("reject_reasons", reasons).withColumn("accepted", F.size("reject_reasons") == 0)


def ranking(series: DataFrame) -> DataFrame:
    """The fits with gates, rank by AICc among the accepted (equal values share the least rank) and Akaike weight."""
    g = gated(goodness(series, closed_fits(series)))
    w = W.partitionBy("series_id", "accepted")
    rank = F.when(F.col("accepted"), F.rank().over(w.orderBy(F.round("aicc", 9))))
    e = F.exp(-(F.col("aicc") - F.min("aicc").over(w)) / 2)
    return g.withColumns({"rank": rank, "weight": F.when(F.col("accepted"), e / F.sum(e).over(w))})


def wilson_hilferty(skew: str, p: str) -> Column:
    """The Pearson-III frequency factor by Wilson and Hilferty; the normal quantile for a skew of about zero."""
    z = norm_ppf(p)
    return F.expr(f"CASE WHEN abs({skew}) < CAST(1e-10 AS DOUBLE) THEN {z} ELSE 2 / {skew} * (power(1 + {skew} * {z} / 6 - {skew} * {skew} / 36, 3) - 1) END")


def lp3(series: DataFrame, level: float = 0.95, factors: DataFrame | None = None) -> DataFrame:
    """Log-Pearson III by moments: frequency factor, quantile, standard error and limits of every return period.

    factors: series_id, period, factor, such as kernels.exact_factors(); without them, Wilson and Hilferty's.
    """
    df = periods(log_moments(series)).withColumn("p", 1 - 1 / F.col("period"))
    df = df.withColumn("factor", wilson_hilferty("skew_log", "p")) if factors is None else df.join(factors.select("series_id", "period", "factor"), ["series_id", "period"])
    df = df.withColumn("q", F.exp(F.col("mean_log") + F.col("factor") * F.col("sd_log")))
    k, g = F.col("factor"), F.col("skew_log")
    inner = 1 + k**2 / 2 * (1 + 3 * g**2 / 4) + k * g
    df = df.withColumn("se", F.col("sd_log") * F.sqrt(F.greatest(inner, F.lit(0.0)) / F.col("n")))
    z = F.expr(norm_ppf(num(0.5 + level / 2)))
    return df.select("series_id", "period", "n", "mean_log", "sd_log", "skew_log", "factor", "q", "se", (F.col("q") * F.exp(-z * F.col("se"))).alias("q_low"), (F.col("q") * F.exp(z * F.col("se"))).alias("q_high"))


def staged(df: DataFrame, steps: list[list[tuple[str, str]]]) -> DataFrame:
    """df with the columns of all steps of a special function."""
    for step in steps:
        df = df.withColumns({name: F.expr(text) for name, text in step})
    return df


def lp3_distribution(series: DataFrame) -> DataFrame:
    """The fitted log-Pearson III law at every value of q: cdf, its complement without loss, and the density on the scale of q."""
    fits = log_moments(series).filter("sd_log > 0 AND skew_log IS NOT NULL").select("series_id", "n", "mean_log", "sd_log", "skew_log")
    df = series.select("series_id", "t", "q").filter("q > 0").withColumn("y", F.log("q")).join(fits, "series_id")
    df = staged(df, pearson3_steps("y", "mean_log", "sd_log", "skew_log", "w"))
    return df.select("series_id", "t", "n", "q", F.col("w_cdf").alias("cdf"), F.col("w_sf").alias("sf"), (F.col("w_pdf") / F.col("q")).alias("density"))


def factor_gap(series: DataFrame) -> DataFrame:
    """Exact Pearson-III factors beside Wilson and Hilferty's for every return period, and what these are off by in percent."""
    df = periods(log_moments(series).filter("skew_log IS NOT NULL").select("series_id", F.col("skew_log").alias("skew"))).withColumn("p", 1 - 1 / F.col("period"))
    df = staged(df, pearson3_factor_steps("p", "skew", "exact")).withColumn("approximate", wilson_hilferty("skew", "p"))
    gap = F.try_divide(100 * (F.col("approximate") - F.col("exact")), F.abs("exact"))
    return df.select("series_id", "period", "skew", "exact", "approximate", gap.alias("gap_percent"))


def implied_periods(series: DataFrame, design: DataFrame) -> DataFrame:
    """The period that the fitted law gives the record's greatest value, which may lie beyond any table of design values.

    design: series_id, period, q. passed is false if a design value of a period of n or more does not exceed the record's
    greatest, or if the implied period exceeds 2 (n + 1).
    """
    fits = log_moments(series).filter("sd_log > 0 AND skew_log IS NOT NULL").select("series_id", "n", "mean_log", "sd_log", "skew_log")
    top = series.groupBy("series_id").agg(F.max("q").alias("max")).filter("max > 0").join(fits, "series_id").withColumn("y", F.log("max"))
    top = staged(top, pearson3_steps("y", "mean_log", "sd_log", "skew_log", "w"))
    top = top.select("series_id", "n", "max", F.col("w_cdf").alias("cdf"), (1 / F.greatest("w_sf", F.lit(1e-12))).alias("implied_period"))
    low = design.select("series_id", "period", "q").join(top.select("series_id", "n", "max"), "series_id").groupBy("series_id").agg(F.sum(((F.col("period") >= F.col("n")) & (F.col("q") <= F.col("max"))).cast("int")).alias("n_below"))
    df = top.join(low, "series_id", "left").withColumn("n_below", F.coalesce("n_below", F.lit(0)))
    return df.withColumn("passed", (F.col("n_below") == 0) & (F.col("implied_period") <= 2 * (F.col("n") + 1)))


def skew_decision(series: DataFrame, limit: float = 0.9) -> DataFrame:
    """z = |skew| / se, one-sided tail, whether the skew is within one se of zero, and which rule governs."""
    df = log_moments(series).withColumn("z", F.abs("skew_log") / F.col("se_skew"))
    tail = F.expr(f"1 - {norm_cdf('z')}")
    return df.select("series_id", "skew_log", "z", tail.alias("tail"), (F.col("z") < 1).alias("within"), (F.abs("skew_log") >= limit).alias("kurtosis_governed"))


def skew_band(series: DataFrame, n_std: float = 1.96, step: float = 0.05) -> DataFrame:
    """Quantiles over a grid of skews around the estimate with both ends, and their ratio to the estimate's."""
    df = log_moments(series).withColumn("_h", n_std * F.col("se_skew"))
    inner = F.transform(F.sequence(F.lit(0), F.floor(2 * F.col("_h") / step).cast("int")), lambda i: F.round(F.col("skew_log") - F.col("_h") + step * i, 6))
    df = df.withColumn("skew", F.explode(F.array_union(inner, F.array(F.round(F.col("skew_log") + F.col("_h"), 6)))))
    df = periods(df).withColumn("p", 1 - 1 / F.col("period"))
    df = df.withColumns({"q": F.exp(F.col("mean_log") + wilson_hilferty("skew", "p") * F.col("sd_log")), "_q0": F.exp(F.col("mean_log") + wilson_hilferty("skew_log", "p") * F.col("sd_log"))})
    return df.select("series_id", "skew", "period", "q", (F.col("q") / F.col("_q0")).alias("ratio"))


def design_values(series: DataFrame) -> DataFrame:
    """One row a return period: the adopted log-Pearson value with limits, the other families, and their spread."""
    main = lp3(series).select("series_id", "period", F.col("q").alias("lp3"), "q_low", "q_high")
    other = periods(closed_fits(series)).withColumn("q", quantile())
    wide = other.groupBy("series_id", "period").pivot("family", list(CLOSED)).agg(F.first("q"))
    df = main.join(wide, ["series_id", "period"])
    every = [F.col("lp3"), F.col("gumbel_mom"), F.col("ln2")]
    spread = F.greatest(*every) - F.least(*every)
    return df.select("series_id", "period", "lp3", "q_low", "q_high", "gumbel_mom", "gumbel_lmom", "ln2", "exponential", spread.alias("spread"), (100 * spread / F.col("lp3")).alias("spread_percent"))


def design_levels(design: DataFrame, curve: DataFrame, freeboard_at: float = 100.0, freeboard: float = 1.0) -> DataFrame:
    """Water levels of the design flows by the rating curve, with freeboard at one return period."""
    from .quality import level

    out = level(design.select("series_id", "period", F.col("lp3").alias("q")), curve)
    extra = F.when(F.col("period") == freeboard_at, F.lit(freeboard))
    return out.select("series_id", "period", "q", "h", extra.alias("freeboard"), (F.col("h") + F.coalesce(extra, F.lit(0.0))).alias("top"), "extrapolated")


def gev_lmoments(series: DataFrame) -> DataFrame:
    """GEV by L-moments with Hosking's approximation of the shape; null where the ratios are unreliable."""
    lm = lmoments(series).filter("l2 > 0")
    c = 2 / (3 + F.col("tau3")) - F.log(F.lit(2.0)) / F.log(F.lit(3.0))
    return lm.select("series_id", "n", "l1", "l2", "tau3", (7.8590 * c + 2.9554 * c**2).alias("shape"))
