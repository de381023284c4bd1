"""Bootstrap and Monte Carlo by a counter-based hash: the same draws for any partitioning."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import hash_bits, norm_cdf, norm_ppf, num
from .frequency import periods, wilson_hilferty
from .moments import log_moments


def bits(rep: str, i: str, seed: int = 20250101) -> Column:
    return F.expr(hash_bits(rep, i, seed, "(({0}) ^ ({1}))", "shiftright({0}, {1})"))


def uniform(rep: str, i: str, seed: int = 20250101) -> Column:
    return (bits(rep, i, seed) + 0.5) / 2147483648.0


def draws(series: DataFrame, reps: int) -> DataFrame:
    """One row per series and replicate with the ordered record as an array: a replicate stays within its row.

    The record travels once per series to `reps` rows; nothing is joined per draw.
    """
    rec = series.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "q"))), lambda x: x["q"]).alias("rec"))
    return rec.withColumn("sid", series_number()).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("rep", F.col("rep").cast("long"))


def series_number() -> Column:
    """A number of the series below 2^28, by md5, that keeps its draws apart from the others'."""
    return F.conv(F.substring(F.md5(F.col("series_id").cast("binary")), 1, 7), 16, 10).cast("long")


def case_resamples(series: DataFrame, reps: int = 2000, seed: int = 20250101) -> DataFrame:
    """B resamples of each record: moments and percentiles per replicate, from an in-row fold of hashed indices."""
    d = draws(series, reps)
    index = hash_bits("rep", "i", f"{seed} + sid", "(({0}) ^ ({1}))", "shiftright({0}, {1})")
    d = d.withColumn("x", F.expr(f"transform(sequence(0L, cast(size(rec) - 1 as bigint)), i -> element_at(rec, cast(({index}) % size(rec) as int) + 1))"))
    return d.select("series_id", "rep", F.explode("x").alias("q"))


def moment_replicates(series: DataFrame, reps: int = 2000, seed: int = 20250101) -> DataFrame:
    df = case_resamples(series, reps, seed)
    g = df.groupBy("series_id", "rep").agg(F.avg("q").alias("mean"), F.stddev_samp("q").alias("sd"), F.skewness("q").alias("skew"), F.kurtosis("q").alias("kurtosis"))
    return g.withColumn("cv", F.col("sd") / F.col("mean"))


def quantile_replicates(samples: DataFrame) -> DataFrame:
    """The empirical T-value of every replicate of samples (series_id, rep, q)."""
    from .series import PERIODS

    p = F.array(*[F.lit(1 - 1 / t) for t in PERIODS])
    g = samples.groupBy("series_id", "rep").agg(F.percentile("q", p).alias("_p"))
    return g.select("series_id", "rep", F.inline(F.array(*[F.struct(F.lit(float(t)).alias("period"), F.col("_p")[k].alias("q")) for k, t in enumerate(PERIODS)])))


def percentile_interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    g = replicates.groupBy("series_id", "period").agg(F.percentile("q", F.array(F.lit(a), F.lit(0.5), F.lit(1 - a))).alias("_p"), F.count("q").alias("reps"))
    return g.select("series_id", "period", "reps", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("high"))


def bias_corrected_interval(replicates: DataFrame, points: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentiles at Phi(2 z0 -+ z), z0 from the share of replicates below the point. points: series_id, period, point."""
    df = replicates.join(points, ["series_id", "period"])
    by = W.partitionBy("series_id", "period")
    below = F.sum((F.col("q") < F.col("point")).cast("double")).over(by)
    n = F.count(F.lit(1)).over(by)
    df = df.withColumns({"_n": n, "_i": F.row_number().over(by.orderBy("q")), "_share": (below + 0.5) / (n + 1)}).withColumn("z0", F.expr(norm_ppf("_share")))
    z = num(NormalDist().inv_cdf(0.5 + level / 2))  # a number: its text is repeated in what follows
    df = df.withColumns({"_lo": F.expr(norm_cdf(f"(2 * z0 - {z})")), "_hi": F.expr(norm_cdf(f"(2 * z0 + {z})"))})
    at = lambda p: F.min(F.when(F.col("_i") >= F.greatest(F.ceil(F.col(p) * F.col("_n")), F.lit(1)), F.col("q")))
    return df.groupBy("series_id", "period").agg(F.first("point").alias("point"), F.first("z0").alias("z0"), at("_lo").alias("low"), at("_hi").alias("high"))


def studentised_interval(replicates: DataFrame, points: DataFrame, level: float = 0.95) -> DataFrame:
    """point - t* se over the replicates' own standard errors (column se); the percentile interval where they are degenerate."""
    a = (1 - level) / 2
    df = replicates.join(points, ["series_id", "period"])
    se = F.stddev_samp("q")
    t = F.when(F.col("se") > 0, (F.col("q") - F.col("point")) / F.col("se"))
    g = df.groupBy("series_id", "period").agg(F.first("point").alias("point"), se.alias("_se"), F.percentile(t, F.array(F.lit(a), F.lit(1 - a))).alias("_t"), F.percentile("q", F.array(F.lit(a), F.lit(1 - a))).alias("_p"))
    return g.select("series_id", "period", "point", F.coalesce(F.col("point") - F.col("_t")[1] * F.col("_se"), F.col("_p")[0]).alias("low"), F.coalesce(F.col("point") - F.col("_t")[0] * F.col("_se"), F.col("_p")[1]).alias("high"))


def parametric_resamples(series: DataFrame, reps: int = 2000, seed: int = 20250102) -> DataFrame:
    """Records of the same length simulated from the log-Pearson fit by moments, by hashed uniforms."""
    fit = log_moments(series).withColumn("sid", series_number())
    u = f"((({hash_bits('rep', 'i', f'{seed} + sid', '(({0}) ^ ({1}))', 'shiftright({0}, {1})')}) + 0.5D) / 2147483648.0D)"
    df = fit.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long")))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    df = df.withColumn("u", F.expr(u))
    return df.select("series_id", "rep", F.col("i").cast("int").alias("t"), F.exp(F.col("mean_log") + wilson_hilferty("skew_log", "u") * F.col("sd_log")).alias("q"))


def keyed(samples: DataFrame) -> DataFrame:
    """Samples whose series_id names series and replicate together, as JSON, for operators that work by series_id; see unkeyed()."""
    return samples.withColumn("series_id", F.to_json(F.struct("series_id", "rep"))).drop("rep")


def unkeyed(name: str) -> Column:
    """series_id or rep of a keyed series_id."""
    return F.from_json("series_id", "series_id string, rep long")[name].alias(name)


def lp3_intervals(series: DataFrame, reps: int = 2000) -> DataFrame:
    """Parametric bootstrap of the log-Pearson values: every replicate is fitted anew by moments."""
    sim = keyed(parametric_resamples(series, reps))
    fit = periods(log_moments(sim)).withColumn("p", 1 - 1 / F.col("period"))
    q = fit.select(unkeyed("series_id"), "period", F.exp(F.col("mean_log") + wilson_hilferty("skew_log", "p") * F.col("sd_log")).alias("q"))
    return percentile_interval(q)


def fan(series: DataFrame, reps: int = 500) -> DataFrame:
    """5, 25, 50, 75 and 95 % of the empirical T-values of simulated records."""
    q = quantile_replicates(parametric_resamples(series, reps))
    at = (0.05, 0.25, 0.5, 0.75, 0.95)
    g = q.groupBy("series_id", "period").agg(F.percentile("q", F.array(*[F.lit(p) for p in at])).alias("_p"))
    return g.select("series_id", "period", *[F.col("_p")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(at)])


def coverage(series: DataFrame, reps: int = 200, inner: int = 500) -> DataFrame:
    """Double bootstrap: the share of simulated records whose percentile limits, of `inner` resamples, hold the parent's own value."""
    from .frequency import lp3

    truth = lp3(series).select("series_id", "period", F.col("q").alias("truth"))
    sim = keyed(parametric_resamples(series, reps))
    limits = percentile_interval(quantile_replicates(case_resamples(sim, inner)))
    df = limits.select(unkeyed("series_id"), "period", "low", "high").join(truth, ["series_id", "period"])
    return df.groupBy("series_id", "period").agg(F.count(F.lit(1)).alias("reps"), F.avg(F.col("truth").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"))


def block_resamples(series: DataFrame, reps: int = 2000, block: int = 5, seed: int = 20250103) -> DataFrame:
    """Circular block bootstrap: (series_id, rep, t, q) in resampled order."""
    d = draws(series, reps)
    h = hash_bits("rep", "(i div " + str(block) + ")", f"{seed} + sid", "(({0}) ^ ({1}))", "shiftright({0}, {1})")
    x = F.expr(f"transform(sequence(0L, cast(size(rec) - 1 as bigint)), i -> element_at(rec, cast((({h}) % size(rec) + i % {block}) % size(rec) as int) + 1))")
    return d.select("series_id", "rep", F.posexplode(x).alias("t", "q"))


def split_r_hat(chains: DataFrame) -> DataFrame:
    """chains: series_id, parameter, chain, draw, value. The potential scale reduction over half chains."""
    by = W.partitionBy("series_id", "parameter", "chain")
    df = chains.withColumns({"_i": F.row_number().over(by.orderBy("draw")), "_n": F.count(F.lit(1)).over(by)})
    df = df.withColumn("_half", F.when(F.col("_i") <= F.floor(F.col("_n") / 2), 0).otherwise(1)).filter((F.col("_half") == 0) | (F.col("_i") > F.col("_n") - F.floor(F.col("_n") / 2)))
    g = df.groupBy("series_id", "parameter", "chain", "_half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("c"))
    o = g.groupBy("series_id", "parameter").agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.min("c").alias("c"))
    return o.select("series_id", "parameter", F.when(F.col("w") > 0, F.sqrt(((F.col("c") - 1) / F.col("c") * F.col("w") + F.col("b")) / F.col("w"))).alias("r_hat"))


def effective_draws(chains: DataFrame) -> DataFrame:
    """The effective number of draws of all chains together, by the variance of the means of batches of sqrt(n) draws."""
    by = W.partitionBy("series_id", "parameter", "chain")
    df = chains.withColumn("_b", F.floor(F.sqrt(F.count(F.lit(1)).over(by)))).withColumn("_batch", F.floor(F.col("draw") / F.col("_b")))
    g = df.groupBy("series_id", "parameter", "chain", "_batch").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("c"), F.first("_b").alias("b")).filter("c = b")
    o = g.groupBy("series_id", "parameter").agg(F.sum("c").alias("n"), (F.avg("v") + F.var_samp("m")).alias("v"), (F.first("b") * F.var_samp("m")).alias("s"))
    return o.select("series_id", "parameter", F.when(F.col("s") > 0, F.least(F.col("n"), F.col("n") * F.col("v") / F.col("s"))).alias("ess"))


def posterior(chains: DataFrame, max_r_hat: float = 1.01, min_ess: float = 400.0, band: tuple[float, float] = (0.15, 0.40)) -> DataFrame:
    """Moments and, if all of a series' parameters pass R-hat, effective draws and the rate of acceptance, quantiles."""
    p = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    g = chains.groupBy("series_id", "parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), p.alias("_p"), F.avg("acceptance").alias("acceptance"))
    g = g.join(split_r_hat(chains), ["series_id", "parameter"], "left").join(effective_draws(chains), ["series_id", "parameter"], "left")
    ok = F.coalesce((F.col("r_hat") <= max_r_hat) & (F.col("ess") >= min_ess) & F.col("acceptance").between(*band), F.lit(False))
    g = g.withColumn("accepted", F.min(ok).over(W.partitionBy("series_id")))
    q = [F.when(F.col("accepted"), F.col("_p")[k]).alias(name) for k, name in enumerate(("low", "median", "high"))]
    return g.select("series_id", "parameter", "mean", "sd", *q, "r_hat", "ess", "acceptance", "accepted")
