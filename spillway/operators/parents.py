"""Samples from any fitted law by inverse distribution functions of hashed uniforms, and intervals from them.

Seven of the nine families have closed inverses, which are one Column expression. Those of log-Pearson III and the
generalised normal law are read from NODES exact values between normal scores of -EDGE and EDGE, one array a fit, by linear
interpolation, so a draw costs the same for every family and no draw is joined with anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import hash_bits, norm_cdf, norm_ppf, num
from .frequency import periods
from .kernels import family_quantile
from .resampling import case_resamples, percentile_interval, quantile_replicates, series_number
from .series import PERIODS, ranked

NODES, EDGE = 1025, 6.5
#: Families whose inverse has no closed form.
TABLED = ("lp3", "gnormal")


def with_nodes(fits: DataFrame) -> DataFrame:
    """fits (series_id, family, p1, p2, p3) with nodes: quantiles at even normal scores for the families without closed inverse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = [0.5 * math.erfc(-z / math.sqrt(2)) for z in np.linspace(-EDGE, EDGE, NODES)]
        for pdf in batches:
            p = zip(pdf["family"], pdf["p1"], pdf["p2"], pdf["p3"], strict=True)
            yield pdf[["series_id", "family"]].assign(nodes=[[family_quantile(f, [a, b, c], u) for u in at] for f, a, b, c in p])

    tabled = fits.filter(F.col("family").isin(*TABLED) & F.col("p3").isNotNull()).select("series_id", "family", "p1", "p2", "p3")
    nodes = tabled.mapInPandas(run, "series_id string, family string, nodes array<double>")
    return fits.join(nodes, ["series_id", "family"], "left")


def with_quantile(df: DataFrame, name: str) -> DataFrame:
    """df (family, p1, p2, p3, nodes and a non-exceedance u) with column name: the law's quantile at u, null where a parameter is missing."""
    cases = {
        "gumbel": "p1 - p2 * ln(-ln(u))",
        "ln2": "exp(p1 + p2 * _z)",
        "gev": "CASE WHEN abs(p3) < 1e-9D THEN p1 - p2 * ln(-ln(u)) ELSE p1 + p2 / p3 * (1 - power(-ln(u), p3)) END",
        "weibull": "p1 * power(-ln(1 - u), 1 / p2)",
        "exponential": "-p1 * ln(1 - u)",
        "glogistic": "p1 - p2 * ln(power(u, -1 / p3) - 1)",
        "loglogistic": "p1 * power(u / (1 - u), 1 / p2)",
    }
    text = " ".join(f"WHEN family = '{k}' THEN {v}" for k, v in cases.items())
    lower = "element_at(nodes, least(cast(floor(_at) as int) + 1, size(nodes)))"
    upper = "element_at(nodes, least(cast(floor(_at) as int) + 2, size(nodes)))"
    df = df.withColumn("_z", F.expr(norm_ppf("u"))).withColumn("_at", F.expr(f"least(greatest((_z + {EDGE}D) / {2 * EDGE}D * {NODES - 1}, 0D), {NODES - 1}D)"))
    return df.withColumn(name, F.expr(f"CASE {text} WHEN nodes IS NOT NULL THEN {lower} + (_at - floor(_at)) * ({upper} - {lower}) END")).drop("_z", "_at")


def samples(fits: DataFrame, reps: int = 2000, seed: int = 20250104) -> DataFrame:
    """fits: series_id, family, n, p1, p2, p3. series_id, family, rep, t and q of `reps` records of n values from each law."""
    u = f"((({hash_bits('rep', 't', f'{seed} + sid', '(({0}) ^ ({1}))', 'shiftright({0}, {1})')}) + 0.5D) / 2147483648.0D)"
    df = with_nodes(fits.select("series_id", "family", F.col("n").cast("long").alias("n"), *[F.col(p).cast("double").alias(p) for p in ("p1", "p2", "p3")]).filter("p1 IS NOT NULL AND n > 0"))
    zero = F.lit(0).cast("long")
    df = df.withColumn("sid", series_number()).withColumn("rep", F.explode(F.sequence(zero, F.lit(reps - 1).cast("long"))))
    # The uniforms are made as an array and then spread, so that the planner does not repeat their text where they are used.
    df = df.withColumn("us", F.expr(f"transform(sequence(0L, n - 1), t -> {u})")).select("*", F.posexplode("us").alias("t", "u")).drop("us")
    return with_quantile(df, "q").select("series_id", "family", "rep", "t", "q")


def points(fits: DataFrame) -> DataFrame:
    """series_id, family, period and the law's own value, point."""
    df = periods(with_nodes(fits.select("series_id", "family", "p1", "p2", "p3").filter("p1 IS NOT NULL"))).withColumn("u", 1 - 1 / F.col("period"))
    return with_quantile(df, "point").select("series_id", "family", "period", "point")


def qq_points(series: DataFrame, fits: DataFrame) -> DataFrame:
    """series_id, family, rank, q and fitted: each order statistic beside the quantile of each law at rank / (n + 1)."""
    law = with_nodes(fits.filter("p1 IS NOT NULL").select("series_id", "family", "p1", "p2", "p3"))
    df = ranked(series).select("series_id", "rank", "n", "q").join(law, "series_id").withColumn("u", F.col("rank") / (F.col("n") + 1))
    return with_quantile(df, "fitted").select("series_id", "family", "rank", "q", "fitted")


def replicates(drawn: DataFrame) -> DataFrame:
    """The empirical T-value of every simulated record: series_id, family, rep, period, q."""
    p = F.array(*[F.lit(1 - 1 / t) for t in PERIODS])
    g = drawn.groupBy("series_id", "family", "rep").agg(F.percentile("q", p).alias("_p"))
    return g.select("series_id", "family", "rep", F.inline(F.array(*[F.struct(F.lit(float(t)).alias("period"), F.col("_p")[k].alias("q")) for k, t in enumerate(PERIODS)])))


def intervals(fits: DataFrame, reps: int = 2000, level: float = 0.95) -> DataFrame:
    """Percentile and bias-corrected limits of every law's return values, the law held fixed and only the record varied."""
    a = (1 - level) / 2
    sim, law = replicates(samples(fits, reps)), points(fits)
    g = sim.groupBy("series_id", "family", "period").agg(F.percentile("q", F.array(F.lit(a), F.lit(1 - a))).alias("_p"))
    return law.join(g, ["series_id", "family", "period"]).select("series_id", "family", "period", "point", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def ln2_fits(series: DataFrame) -> DataFrame:
    """The two-parameter log-normal law by the mean and sample sd of ln q."""
    g = series.filter("q > 0").groupBy("series_id").agg(F.count("q").alias("n"), F.avg(F.log("q")).alias("p1"), F.stddev_samp(F.log("q")).alias("p2"))
    return g.filter("p2 > 0").select("series_id", F.lit("ln2").alias("family"), "n", "p1", "p2", F.lit(None).cast("double").alias("p3"))


def combined(series: DataFrame, fits: DataFrame, reps: int = 2000, level: float = 0.95) -> DataFrame:
    """One row a period of fits (one family a series): the law's value with bias-corrected, percentile and case-resampled limits.

    The case-resampled limits cannot exceed the record's greatest value.
    """
    keys, z = ["series_id", "period"], num(NormalDist().inv_cdf(0.5 + level / 2))
    law = points(fits).select(*keys, "point")
    sim = replicates(samples(fits, reps)).groupBy(*keys).agg(F.sort_array(F.collect_list("q")).alias("qs"))  # `reps` values
    df = sim.join(law, keys).withColumn("m", F.size("qs")).withColumn("share", F.expr("(size(filter(qs, q -> q < point)) + 0.5D) / (m + 1)"))
    # Each step is spread from an array of one, so that the planner does not repeat the text of the step before.
    step = lambda df, name, text: df.select("*", F.explode(F.array(F.expr(text))).alias(name))
    df = step(step(step(df, "z0", norm_ppf("share")), "lo", norm_cdf(f"(2 * z0 - {z})")), "hi", norm_cdf(f"(2 * z0 + {z})"))
    at = lambda p: F.expr(f"element_at(qs, cast(least(greatest(ceil({p} * m), 1), m) as int))")
    linear = lambda p: F.expr(f"element_at(qs, cast(floor({p}D * (m - 1)) as int) + 1) + ({p}D * (m - 1) - floor({p}D * (m - 1))) * (element_at(qs, cast(ceil({p}D * (m - 1)) as int) + 1) - element_at(qs, cast(floor({p}D * (m - 1)) as int) + 1))")
    a = (1 - level) / 2
    df = df.select(*keys, "point", at("lo").alias("ci_low"), at("hi").alias("ci_high"), linear(round(a, 12)).alias("percentile_low"), linear(round(1 - a, 12)).alias("percentile_high"))
    cases = percentile_interval(quantile_replicates(case_resamples(series, reps)), level).select(*keys, F.col("low").alias("case_low"), F.col("high").alias("case_high"))
    return df.join(cases, keys).withColumn("relative_width", (F.col("ci_high") - F.col("ci_low")) / F.greatest(F.abs("point"), F.lit(1e-9)))


def ln2_intervals(series: DataFrame, reps: int = 2000, level: float = 0.95) -> DataFrame:
    return combined(series, ln2_fits(series), reps, level)
