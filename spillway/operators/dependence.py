"""Serial dependence: autocorrelation, effective size, long memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import norm_ppf, num
from .series import ordered, sized


def _lagged(series: DataFrame, lags: int) -> DataFrame:
    """Deviations with every earlier one up to `lags` blocks back: one window, no self-join."""
    df = series.withColumns({"d": F.col("q") - F.avg("q").over(sized()), "n": F.count(F.lit(1)).over(sized())})
    back = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("d", k).over(ordered()).alias("e")) for k in range(1, lags + 1)])
    return df.withColumn("_b", back)


def acf(series: DataFrame, lags: int = 15) -> DataFrame:
    """r_k = sum d_t d_(t-k) / sum d^2 * n / (n - k), for lags up to n // 4 and `lags`; null for a constant series."""
    df = _lagged(series, lags)
    whole = df.groupBy("series_id").agg(F.max("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    part = df.select("series_id", "d", F.inline("_b")).filter("e is not null").groupBy("series_id", "lag").agg(F.sum(F.col("d") * F.col("e")).alias("s"))
    out = part.join(whole, "series_id").filter(F.col("lag") <= F.greatest(F.floor(F.col("n") / 4), F.lit(1)))
    biased = F.when(F.col("ss") > 0, F.col("s") / F.col("ss"))
    return out.select("series_id", "lag", "n", (biased * F.col("n") / (F.col("n") - F.col("lag"))).alias("r"), biased.alias("r_biased"))


def acf_table(series: DataFrame, lags: int = 15, alpha: float = 0.05) -> DataFrame:
    """The ACF with its white-noise band z / sqrt(n)."""
    z = F.expr(norm_ppf(num(1 - alpha / 2)))
    return acf(series, lags).withColumn("band", z / F.sqrt("n")).withColumn("inside", F.abs("r") <= F.col("band"))


def residual_acf(residuals: DataFrame, lags: int = 15, alpha: float = 0.05) -> DataFrame:
    """acf_table() of the normal scores z of each series and family, what a fit leaves: series_id, family, t, z."""
    key = F.to_json(F.struct("series_id", "family"))
    named = residuals.select(key.alias("series_id"), "t", F.col("z").alias("q")).dropna()
    out = acf_table(named, lags, alpha).withColumn("_k", F.from_json("series_id", "series_id string, family string"))
    return out.select("_k.series_id", "_k.family", *[c for c in out.columns if c not in ("series_id", "_k")])


def pacf(series: DataFrame, lags: int = 15) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion over each series' ACF array.

    The recursion runs inside the row as a fold: the state is the current coefficients and the results so far.
    """
    r = acf(series, lags).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda x: x["r"]).alias("r"))
    fold = """
      aggregate(sequence(1, size(r)), named_struct('phi', cast(array() as array<double>), 'out', cast(array() as array<double>)), (a, k) ->
        transform(array(
          try_divide(element_at(r, k) - coalesce(aggregate(sequence(1, greatest(k - 1, 1)), cast(0 as double), (s, j) -> s + if(k > 1, element_at(a.phi, j) * element_at(r, k - j + if(k > 1, 0, 1)), 0D)), 0D),
                     1 - coalesce(aggregate(sequence(1, greatest(k - 1, 1)), cast(0 as double), (s, j) -> s + if(k > 1, element_at(a.phi, j) * element_at(r, j), 0D)), 0D))),
          p -> named_struct(
            'phi', concat(if(k > 1, transform(a.phi, (x, i) -> x - p * element_at(a.phi, k - 1 - i)), cast(array() as array<double>)), array(p)),
            'out', concat(a.out, array(p))))[0], a -> a.out)"""
    return r.select("series_id", F.posexplode(F.expr(fold)).alias("_i", "pacf")).select("series_id", (F.col("_i") + 1).alias("lag"), "pacf")


def effective_size(series: DataFrame, lags: int = 15) -> DataFrame:
    """Integrated autocorrelation time by Geyer's initial positive sequence, and the effective sizes n/tau and n(1-r1)/(1+r1)."""
    a = acf(series, lags)
    pair = a.withColumn("_m", F.floor((F.col("lag") - 1) / 2)).groupBy("series_id", "_m").agg(F.sum("r").alias("_pair"), F.count(F.lit(1)).alias("_c")).filter("_c = 2")
    still = F.min(F.when(F.col("_pair") > 0, 1).otherwise(0)).over(W.partitionBy("series_id").orderBy("_m").rowsBetween(W.unboundedPreceding, W.currentRow))
    tau = pair.withColumn("_on", still).groupBy("series_id").agg((1 + 2 * F.sum(F.when(F.col("_on") == 1, F.col("_pair")).otherwise(0.0))).alias("tau"))
    one = a.filter("lag = 1").select("series_id", "n", F.col("r").alias("r1"))
    out = one.join(tau, "series_id", "left").withColumn("tau", F.greatest(F.coalesce("tau", F.lit(1.0)), F.lit(1.0)))
    out = out.withColumns({"n_r1": F.col("n") * F.try_divide(1 - F.col("r1"), 1 + F.col("r1")), "n_tau": F.col("n") / F.col("tau")})
    return out.withColumn("n_effective", F.least("n_r1", "n_tau", F.col("n").cast("double")))


def first_exceedance(series: DataFrame, lags: int = 15, alpha: float = 0.05) -> DataFrame:
    """How many lags from the first lie outside the band without a break; and the sum of the ACF up to its first negative lag."""
    a = acf_table(series, lags, alpha)
    g = a.groupBy("series_id").agg(F.min(F.when(F.col("inside"), F.col("lag"))).alias("_in"), F.min(F.when(F.col("r") < 0, F.col("lag"))).alias("_neg"), F.max("lag").alias("_last"))
    total = a.join(g, "series_id").filter(F.col("lag") < F.coalesce("_neg", F.col("_last") + 1)).groupBy("series_id").agg(F.sum("r").alias("acf_sum"))
    return g.join(total, "series_id", "left").select("series_id", (F.coalesce("_in", F.col("_last") + 1) - 1).alias("exceedance_lag"), F.coalesce("acf_sum", F.lit(0.0)).alias("acf_sum"))


def cross_correlation(a: DataFrame, b: DataFrame, lags: int = 5) -> DataFrame:
    """corr(a_t, b_(t-k)) for k from 0, normalised by the whole series; a and b share series_id and t."""
    both = a.select("series_id", "t", F.col("q").alias("x")).join(b.select("series_id", "t", F.col("q").alias("y")), ["series_id", "t"])
    w = W.partitionBy("series_id")
    both = both.withColumns({"dx": F.col("x") - F.avg("x").over(w), "dy": F.col("y") - F.avg("y").over(w)})
    both = both.withColumn("_b", F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("dy", k).over(ordered()).alias("e")) for k in range(lags + 1)]))
    whole = both.groupBy("series_id").agg(F.sqrt(F.sum(F.col("dx") ** 2) * F.sum(F.col("dy") ** 2)).alias("s"))
    part = both.select("series_id", "dx", F.inline("_b")).filter("e is not null").groupBy("series_id", "lag").agg(F.sum(F.col("dx") * F.col("e")).alias("c"))
    return part.join(whole, "series_id").select("series_id", "lag", F.try_divide("c", "s").alias("r"))


def variogram(series: DataFrame, lags: int = 14, cumulative: bool = True) -> DataFrame:
    """V(k) = mean (x_(t+k) - x_t)^2 / 2 of the cumulative deviations (or of the series itself), and its log slope / 2."""
    w = ordered()
    df = series.withColumn("x", F.col("q") - F.avg("q").over(sized()))
    if cumulative:
        df = df.withColumn("x", F.sum("x").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead("x", k).over(w) - F.col("x")).alias("d")) for k in range(1, lags + 1)])
    df = df.withColumn("_p", pairs).select("series_id", F.inline("_p")).filter("d is not null")
    return df.groupBy("series_id", "lag").agg((F.avg(F.col("d") * F.col("d")) / 2).alias("v"))


def hurst(series: DataFrame, lags: int = 14, cumulative: bool = True) -> DataFrame:
    v = variogram(series, lags, cumulative).filter("lag >= 2 and v > 0")
    return v.groupBy("series_id").agg((F.regr_slope(F.log("v"), F.log(F.col("lag").cast("double"))) / 2).alias("hurst"), F.count(F.lit(1)).alias("lags"))


def rescaled_range(series: DataFrame, sizes: tuple[int, ...] = (5, 8, 10, 15)) -> DataFrame:
    """Mean range of cumulative deviations within blocks of m, by the block's sd; hurst_rs() takes its slope."""
    df = series.withColumn("m", F.explode(F.array(*[F.lit(m) for m in sizes]))).withColumn("g", F.floor((F.col("t") - 1) / F.col("m")))
    by = W.partitionBy("series_id", "m", "g")
    df = df.withColumns({"d": F.col("q") - F.avg("q").over(by), "c": F.count(F.lit(1)).over(by), "s": F.stddev_pop("q").over(by)}).filter("c = m and s > 0")
    df = df.withColumn("y", F.sum("d").over(by.orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)))
    one = df.groupBy("series_id", "m", "g").agg(((F.greatest(F.max("y"), F.lit(0.0)) - F.least(F.min("y"), F.lit(0.0))) / F.max("s")).alias("rs"))
    return one.groupBy("series_id", "m").agg(F.avg("rs").alias("rs"), F.count(F.lit(1)).alias("blocks"))


def hurst_rs(series: DataFrame, sizes: tuple[int, ...] = (5, 8, 10, 15)) -> DataFrame:
    """The slope of the logarithm of the rescaled range over that of the block size."""
    r = rescaled_range(series, sizes).filter("rs > 0")
    return r.groupBy("series_id").agg(F.regr_slope(F.log("rs"), F.log(F.col("m").cast("double"))).alias("hurst"), F.count(F.lit(1)).alias("sizes"))
