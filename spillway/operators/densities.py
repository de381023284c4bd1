"""Kernel densities of series of any length, and the densities of fitted laws beside them.

Values are shared linearly between the two nearest of FINE cells of the series' range, which a partial aggregation does, so
a series sends at most FINE rows on; the kernel is then summed over the cells that are not empty. That differs from the sum over all values by
about (cell / bandwidth)^2 / 8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import pearson3_steps
from .frequency import staged
from .moments import log_moments, moment_coefficients

#: Cells that values are binned to, and points at which the density is given.
FINE, POINTS = 4096, 400


def _value(log: bool) -> Column:
    return F.log("q") if log else F.col("q")


def density(series: DataFrame, points: int = POINTS, log: bool = True, adjust: float = 1.0) -> DataFrame:
    """series_id, i, x, q, density and ecdf on an even grid of the range of ln q (or of q), by a Gaussian kernel of Scott's width.

    ecdf is the share of values of at most x. Values that are not positive are left out of ln q; a series without spread has no rows.
    """
    df = series.select("series_id", "q").dropna()
    df = (df.filter("q > 0") if log else df).select("series_id", _value(log).alias("_v"))
    g = df.groupBy("series_id").agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.stddev_samp("_v").alias("sd"))
    g = g.withColumn("h", adjust * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).filter("h > 0")
    df = df.join(g, "series_id").withColumn("_p", (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (FINE - 1))
    c = F.least(F.floor("_p"), F.lit(FINE - 2)).cast("int")
    shares = F.array(F.struct(c.alias("cell"), (1 - (F.col("_p") - c)).alias("w")), F.struct((c + 1).alias("cell"), (F.col("_p") - c).alias("w")))
    cells = df.select("series_id", F.inline(shares)).groupBy("series_id", "cell").agg(F.sum("w").alias("w")).filter("w > 0")
    span = F.col("hi") - F.col("lo")
    grid = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + span * F.col("i") / (points - 1))
    k = F.exp(-0.5 * F.pow((F.col("x") - (F.col("lo") + span * F.col("cell") / (FINE - 1))) / F.col("h"), F.lit(2.0)))
    out = grid.join(cells, "series_id").groupBy("series_id", "i").agg(F.first("x").alias("x"), (F.sum(F.col("w") * k) / (F.first("n") * F.first("h") * F.sqrt(2 * F.pi()))).alias("density"))
    # The first point of the grid that is not below a value; the points beside the computed one settle what rounding may have shifted.
    near = F.ceil((F.col("_v") - F.col("lo")) / span * (points - 1)).cast("int")
    at = lambda i: F.col("lo") + span * i / (points - 1)
    first = F.when(at(near - 1) >= F.col("_v"), near - 1).when(at(near) >= F.col("_v"), near).otherwise(near + 1)
    counts = df.select("series_id", "n", F.least(F.greatest(first, F.lit(0)), F.lit(points - 1)).alias("i")).groupBy("series_id", "n", "i").agg(F.count(F.lit(1)).alias("c"))
    upto = W.partitionBy("series_id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    share = F.sum(F.coalesce("c", F.lit(0))).over(upto) / F.max("n").over(W.partitionBy("series_id"))
    out = out.join(counts, ["series_id", "i"], "left").withColumn("ecdf", share)
    return out.select("series_id", "i", "x", (F.exp("x") if log else F.col("x")).alias("q"), "density", "ecdf")


def density_summary(series: DataFrame) -> DataFrame:
    """What to judge a density of ln q by: n, adjusted skew and excess kurtosis, bandwidth, and the mode on the grid."""
    d = density(series).groupBy("series_id").agg(F.max_by("x", F.struct(F.round("density", 9), -F.col("i"))).alias("mode_log"))
    m = moment_coefficients(series, log=True).select("series_id", "n", "skew", F.col("kurtosis_adjusted").alias("kurtosis"), (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"))
    return m.join(d, "series_id").withColumn("mode", F.exp("mode_log"))


def density_comparison(series: DataFrame, points: int = POINTS) -> DataFrame:
    """series_id, i, q and, on the scale of q, the kernel density, the log-Pearson III density by moments and the normal one."""
    own = series.groupBy("series_id").agg(F.avg("q").alias("mean"), F.stddev_samp("q").alias("sd"))
    fits = log_moments(series).filter("sd_log > 0 AND skew_log IS NOT NULL").select("series_id", "mean_log", "sd_log", "skew_log")
    df = density(series, points, log=False).filter("q > 0").select("series_id", "i", "q", F.col("density").alias("kernel")).join(own, "series_id").join(fits, "series_id").withColumn("y", F.log("q"))
    df = staged(df, pearson3_steps("y", "mean_log", "sd_log", "skew_log", "w"))
    normal = F.exp(-0.5 * F.pow((F.col("q") - F.col("mean")) / F.col("sd"), F.lit(2.0))) / (F.col("sd") * F.sqrt(2 * F.pi()))
    return df.select("series_id", "i", "q", "kernel", (F.col("w_pdf") / F.col("q")).alias("log_pearson3"), normal.alias("normal"))
