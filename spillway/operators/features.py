"""Lag and rolling features of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .series import ordered, sized


def lag_features(series: DataFrame, lags: tuple[int, ...] = (1, 2, 3), window: int = 5) -> DataFrame:
    """Lags, rolling mean, sd, least and greatest of the past window, and the mean of all the past (three at least).

    Every frame ends at the row before, so no feature can know its own target; rows without all features are left out.
    """
    w = ordered()
    past, all_past = w.rowsBetween(-window, -1), w.rowsBetween(W.unboundedPreceding, -1)
    full = F.count("q").over(past) == window
    cols = {f"lag_{k}": F.lag("q", k).over(w) for k in lags}
    cols |= {name: F.when(full, f("q").over(past)) for name, f in (("roll_mean", F.avg), ("roll_sd", F.stddev_samp), ("roll_min", F.min), ("roll_max", F.max))}
    cols["past_mean"] = F.when(F.count("q").over(all_past) >= 3, F.avg("q").over(all_past))
    df = series.select("series_id", "t", "q").withColumns(cols)
    return df.dropna(subset=list(cols))


def lag_pairs(series: DataFrame, lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(lag, t, x, y) with y the value lag blocks later."""
    df = series.withColumn("_y", F.array(*[F.struct(F.lit(k).alias("lag"), F.lead("q", k).over(ordered()).alias("y")) for k in lags]))
    return df.select("series_id", "t", F.col("q").alias("x"), F.inline("_y")).filter("y is not null").select("series_id", "lag", "t", "x", "y")


def centred(series: DataFrame) -> DataFrame:
    """Centred rolling mean and sd over 5, mean and variance over 10, null until full."""
    w = ordered()
    five, ten = w.rowsBetween(-2, 2), w.rowsBetween(-5, 4)
    f5, f10 = F.count("q").over(five) == 5, F.count("q").over(ten) == 10
    return series.select("series_id", "t", "q", F.when(f5, F.avg("q").over(five)).alias("mean5"), F.when(f5, F.stddev_samp("q").over(five)).alias("sd5"), F.when(f10, F.avg("q").over(ten)).alias("mean10"), F.when(f10, F.var_samp("q").over(ten)).alias("var10"))


def year_on_year(series: DataFrame) -> DataFrame:
    """The change from the block before, by the current value; the first row compares with itself."""
    before = F.coalesce(F.lag("q").over(ordered()), F.col("q"))
    return series.select("series_id", "t", "q", F.try_divide(F.abs(F.col("q") - before), F.col("q")).alias("jump"))


def correlations(features: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of feature columns per series, lower triangle, long."""
    names = [c for c in features.columns if c not in ("series_id", "t")]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    g = features.groupBy("series_id").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = g.unpivot("series_id", [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select("series_id", F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def spearman_lag1(series: DataFrame) -> DataFrame:
    """Rank correlation (average ranks) of each value with the next."""
    df = lag_pairs(series, (1,))
    avg_rank = lambda c: F.rank().over(W.partitionBy("series_id").orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("series_id", c)) - 1) / 2
    df = df.withColumns({"_rx": avg_rank("x"), "_ry": avg_rank("y")})
    return df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def persistence(series: DataFrame) -> DataFrame:
    """Root mean square error of predicting each value by the one before."""
    d = F.col("q") - F.lag("q").over(ordered())
    return series.withColumn("_d", d).groupBy("series_id").agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"))


def scores(predictions: DataFrame) -> DataFrame:
    """predictions: series_id, y, p, and baseline (a prediction to compare with). rmse, mae, bias, r2, skill."""
    e = F.col("p") - F.col("y")
    df = predictions.withColumn("_m", F.avg("y").over(sized()))
    g = df.groupBy("series_id").agg(F.count("y").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sum(e * e).alias("_sse"), F.sum(F.pow(F.col("y") - F.col("_m"), F.lit(2.0))).alias("_sst"), F.sqrt(F.avg(F.pow(F.col("baseline") - F.col("y"), F.lit(2.0)))).alias("rmse_baseline"), F.stddev_samp("y").alias("_sd"))
    return g.select("series_id", "n", "rmse", "mae", "bias", (1 - F.try_divide("_sse", "_sst")).alias("r2"), F.try_divide("rmse", "_sd").alias("nrmse"), "rmse_baseline", (1 - F.try_divide("rmse", "rmse_baseline")).alias("skill"))


def folds(features: DataFrame, k: int = 5) -> DataFrame:
    """Expanding time splits: test blocks of n // (k + 1) rows at the end, each trained on all rows before. Long by fold."""
    df = features.withColumn("_i", F.row_number().over(ordered()) - 1).withColumn("_n", F.count(F.lit(1)).over(sized()))
    size = F.floor(F.col("_n") / (k + 1))
    df = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    begin = F.col("_n") - (k - F.col("fold")) * size
    role = F.when(F.col("_i") < begin, "train").when(F.col("_i") < begin + size, "test")
    return df.withColumn("role", role).filter("role is not null").drop("_i", "_n")


def linear_forecast(series: DataFrame, k: int = 5, ridge: float = 0.0) -> DataFrame:
    """Out-of-fold predictions by least squares on the previous value, standardised, from sums alone.

    One feature keeps the normal equations a ratio of sums: a fold is fitted by an aggregate, not by a job of its own.
    """
    df = folds(series.select("series_id", "t", "q", F.lag("q").over(ordered()).alias("x")).dropna(), k)
    train = df.filter("role = 'train'").groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("q").alias("my"), F.var_pop("x").alias("vx"), F.covar_pop("x", "q").alias("cxy"))
    slope = F.try_divide(F.col("cxy"), F.col("vx") * (1 + F.lit(ridge) / F.col("n")))
    both = df.filter("role = 'test'").join(train.withColumn("slope", F.coalesce(slope, F.lit(0.0))), ["series_id", "fold"])
    return both.select("series_id", "fold", "t", F.col("q").alias("y"), (F.col("my") + F.col("slope") * (F.col("x") - F.col("mx"))).alias("p"), F.col("x").alias("baseline"))
