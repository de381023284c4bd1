"""Series in canonical form (series_id, t, block, q) and their order statistics; every operator runs per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Return periods of every design table, in blocks.
PERIODS = (2, 5, 10, 25, 50, 100, 200, 500, 1000)
#: Plotting positions (m - a) / (n + b).
POSITIONS = {"weibull": (0.0, 1.0), "hazen": (0.5, 0.0), "gringorten": (0.44, 0.12), "gringorten_ref": (0.44, 0.0), "cunnane": (0.4, 0.2)}


def block_maxima(rows: DataFrame, series: str, ts: str, value: str, unit: str, positive: bool = True) -> DataFrame:
    """The largest value of each block of time and series, as (series_id, t, block, q); null values and times are left out."""
    rows = rows.select(F.col(series).cast("string").alias("series_id"), F.date_trunc(unit, ts).alias("block"), F.col(value).cast("double").alias("q"))
    rows = rows.dropna().filter(~F.isnan("q"))
    if positive:
        rows = rows.filter("q > 0")
    return numbered(rows.groupBy("series_id", "block").agg(F.max("q").alias("q")))


def block_counts(rows: DataFrame, series: str, ts: str, value: str, unit: str) -> DataFrame:
    """Observations and largest value per series and block."""
    return rows.groupBy(F.col(series).alias("series_id"), F.date_trunc(unit, ts).alias("block")).agg(F.count(value).alias("n_peaks"), F.max(value).alias("q"))


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("t", F.row_number().over(W.partitionBy("series_id").orderBy("block"))).select("series_id", "t", "block", "q")


def ordered() -> object:
    return W.partitionBy("series_id").orderBy("t")


def sized() -> object:
    return W.partitionBy("series_id")


def plotting_position(m: Column, n: Column, method: str = "weibull") -> Column:
    if method not in POSITIONS:
        raise KeyError(method)
    a, b = POSITIONS[method]
    return (m - F.lit(a)) / (n + F.lit(b))


def ranked(series: DataFrame) -> DataFrame:
    """Adds rank (1 the least; ties by t) and n."""
    return series.withColumn("rank", F.row_number().over(W.partitionBy("series_id").orderBy("q", "t"))).withColumn("n", F.count(F.lit(1)).over(sized()))


def probabilities(series: DataFrame) -> DataFrame:
    """Ranks, the four plotting positions, exceedance, return period and ln q."""
    df = ranked(series)
    p = {f"p_{m}": plotting_position(F.col("rank"), F.col("n"), m) for m in ("weibull", "hazen", "gringorten", "cunnane")}
    df = df.withColumns(p).withColumn("p_exceed", 1 - F.col("p_weibull"))
    return df.withColumn("return_period", 1 / F.col("p_exceed")).withColumn("log_q", F.when(F.col("q") > 0, F.log("q")))


def calendar(series: DataFrame) -> DataFrame:
    """Month, day of the year, season and decade of each block."""
    month = F.month("block")
    season = F.when(month.between(6, 9), "southwest_monsoon").when(month.between(10, 12), "post_monsoon").when(month.between(3, 5), "pre_monsoon").otherwise("winter")
    decade = F.concat((F.floor(F.year("block") / 10) * 10).cast("int").cast("string"), F.lit("s"))
    return series.withColumns({"month": month, "doy": F.dayofyear("block"), "season": season, "is_monsoon": month.between(6, 9), "decade": decade})


def ecdf(series: DataFrame) -> DataFrame:
    """Each order statistic's share at or below and above it; ties keep rows of their own."""
    df = ranked(series)
    return df.select("series_id", "rank", "q", (F.col("rank") / F.col("n")).alias("f"), (1 - F.col("rank") / F.col("n")).alias("exceed"))


def order_guard(series: DataFrame) -> DataFrame:
    """Per series whether its values only rise in time (at least four), as a sorted input to a time test would."""
    df = series.withColumn("_falls", (F.col("q") < F.lag("q").over(ordered())).cast("int"))
    return df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_falls"), F.lit(0)).alias("n_falls")).withColumn("looks_sorted", (F.col("n") >= 4) & (F.col("n_falls") == 0))


def require_time_order(series: DataFrame) -> DataFrame:
    """The series, or an error at run time if one looks sorted by value; no action of its own."""
    falls = F.sum((F.col("q") < F.col("_before")).cast("int")).over(sized())
    df = series.withColumn("_before", F.lag("q").over(ordered())).withColumn("_ok", (F.count(F.lit(1)).over(sized()) < 4) | (falls > 0))
    return df.filter(F.when(F.col("_ok"), F.lit(True)).otherwise(F.raise_error(F.lit("a time test needs the series in time order"))).cast("boolean")).drop("_before", "_ok")


def synthetic(spark, n: int, seed: int = 1, loc: float = 100.0, scale: float = 20.0, series_id: str = "synthetic") -> DataFrame:
    """A Gumbel series from hashed uniforms, the same for any partitioning; values are shifted to be positive."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**31)).cast("double") + 0.5) / float(2**31)
    q = F.greatest(F.lit(loc) - F.lit(scale) * F.log(-F.log(u)), F.lit(1e-6))
    return spark.range(n).select(F.lit(series_id).alias("series_id"), (F.col("id") + 1).cast("int").alias("t"), F.timestamp_seconds(F.col("id") * 86400).alias("block"), q.alias("q"))


def class_of_value(series: DataFrame) -> DataFrame:
    """Three classes by the record's 75th and 90th percentiles, and three of the standard anomaly."""
    cut = series.groupBy("series_id").agg(F.percentile("q", F.array(F.lit(0.75), F.lit(0.9))).alias("_p"), F.avg("q").alias("_m"), F.stddev_samp("q").alias("_s"))
    df = series.join(cut, "series_id")
    z = F.when(F.col("_s") > 0, (F.col("q") - F.col("_m")) / F.col("_s"))
    high = F.when(F.col("q") >= F.col("_p")[1], "high").when(F.col("q") >= F.col("_p")[0], "raised").otherwise("usual")
    anomaly = F.when(z >= 1.5, "extreme").when(z >= 0, "above").otherwise("below")
    return df.select("series_id", "t", "q", high.alias("value_class"), z.alias("z"), anomaly.alias("anomaly_class"), (F.abs(z) > 1.645).alias("exceeds_90"))
