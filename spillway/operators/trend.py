"""Tests of trend, change, randomness and normality, per series in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import chi2_sf, norm_cdf, norm_ppf, norm_sf2, num, student_steps
from .dependence import acf
from .frequency import staged
from .inversions import kendall_counts, kendall_law, slopes, spearman_law
from .moments import moment_coefficients
from .series import ordered, ranked, sized


def _p(z: Column) -> Column:
    return F.expr(norm_sf2("z"))


def mann_kendall(series: DataFrame) -> DataFrame:
    """S, its variance corrected for ties, z with continuity correction, two-sided p and tau-b; S by counting inversions."""
    df = kendall_counts(series, unique_x=True)
    n = F.col("n")
    df = df.withColumn("var_s", (n * (n - 1) * (2 * n + 5) - F.col("vy")) / 18).filter("n > 1")
    df = df.withColumn("z", F.when(F.col("var_s") > 0, (F.col("s") - F.signum("s")) / F.sqrt("var_s")))
    tau = F.try_divide(F.col("s"), F.sqrt((F.col("pairs") - F.col("ty")) * F.col("pairs")))
    return df.select("series_id", n.cast("long").alias("n"), "s", "var_s", "z", _p(F.col("z")).alias("p"), tau.alias("tau"))


def kendall(rows: DataFrame, x: str = "t", y: str = "q", exact: int = 30) -> DataFrame:
    """tau-b of two columns with its two-sided p: exact without ties and for n up to `exact`, else by the normal limit of S."""
    df = kendall_counts(rows, x, y).filter("n > 1").withColumn("d", ((F.col("pairs") - F.col("s")) / 2).cast("long"))
    tau = F.try_divide(F.col("s"), F.sqrt(F.col("pairs") - F.col("tx")) * F.sqrt(F.col("pairs") - F.col("ty")))
    n = F.col("n")
    whole = n * (n - 1) * (2 * n + 5)
    # The variance of S with ties on both sides; vx and its relatives only matter where x has ties.
    ties = rows.select(F.col("series_id").cast("string").alias("series_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    c = F.col("c")

    def terms(col: str, tag: str) -> DataFrame:
        g = ties.groupBy("series_id", col).agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("series_id")
        return g.agg(F.sum(c * (c - 1) * (2 * c + 5)).alias(f"v{tag}_"), F.sum(c * (c - 1)).alias(f"a{tag}_"), F.sum(c * (c - 1) * (c - 2)).alias(f"b{tag}_"))

    df = df.join(terms("x", "x"), "series_id").join(terms("y", "y"), "series_id")
    var = (whole - F.col("vx_") - F.col("vy_")) / 18 + F.try_divide(F.col("ax_") * F.col("ay_"), 2 * n * (n - 1)) + F.coalesce(F.try_divide(F.col("bx_") * F.col("by_"), 9 * n * (n - 1) * (n - 2)), F.lit(0.0))
    df = df.withColumns({"tau": tau, "var_s": var}).withColumn("z", F.when(F.col("var_s") > 0, F.col("s") / F.sqrt("var_s")))
    law = kendall_law(rows.sparkSession, exact).select(F.col("n").cast("double").alias("n"), "d", F.col("p").alias("exact"))
    df = df.join(F.broadcast(law), ["n", "d"], "left")  # a constant table
    untied = (F.col("tx") == 0) & (F.col("ty") == 0)
    p = F.when(untied & F.col("exact").isNotNull(), F.col("exact")).otherwise(_p(F.col("z")))
    return df.select("series_id", n.cast("long").alias("n"), "s", "tau", p.alias("p"), (untied & F.col("exact").isNotNull()).alias("is_exact"))


def spearman(rows: DataFrame, x: str = "t", y: str = "q") -> DataFrame:
    """Rank correlation with its two-sided p: by all permutations for up to 8 values without ties, else by Student's law."""
    rows = rows.select("series_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    rank = lambda c: F.rank().over(W.partitionBy("series_id").orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("series_id", c)) - 1) / 2
    df = rows.withColumns({"rx": rank("x"), "ry": rank("y")})
    whole = (F.col("rx") == F.floor("rx")) & (F.col("ry") == F.floor("ry"))
    g = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"), F.sum((F.col("rx") - F.col("ry")) ** 2).alias("d2"), F.count_distinct("x").alias("ux"), F.count_distinct("y").alias("uy"), F.bool_and(whole).alias("whole"))
    g = g.withColumn("untied", F.col("whole") & (F.col("ux") == F.col("n")) & (F.col("uy") == F.col("n")))
    law = spearman_law(rows.sparkSession).select(F.col("n").cast("long").alias("n"), F.col("d2").cast("double").alias("d2"), F.col("p").alias("exact"))
    g = g.filter("n > 2 AND rho IS NOT NULL").join(F.broadcast(law), ["n", "d2"], "left")  # a constant table
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("rho") ** 2, F.lit(1e-300)))
    g = g.withColumns({"t": t, "df": (F.col("n") - 2).cast("double"), "is_exact": F.col("untied") & F.col("exact").isNotNull()})
    g = staged(g, student_steps("t", "df", "student"))
    tail = F.when(F.abs("rho") >= 1 - 1e-15, 0.0).otherwise(F.col("student"))
    return g.select("series_id", "n", "rho", F.when(F.col("is_exact"), F.col("exact")).otherwise(tail).alias("p"), "is_exact")


def hamed_rao(series: DataFrame, lags: int = 10, alpha: float = 0.05) -> DataFrame:
    """Mann-Kendall with the variance corrected by the significant autocorrelations of the detrended ranks."""
    sen = theil_sen(series).select("series_id", "slope")
    left = series.join(sen, "series_id").withColumn("q", F.col("q") - F.col("slope") * F.col("t"))
    ranks = left.withColumn("q", F.rank().over(W.partitionBy("series_id").orderBy("q")) + (F.count(F.lit(1)).over(W.partitionBy("series_id", "q")) - 1) / 2)
    r = acf(ranks.select("series_id", "t", "q"), lags).withColumn("_keep", F.abs("r_biased") > F.expr(norm_ppf(num(1 - alpha / 2))) / F.sqrt("n"))
    n, k = F.col("n"), F.col("lag")
    term = (n - k) * (n - k - 1) * (n - k - 2) * F.col("r_biased")
    c = r.groupBy("series_id").agg((1 + 2 / (F.max("n") * (F.max("n") - 1) * (F.max("n") - 2)) * F.sum(F.when(F.col("_keep"), term).otherwise(0.0))).alias("inflation"))
    mk = mann_kendall(series).join(c, "series_id").withColumn("inflation", F.greatest("inflation", F.lit(1e-9)))
    mk = mk.withColumn("z", (F.col("s") - F.signum("s")) / F.sqrt(F.col("var_s") * F.col("inflation")))
    return mk.select("series_id", "n", "s", "inflation", "z", _p(F.col("z")).alias("p"))


def theil_sen(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The median pairwise slope, intercept med(q) - slope med(t), and the rank-based limits of the slope; no list of all slopes is made."""
    v = mann_kendall(series).select("series_id", "n", "var_s").withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    c = F.expr(norm_ppf(num(1 - alpha / 2))) * F.sqrt("var_s")
    low = F.greatest(F.floor((F.col("pairs") - c) / 2), F.lit(0)).cast("long")
    high = F.least(F.ceil((F.col("pairs") + c) / 2), F.col("pairs") - 1).cast("long")
    middle = [F.floor((F.col("pairs") - 1) / 2).cast("long"), F.floor(F.col("pairs") / 2).cast("long")]
    v = v.withColumn("ks", F.array(*middle, low, high))
    found = slopes(series, v.select(F.col("series_id"), "ks"))
    m = series.groupBy("series_id").agg(F.percentile("q", F.lit(0.5)).alias("mq"), F.percentile("t", F.lit(0.5)).alias("mt"))
    g = v.join(found, "series_id").join(m, "series_id").withColumn("slope", (F.get("slopes", F.lit(0)) + F.get("slopes", F.lit(1))) / 2)
    return g.select("series_id", "n", "pairs", "slope", (F.col("mq") - F.col("slope") * F.col("mt")).alias("intercept"), F.get("slopes", F.lit(2)).alias("slope_low"), F.get("slopes", F.lit(3)).alias("slope_high"))


def prewhitened(series: DataFrame) -> DataFrame:
    """Trend-free prewhitening: the Sen trend is removed, lag-one dependence taken out of the rest, the trend put back."""
    sen = theil_sen(series).select("series_id", "slope")
    r1 = acf(series.join(sen, "series_id").select("series_id", "t", (F.col("q") - F.col("slope") * F.col("t")).alias("q")), 1).select("series_id", F.col("r").alias("r1"))
    df = series.join(sen, "series_id").join(r1, "series_id").withColumn("y", F.col("q") - F.col("slope") * F.col("t"))
    df = df.withColumn("q", F.col("y") - F.col("r1") * F.lag("y").over(ordered()) + F.col("slope") * F.col("t"))
    return df.filter("q is not null").select("series_id", "t", "block", "q")


def pettitt(series: DataFrame) -> DataFrame:
    """Change point: U_k = 2 sum of ranks - k (n + 1), the first k of greatest |U_k|, p about 2 exp(-6 U^2 / (n^3 + n^2))."""
    rank = F.rank().over(W.partitionBy("series_id").orderBy("q")) + (F.count(F.lit(1)).over(W.partitionBy("series_id", "q")) - 1) / 2
    df = series.withColumns({"_r": rank, "n": F.count(F.lit(1)).over(sized())})
    u = 2 * F.sum("_r").over(ordered().rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("t") * (F.col("n") + 1)
    best = df.withColumn("u", u).groupBy("series_id").agg(F.max("n").alias("n"), F.max(F.struct(F.abs("u").alias("k"), (-F.col("t")).alias("at"))).alias("_b"))
    n = F.col("n").cast("double")
    p = F.least(F.lit(1.0), 2 * F.exp(-6 * F.pow("_b.k", F.lit(2.0)) / (F.pow(n, F.lit(3.0)) + F.pow(n, F.lit(2.0)))))
    return best.select("series_id", "n", (-F.col("_b.at")).alias("change_at"), F.col("_b.k").alias("u"), p.alias("p"))


def runs(series: DataFrame) -> DataFrame:
    """Wald-Wolfowitz runs about the median; values equal to it are left out."""
    m = series.groupBy("series_id").agg(F.percentile("q", F.lit(0.5)).alias("_m"))
    df = series.join(m, "series_id").withColumn("_s", F.signum(F.col("q") - F.col("_m"))).filter("_s <> 0")
    df = df.withColumn("_new", F.when(F.lag("_s").over(ordered()) == F.col("_s"), 0).otherwise(1))
    g = df.groupBy("series_id").agg(F.sum((F.col("_s") > 0).cast("double")).alias("n1"), F.sum((F.col("_s") < 0).cast("double")).alias("n2"), F.sum("_new").alias("runs"))
    n = F.col("n1") + F.col("n2")
    g = g.withColumns({"expected": 2 * F.col("n1") * F.col("n2") / n + 1, "variance": F.try_divide(2 * F.col("n1") * F.col("n2") * (2 * F.col("n1") * F.col("n2") - n), n * n * (n - 1))})
    g = g.withColumn("z", F.when(F.col("variance") > 0, (F.col("runs") - F.col("expected")) / F.sqrt("variance")))
    return g.select("series_id", "runs", "expected", "z", _p(F.col("z")).alias("p"))


def durbin_watson(series: DataFrame) -> DataFrame:
    """Sum of squared changes by the sum of squared deviations; z against N(2, 4/n)."""
    df = series.withColumns({"_d": F.col("q") - F.avg("q").over(sized()), "_c": F.col("q") - F.lag("q").over(ordered())})
    g = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col("_c") ** 2), F.sum(F.col("_d") ** 2)).alias("dw"))
    g = g.withColumn("z", (F.col("dw") - 2) / F.sqrt(4 / F.col("n")))
    return g.select("series_id", "n", "dw", "z", _p(F.col("z")).alias("p"))


def ljung_box(series: DataFrame, lags: int = 10) -> DataFrame:
    """Q for every number of lags, with the chi-square tail."""
    a = acf(series, lags)
    w = W.partitionBy("series_id").orderBy("lag").rowsBetween(W.unboundedPreceding, W.currentRow)
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.col("r_biased") ** 2 / (F.col("n") - F.col("lag"))).over(w)
    tail = " ".join(f"WHEN lag = {k} THEN {chi2_sf('q', k)}" for k in range(1, lags + 1))
    return a.withColumn("q", q).select("series_id", "lag", "q", F.expr(f"CASE {tail} END").alias("p"))


def jarque_bera(series: DataFrame, log: bool = False) -> DataFrame:
    c = moment_coefficients(series, log)
    jb = F.col("n") / 6 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4)
    return c.select("series_id", "n", jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def _standard(series: DataFrame, log: bool) -> DataFrame:
    x = F.log("q") if log else F.col("q")
    df = ranked(series.withColumn("_x", x))
    z = (F.col("_x") - F.avg("_x").over(sized())) / F.stddev_samp("_x").over(sized())
    return df.withColumn("z", z).withColumn("u", F.greatest(F.least(F.expr(norm_cdf("z")), F.lit(1 - 1e-12)), F.lit(1e-12)))


def anderson_darling(series: DataFrame, log: bool = False) -> DataFrame:
    """A^2 of the values standardised by their mean and sd, against the normal."""
    df = _standard(series, log)
    high = df.select("series_id", (F.col("n") + 1 - F.col("rank")).alias("rank"), F.log(1 - F.col("u")).alias("lnh"))
    both = df.join(high, ["series_id", "rank"])
    g = both.groupBy("series_id").agg(F.max("n").alias("n"), (-F.max("n") - F.avg((2 * F.col("rank") - 1) * (F.log("u") + F.col("lnh")))).alias("a2"))
    return g.withColumn("a2_adjusted", F.col("a2") * (1 + 0.75 / F.col("n") + 2.25 / F.pow("n", F.lit(2.0))))


def kolmogorov_smirnov(series: DataFrame, log: bool = False) -> DataFrame:
    """The greatest distance of the ranks from the fitted normal."""
    df = _standard(series, log)
    d = F.greatest(F.col("rank") / F.col("n") - F.col("u"), F.col("u") - (F.col("rank") - 1) / F.col("n"))
    return df.groupBy("series_id").agg(F.max("n").alias("n"), F.max(d).alias("d"))


def kpss(series: DataFrame) -> DataFrame:
    """Level stationarity: squared cumulative deviations by the Bartlett-weighted long-run variance, lags 4 (n/100)^(1/4)."""
    a = acf(series, 12)
    lags = F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(0.25)))
    lr = a.filter(F.col("lag") <= lags).groupBy("series_id").agg((1 + 2 * F.sum((1 - F.col("lag") / (lags + 1)) * F.col("r_biased"))).alias("factor"))
    d = series.withColumns({"_d": F.col("q") - F.avg("q").over(sized()), "n": F.count(F.lit(1)).over(sized())})
    d = d.withColumn("_s", F.sum("_d").over(ordered().rowsBetween(W.unboundedPreceding, W.currentRow)))
    g = d.groupBy("series_id").agg(F.max("n").alias("n"), F.sum(F.col("_s") ** 2).alias("s2"), F.avg(F.col("_d") ** 2).alias("v"))
    g = g.join(lr, "series_id", "left").withColumn("stat", F.try_divide(F.col("s2"), F.pow("n", F.lit(2.0)) * F.col("v") * F.coalesce("factor", F.lit(1.0))))
    # Critical values of the level test.
    return g.select("series_id", "n", "stat", F.when(F.col("stat") >= 0.739, 0.01).when(F.col("stat") >= 0.463, 0.05).when(F.col("stat") >= 0.347, 0.10).otherwise(1.0).alias("p_at_most"))
