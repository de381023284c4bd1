"""Quality control of series: rating curve, rule table, outlier screens, checklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import norm_ppf, t_ppf_upper
from .series import ordered, plotting_position, ranked, sized

# Dixon's r10 critical values at 5 %, two-sided, by the number of values.
DIXON_R10 = {3: 0.970, 4: 0.829, 5: 0.710, 6: 0.625, 7: 0.568, 8: 0.526, 9: 0.493, 10: 0.466, 15: 0.384, 20: 0.342, 25: 0.317, 30: 0.298}


def rating_curve(pairs: DataFrame) -> DataFrame:
    """pairs: series_id, t, q, h (stage above datum). log10 q = a + b log10 h: a, b, R^2, rmse and standard errors."""
    df = pairs.filter("q > 0 and h > 0").select("series_id", F.log10("q").alias("y"), F.log10("h").alias("x"))
    g = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.avg("x").alias("mx"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    sse = F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(0.0))
    g = g.withColumns({"rmse": F.sqrt(sse / F.col("n")), "_s2": F.try_divide(sse, F.col("n") - 2)})
    return g.withColumns({"se_b": F.sqrt(F.try_divide("_s2", "sxx")), "se_a": F.sqrt(F.col("_s2") * (1 / F.col("n") + F.try_divide(F.col("mx") ** 2, F.col("sxx"))))}).drop("syy", "_s2")


def rating_residuals(pairs: DataFrame, curve: DataFrame, limit: float = 2.0) -> DataFrame:
    """Leverage and studentised residual of every pair, and whether it lies beyond the limit."""
    c = curve.select("series_id", "n", "a", "b", "sxx", "mx", "rmse")
    df = pairs.filter("q > 0 and h > 0").join(c, "series_id")
    x = F.log10("h")
    df = df.withColumns({"residual": F.log10("q") - (F.col("a") + F.col("b") * x), "leverage": 1 / F.col("n") + F.try_divide(F.pow(x - F.col("mx"), F.lit(2.0)), F.col("sxx"))})
    s = F.col("rmse") * F.sqrt(F.col("n") / (F.col("n") - 2)) * F.sqrt(1 - F.col("leverage"))
    df = df.withColumn("studentised", F.when(s > 0, F.col("residual") / s))
    return df.select("series_id", "t", "residual", "leverage", "studentised", (F.abs("studentised") > limit).alias("is_outlier"))


def discharge(stages: DataFrame, curve: DataFrame) -> DataFrame:
    """stages: series_id, h. The curve's flow; an error where the stage is not above the datum."""
    df = stages.join(curve.select("series_id", "a", "b", "lo", "hi"), "series_id")
    ok = F.when(F.col("h") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("the stage must lie above the datum"))).cast("boolean")
    return df.filter(ok).select("series_id", "h", F.pow(F.lit(10.0), F.col("a") + F.col("b") * F.log10("h")).alias("q"), (~F.log10("h").between(F.col("lo"), F.col("hi"))).alias("extrapolated"))


def level(flows: DataFrame, curve: DataFrame) -> DataFrame:
    """flows: series_id, q (and more). The stage at which the curve gives that flow, and whether it is beyond the calibration."""
    df = flows.join(curve.select("series_id", "a", "b", "lo", "hi"), "series_id")
    x = (F.log10("q") - F.col("a")) / F.col("b")
    return df.withColumn("h", F.pow(F.lit(10.0), x)).withColumn("extrapolated", ~x.between(F.col("lo"), F.col("hi"))).drop("a", "b", "lo", "hi")


def calibrated_level(flows: DataFrame, curve: DataFrame) -> DataFrame:
    """level(), with an error at run time for a flow beyond the calibration."""
    df = level(flows, curve)
    ok = F.when(~F.col("extrapolated"), F.lit(True)).otherwise(F.raise_error(F.lit("the flow lies beyond the calibrated range"))).cast("boolean")
    return df.filter(ok).drop("extrapolated")


def checks(series: DataFrame, expected: int = 30, unit_seconds: int = 86400) -> DataFrame:
    """The rule table per series, long: check, status (PASS, WARN, FAIL) and value. One pass over the series.

    maximum_consistent: the greatest flow is finite and stands in one block alone; its value is the number of such blocks.
    """
    w = ordered()
    df = series.withColumns({"_jump": F.try_divide(F.abs(F.col("q") - F.coalesce(F.lag("q").over(w), F.col("q"))), F.col("q")), "_gap": F.unix_timestamp("block") - F.unix_timestamp(F.lag("block").over(w)), "_top": F.max("q").over(sized())})
    held = (F.col("q") == F.col("_top")) & ~F.isnan("_top") & (F.abs("_top") < float("inf"))
    g = df.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("blocks"), F.sum(F.col("q").isNull().cast("int")).alias("nulls"), F.min("q").alias("least"), (F.stddev_samp("q") / F.avg("q")).alias("cv"),
        F.coalesce(F.sum((F.col("_gap") != unit_seconds).cast("int")), F.lit(0)).alias("gaps"), F.coalesce(F.sum((F.col("_jump") > 0.75).cast("int")), F.lit(0)).alias("jumps"), F.coalesce(F.sum(held.cast("int")), F.lit(0)).alias("places"),
    )
    rules = [
        ("record_length", F.col("n") >= expected, False, F.col("n")),
        ("values_numeric", F.col("nulls") == 0, False, F.col("nulls")),
        ("record_contiguous", F.col("gaps") == 0, False, F.col("gaps")),
        ("blocks_unique", F.col("blocks") == F.col("n"), False, F.col("n") - F.col("blocks")),
        ("values_positive", F.col("least") > 0, False, F.col("least")),
        ("dispersion_plausible", F.col("cv").between(0.4, 2.5), True, F.col("cv")),
        ("maximum_consistent", F.col("places") == 1, False, F.col("places")),
        ("no_extreme_jumps", F.col("jumps") == 0, True, F.col("jumps")),
    ]
    rows = [F.struct(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "PASS").when(F.lit(warn), "WARN").otherwise("FAIL").alias("status"), value.cast("double").alias("value")) for name, ok, warn, value in rules]
    return g.select("series_id", F.inline(F.array(*rows)))


def status_counts(checked: DataFrame) -> DataFrame:
    """Counts by status, zeros included, and whether the series is admissible (no FAIL)."""
    g = checked.groupBy("series_id").agg(*[F.sum((F.col("status") == s).cast("long")).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL")])
    return g.withColumn("admissible", F.col("n_fail") == 0)


def grubbs(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The greatest deviation by the sd, and its two-sided critical value."""
    df = series.withColumns({"_z": F.abs(F.col("q") - F.avg("q").over(sized())) / F.stddev_samp("q").over(sized())})
    g = df.groupBy("series_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max(F.struct(F.col("_z").alias("g"), (-F.col("t")).alias("at"), F.col("q").alias("q"))).alias("_b"))
    g = g.withColumn("tc", F.expr(t_ppf_upper(f"CAST({alpha} AS DOUBLE) / (2 * n)", "(n - 2)")))
    crit = (F.col("n") - 1) / F.sqrt("n") * F.sqrt(F.col("tc") ** 2 / (F.col("n") - 2 + F.col("tc") ** 2))
    return g.select("series_id", F.col("n").cast("long").alias("n"), F.col("_b.g").alias("g"), (-F.col("_b.at")).alias("t"), F.col("_b.q").alias("q"), crit.alias("critical"), (F.col("_b.g") > crit).alias("is_outlier"))


def dixon(series: DataFrame) -> DataFrame:
    """r10 of the least value; refused (null) for counts that the table lacks."""
    g = series.groupBy("series_id").agg(F.count("q").cast("int").alias("n"), F.min("q").alias("x1"), F.max("q").alias("xn"), F.get(F.sort_array(F.collect_list("q")), F.lit(1)).alias("x2"))
    table = F.create_map(*[F.lit(x) for pair in DIXON_R10.items() for x in pair])
    r = F.try_divide(F.col("x2") - F.col("x1"), F.col("xn") - F.col("x1"))
    crit = F.try_element_at(table, F.col("n"))
    return g.select("series_id", "n", r.alias("r10"), crit.alias("critical"), F.when(crit.isNotNull(), r > crit).alias("is_outlier"))


def order_screen(series: DataFrame, candidates: int = 2) -> DataFrame:
    """ln q against normal scores: a line through the central half, standardised residuals, the largest ones flagged."""
    df = ranked(series).withColumn("y", F.log("q")).withColumn("z", F.expr(norm_ppf("rank / (n + 1.0D)")))
    inner = df.filter(plotting_position(F.col("rank"), F.col("n")).between(0.25, 0.75))
    line = inner.groupBy("series_id").agg(F.regr_slope("y", "z").alias("_b"), F.regr_intercept("y", "z").alias("_a"))
    df = df.join(line, "series_id").withColumn("residual", F.col("y") - F.col("_a") - F.col("_b") * F.col("z"))
    df = df.withColumn("std_residual", F.col("residual") / F.stddev_samp("residual").over(sized()))
    place = F.row_number().over(W.partitionBy("series_id").orderBy(F.desc(F.round(F.abs("std_residual"), 9)), "rank"))
    return df.select("series_id", "t", "rank", "q", "z", "residual", "std_residual", (place <= candidates).alias("is_candidate"))


def lowest(series: DataFrame, k: int = 3) -> DataFrame:
    """The k least values of each series with their own blocks."""
    return ranked(series).filter(F.col("rank") <= k).select("series_id", "rank", "t", "q")


def checklist(quality: DataFrame, moments: DataFrame, ranking: DataFrame) -> DataFrame:
    """Clauses judged from other results, long: clause, status (pass, warn, fail, manual)."""
    ok = ranking.groupBy("series_id").agg(F.sum(F.col("accepted").cast("int")).alias("n_accepted"))
    df = status_counts(quality).join(moments.select("series_id", "n", "skew_log"), "series_id").join(ok, "series_id", "left")
    clauses = [
        ("data quality", F.when(F.col("n_fail") == 0, F.when(F.col("n_warn") > 0, "warn").otherwise("pass")).otherwise("fail")),
        ("record length", F.when(F.col("n") >= 30, "pass").otherwise("warn")),
        ("skew within limits", F.when(F.abs("skew_log") < 0.9, "pass").otherwise("warn")),
        ("candidate accepted", F.when(F.coalesce("n_accepted", F.lit(0)) > 0, "pass").otherwise("fail")),
        ("site visit", F.lit("manual")),
    ]
    return df.select("series_id", F.inline(F.array(*[F.struct(F.lit(c).alias("clause"), s.alias("status")) for c, s in clauses])))
