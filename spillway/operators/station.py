"""Rules over station records: seventeen quality checks and the review list of eighteen clauses.

A record is a table of series_id, t, block, q and, where they are known, wl (water level), label, peak_date and is_monsoon;
`meta` has a row a station: series_id, datum, observed_level, observed_flow, is_derived, expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .quality import rating_curve, rating_residuals
from .series import ordered

PASS, WARN, FAIL, MANUAL = "pass", "warn", "fail", "manual"


def _facts(records: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a series with all that the rules need."""
    w = ordered()
    df = records.join(meta, "series_id")
    jump = F.try_divide(F.abs(F.col("q") - F.coalesce(F.lag("q").over(w), F.col("q"))), F.col("q"))
    rank = lambda c: F.rank().over(W.partitionBy("series_id").orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("series_id", c)) - 1) / 2
    df = df.withColumns({"_jump": jump, "_year": F.year("block"), "_gap": F.year("block") - F.year(F.lag("block").over(w)), "_rq": rank("q"), "_rw": rank("wl"), "_label": F.coalesce("label", F.col("block").cast("string"))})
    first = -F.col("t")
    g = df.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q").isNotNull() & ~F.isnan("q"), 1)).alias("numeric"), F.count(F.when(F.col("peak_date").isNull(), 1)).alias("undated"),
        F.count(F.when(F.col("_gap") != 1, 1)).alias("gaps"), F.countDistinct("_label").alias("labels"), F.min("q").alias("least"), F.min(F.col("wl") - F.col("datum")).alias("depth"),
        (F.stddev_samp("q") / F.avg("q")).alias("cv"), F.corr("_rq", "_rw").alias("rho"), F.max(F.struct("q", first.alias("t")))["t"].alias("at_q"), F.max(F.struct("wl", first.alias("t"), "q")).alias("top"),
        F.avg((~F.col("is_monsoon")).cast("double")).alias("off_season"), F.sort_array(F.collect_set(F.when(F.col("_jump") > 0.75, F.col("_label")))).alias("jumps"),
        F.first("observed_level").alias("observed_level"), F.first("observed_flow").alias("observed_flow"), F.first("is_derived").alias("is_derived"), F.first("expected").alias("expected"),
    )
    pairs = df.select("series_id", "t", "q", (F.col("wl") - F.col("datum")).alias("h"))
    curve = rating_curve(pairs)
    out = rating_residuals(pairs, curve).filter("is_outlier").groupBy("series_id").agg(F.count(F.lit(1)).alias("off_curve"))
    return g.join(curve.select("series_id", "b", "r2"), "series_id", "left").join(out, "series_id", "left")


def checks(records: DataFrame, meta: DataFrame) -> DataFrame:
    """The seventeen rules, long: series_id, check, status (PASS, WARN, FAIL), value, detail."""
    c = F.col
    match = (F.abs(c("top.q") - c("observed_flow")) <= 1.0) & (F.abs(c("top.wl") - c("observed_level")) <= 1e-3)
    rules: list[tuple[str, Column, bool, Column, str]] = [
        ("record_length", c("n") == c("expected"), False, c("n"), "blocks on record"),
        ("values_numeric", c("numeric") == c("n"), False, c("numeric"), "finite values"),
        ("dates_parsed", c("undated") == 0, True, c("undated"), "peaks without a date"),
        ("record_contiguous", c("gaps") == 0, False, c("gaps"), "gaps between years"),
        ("labels_unique", c("labels") == c("n"), False, c("labels"), "distinct labels"),
        ("values_positive", c("least") > 0, False, c("least"), "least value"),
        ("level_above_datum", c("depth") > 0, False, c("depth"), "least depth above the datum"),
        ("dispersion_plausible", c("cv").between(0.4, 2.5), True, c("cv"), "coefficient of variation"),
        ("stage_flow_monotone", c("rho") > 0.9, False, c("rho"), "rank correlation of stage and flow"),
        ("rating_curve_fit", c("r2") > 0.95, False, c("r2"), "R^2 of the rating curve"),
        ("rating_curve_shape", c("b").between(1.5, 3.5), True, c("b"), "exponent of the rating curve"),
        ("rating_curve_outliers", F.coalesce("off_curve", F.lit(0)) == 0, True, F.coalesce("off_curve", F.lit(0)), "years off the rating curve"),
        ("maximum_consistent", c("at_q") == c("top.t"), False, -c("at_q"), "place of the greatest flow, which is that of the highest level"),
        ("observed_maximum_matches", match, False, c("top.q"), "flow at the highest level, as the station's abstract has it"),
        ("flow_provenance", ~c("is_derived"), True, c("is_derived").cast("int"), "flows are derived from levels"),
        ("seasonality_reasonable", c("off_season") <= 0.20, True, c("off_season"), "share of peaks out of season"),
        ("no_extreme_jumps", F.size("jumps") == 0, True, F.size("jumps"), "changes of more than 75 %"),
    ]
    rows = [F.struct(F.lit(name).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "PASS").when(F.lit(warn), "WARN").otherwise("FAIL").alias("status"), value.cast("double").alias("value"), F.lit(detail).alias("detail")) for name, ok, warn, value, detail in rules]
    return _facts(records, meta).select("series_id", F.inline(F.array(*rows)))


CLAUSES = (
    ("2.1", "the record has no gaps"), ("2.2", "each peak is the highest of its year"), ("2.3", "the rating curve is current"), ("2.4", "one datum throughout, and stated"), ("2.5", "changes of the channel are assessed"), ("2.6", "outliers have been screened"),
    ("3.1", "stationarity has been tested"), ("3.2", "the record is long enough for the periods"), ("3.3", "independent evidence where it is not"),
    ("4.1", "log-Pearson III is fitted to the logarithms"), ("4.2", "the skew is within its bounds"), ("4.3", "zero floods are accounted for"), ("4.4", "confidence limits are given"), ("4.5", "other distributions are compared"),
    ("5.1", "observed points are on the curve"), ("5.2", "the curve has been checked by arithmetic"), ("5.3", "extrapolation is marked"), ("5.4", "25 years at least"),
)


def checklist(
    records: DataFrame, quality: DataFrame | None = None, design: DataFrame | None = None, hfl: DataFrame | None = None, skew: DataFrame | None = None,
    fits: DataFrame | None = None, outliers: DataFrame | None = None, peaks: DataFrame | None = None, tests: DataFrame | None = None,
    placed: DataFrame | None = None, factors: DataFrame | None = None,
) -> DataFrame:
    """The eighteen clauses, long: series_id, clause, requirement, status, evidence. A clause whose result is missing is manual, never passed.

    quality: checks(); design: with q_low and q_high; hfl: frequency.implied_periods(); skew: skew_decision(); fits: ranked candidates;
    outliers: any screen; peaks: the gated fit; tests: the battery; placed: the observed values at their return periods (series_id,
    return_period), all of which must have one for 5.1; factors: frequency.factor_gap(), within 10 % throughout for 5.2.
    """
    df = records.groupBy("series_id").agg(F.count("q").alias("n"))

    def add(table: DataFrame | None, **cols: Column) -> None:
        nonlocal df
        if table is None:
            df = df.withColumns({k: F.lit(None).cast("string" if k == "contiguous" else "boolean") for k in cols})
        else:
            df = df.join(table.groupBy("series_id").agg(*[c.alias(k) for k, c in cols.items()]), "series_id", "left")

    add(quality, contiguous=F.max(F.when(F.col("check") == "record_contiguous", F.col("status"))))
    add(outliers, screened=F.lit(True))
    changed = F.col("rejects") & (F.startswith(F.col("test"), F.lit("pettitt")) | (F.col("test") == "mann-kendall"))
    add(tests, changed=F.max(F.coalesce(changed, F.lit(False))))
    add(hfl, long_enough=F.max("passed"))
    add(peaks, peaks_accepted=F.max("accepted"))
    add(design, designed=F.lit(True), limits=F.min(F.col("q_low").isNotNull() & F.col("q_high").isNotNull()) if design is not None else F.lit(None))
    add(skew, skew_free=F.max(~F.col("kurtosis_governed")) if skew is not None else F.lit(None))
    add(fits, compared=F.lit(True))
    add(placed, on_curve=F.sum(F.col("return_period").isNotNull().cast("int")) == F.max("n") if placed is not None and "n" in placed.columns else F.lit(None))
    add(factors, checked=F.max(F.abs("gap_percent")) <= 10 if factors is not None else F.lit(None))
    c = F.col
    known = lambda col, ok: F.when(c(col).isNull(), MANUAL).when(ok, PASS).otherwise(FAIL)
    given = lambda col: F.when(F.coalesce(c(col), F.lit(False)), PASS).otherwise(MANUAL)
    manual = F.lit(MANUAL)
    status = {
        "2.1": F.when(c("contiguous").isNull(), MANUAL).when(c("contiguous") == "PASS", PASS).when(c("contiguous") == "WARN", WARN).otherwise(FAIL),
        "2.2": manual, "2.3": manual, "2.4": manual, "2.5": manual, "2.6": given("screened"),
        "3.1": F.when(c("changed").isNull() | c("changed"), MANUAL).otherwise(PASS), "3.2": known("long_enough", c("long_enough")), "3.3": known("peaks_accepted", ~c("peaks_accepted")),
        "4.1": given("designed"), "4.2": known("skew_free", c("skew_free")), "4.3": manual, "4.4": given("limits"), "4.5": given("compared"),
        "5.1": known("on_curve", c("on_curve")), "5.2": known("checked", c("checked")), "5.3": given("designed"), "5.4": known("designed", c("n") >= 25),
    }
    return df.select("series_id", F.inline(F.array(*[F.struct(F.lit(k).alias("clause"), F.lit(what).alias("requirement"), status[k].alias("status")) for k, what in CLAUSES])))


def clause_counts(listed: DataFrame) -> DataFrame:
    """How many clauses have each status, zeros included."""
    return listed.groupBy("series_id").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in (PASS, WARN, FAIL, MANUAL)])
