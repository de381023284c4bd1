"""The written report: named tables, sections of Markdown over them, and figure tables."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import battery, candidates, densities, dependence, features, frequency, moments, quality, series, thresholds, trend, uncertainty
from ..sources import files

#: The named tables of a study, each from the canonical series.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "design_values": frequency.design_values,
    "candidate_ranking": candidates.ranking,
    "quality_control": quality.checks,
    "acf": lambda s: dependence.acf_table(s).join(dependence.pacf(s), ["series_id", "lag"]),
    "record_uncertainty": uncertainty.monte_carlo,
    "outlier_screens": quality.order_screen,
    "tests": battery.tests,
    "moments": moments.moment_coefficients,
    "lmoments": moments.lmoments,
}

SECTIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "design": ("Design values", ("design_values",)),
    "diagnosis": ("Quality, trend and dependence", ("quality_control", "outlier_screens", "tests", "acf")),
    "methods": ("Candidate distributions", ("candidate_ranking", "moments", "lmoments")),
    "uncertainty": ("Uncertainty", ("record_uncertainty",)),
}


def decade_frame(s: DataFrame) -> DataFrame:
    return series.calendar(s).select("series_id", "decade", "t", "q")


def time_series(s: DataFrame) -> DataFrame:
    """Value, Sen's line at the same abscissa, the record's P75, P90 and P95, centred means and anomaly of every block."""
    line = trend.theil_sen(s).select("series_id", "slope", "intercept")
    cut = s.groupBy("series_id").agg(F.percentile("q", F.array(*[F.lit(p) for p in (0.75, 0.9, 0.95)])).alias("_p"))
    df = features.centred(s).join(line, "series_id").join(cut, "series_id").join(series.class_of_value(s).select("series_id", "t", "z", "exceeds_90"), ["series_id", "t"])
    return df.select("series_id", "t", "q", (F.col("intercept") + F.col("slope") * F.col("t")).alias("sen"), *[F.col("_p")[k].alias(f"p{p}") for k, p in enumerate((75, 90, 95))], "mean5", "mean10", "z", "exceeds_90")


def probability_paper(s: DataFrame) -> DataFrame:
    """Each value at its plotting position: normal score, Gumbel's reduced variate -ln(-ln p), and the correlation r on normal paper."""
    from pyspark.sql import Window as W

    from ..functions.special import norm_ppf

    df = series.ranked(s).withColumn("p", series.plotting_position(F.col("rank"), F.col("n"))).withColumn("normal", F.expr(norm_ppf("p")))
    df = df.withColumn("reduced", -F.log(-F.log("p")))
    return df.withColumn("r", F.corr("q", "normal").over(W.partitionBy("series_id"))).select("series_id", "rank", "q", "p", "normal", "reduced", "r")


def reduced_variate(period: str = "period"):
    """-ln(-ln(1 - 1/T)), the abscissa of Gumbel paper for a return period."""
    return -F.log(-F.log(1 - 1 / F.col(period)))


FIGURES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "time_series": time_series,
    "histogram": moments.histogram,
    "density": densities.density,
    "density_comparison": densities.density_comparison,
    "ecdf": series.ecdf,
    "decades": lambda s: moments.group_shape(series.calendar(s), "decade"),
    "frequency_curves": lambda s: candidates.curves(candidates.ranking(s)),
    "lag_pairs": features.lag_pairs,
    "correlations": lambda s: features.correlations(features.lag_features(s)),
    "record_uncertainty": uncertainty.monte_carlo,
    "quantile_plots": lambda s: candidates.ranking(s).filter("place <= 6").select("series_id", "family", "place", "qq_r2"),
    "probability_paper": probability_paper,
    "dependence": dependence.acf_table,
    "distribution_ranking": lambda s: candidates.ranking(s).select("series_id", "family", "aic", "bic", "aicc", "hqic", "weight", "accepted"),
    "period_by_family": lambda s: candidates.quantile_matrix(candidates.ranking(s)),
    "moment_plane": lambda s: candidates.nearest_locus(moments.moment_coefficients(s).select("series_id", F.col("skew").alias("cs"), "ck"), candidates.loci(s.sparkSession)),
    "threshold_plot": lambda s: thresholds.mean_residual_life(s.select("series_id", F.col("q").alias("x")), 40),
}


def number(v: object) -> str:
    """Thousands separated above a thousand, four digits below, nothing for null."""
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return ""
    if isinstance(v, bool) or not isinstance(v, int | float):
        return ", ".join(map(number, v)) if isinstance(v, list) else str(v)
    return f"{v:,.0f}" if abs(v) >= 1000 else f"{v:.4g}"


def section(spark: SparkSession, out: str, name: str, rows: int = 50) -> str:
    """A section over the tables that were written; a table that is missing is named as such."""
    title, tables = SECTIONS[name]
    parts = [f"## {title}", ""]
    for t in tables:
        try:
            found = spark.read.parquet(f"{out}/{t}")
            shown = found.limit(rows).collect()
        except Exception as e:  # fail-soft by table, as the study itself
            parts += [f"### {t}", "", f"not available: {type(e).__name__}", ""]
            continue
        parts += [f"### {t}", "", "| " + " | ".join(found.columns) + " |", "|" + " --- |" * len(found.columns), *["| " + " | ".join(number(v) for v in r) + " |" for r in shown], ""]
    return "\n".join(parts)


def report(spark: SparkSession, out: str, title: str = "Frequency analysis") -> str:
    return "\n".join([f"# {title}", "", *[section(spark, out, s) for s in SECTIONS]])


def write(canonical: DataFrame, out: str, tables: tuple[str, ...] = tuple(TABLES), figures: tuple[str, ...] = ()) -> dict[str, str]:
    """Write named tables, figure tables, results.json and report.md under out; the outcome of each by name.

    A table that fails is recorded and does not stop the others. Small texts are written by Spark, so out may be in any store.
    """
    spark = canonical.sparkSession
    canonical = canonical.persist()
    found: dict[str, str] = {}
    for folder, names, source in (("", tables, TABLES), ("figures/", figures, FIGURES)):
        for name in names:
            try:
                files.write_table(source[name](canonical), f"{out}/{folder}{name}", name)
                found[name] = "ok"
            except Exception as e:  # fail-soft by table
                found[name] = f"{type(e).__name__}: {str(e)[:200]}"
    canonical.unpersist()
    for name, text in (("results.json", json.dumps(files.jsonable({"tables": found, **files.manifest(spark)}), indent=1)), ("report.md", report(spark, out))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/{name}")
    return found
