"""The whole study of a set of series as stages with declared inputs, restarts from what is unchanged, its report, and a command line.

A stage's table is reused if its inputs have the content that it was made from: the manifest beside the tables holds for each stage a
digest of its inputs and options and one of its own rows. A changed input recomputes its dependants only, and those
of a stage that gives the same rows as before are reused too.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import battery, candidates, dependence, features, frequency, kernels, learning, moments, parents, peaks, quality, resampling, series, station, trend
from ..sources import files

#: Raised when a stage's result changes with the same inputs.
VERSION = 1
CANONICAL = "canonical"


@dataclass(frozen=True)
class Stage:
    """build(tables, options) makes the table from the tables of `inputs`."""

    build: Callable[[dict[str, DataFrame], dict], DataFrame]
    inputs: tuple[str, ...] = (CANONICAL,)
    title: str = ""


def _of(f: Callable[[DataFrame], DataFrame]) -> Callable[[dict[str, DataFrame], dict], DataFrame]:
    return lambda t, _: f(t[CANONICAL])


def _checklist(t: dict[str, DataFrame], _: dict) -> DataFrame:
    s = t[CANONICAL]
    return station.checklist(
        s, quality=t["quality"], design=t["design"], hfl=t["implied"], skew=frequency.skew_decision(s), fits=t["fits"], outliers=t["outliers"], peaks=t["peaks"],
        tests=t["tests"], placed=series.probabilities(s), factors=frequency.factor_gap(s),
    )


STAGES: dict[str, Stage] = {
    "quality": Stage(_of(quality.checks), title="Quality control"),
    "summary": Stage(_of(moments.summary), title="The record"),
    "moments": Stage(_of(moments.moment_coefficients)),
    "lmoments": Stage(_of(moments.lmoments)),
    "acf": Stage(_of(dependence.acf_table)),
    "effective_size": Stage(_of(dependence.effective_size)),
    "trend": Stage(_of(trend.mann_kendall)),
    "slope": Stage(_of(trend.theil_sen)),
    "change": Stage(_of(trend.pettitt)),
    "runs": Stage(_of(trend.runs)),
    "outliers": Stage(_of(quality.grubbs), title="Outlier screens"),
    "ranking": Stage(_of(frequency.ranking), title="Closed fits"),
    "tests": Stage(_of(battery.tests), title="Trend, randomness and stationarity"),
    "fits": Stage(_of(candidates.ranking), title="Candidate distributions"),
    "design": Stage(_of(frequency.design_values), title="Design values"),
    "implied": Stage(lambda t, _: frequency.implied_periods(t[CANONICAL], t["design"].select("series_id", "period", F.col("lp3").alias("q"))), (CANONICAL, "design"), "The record's greatest value under the fitted law"),
    "intervals": Stage(lambda t, o: resampling.lp3_intervals(t[CANONICAL], o.get("reps", 2000))),
    "family_intervals": Stage(lambda t, o: parents.intervals(t["fits"].filter("is_best"), o.get("reps", 2000)), ("fits",), "Intervals of the best family"),
    "peaks": Stage(lambda t, _: peaks.gated_fit(t[CANONICAL].select("series_id", F.col("q").alias("x"))), title="Peaks over threshold"),
    "features": Stage(_of(features.lag_features)),
    "learning": Stage(lambda t, _: learning.score_table(learning.forecasts(t[CANONICAL], ("linear", "ridge", "forest", "boosting"))), title="Learned forecasts out of fold"),
    "chains": Stage(lambda t, o: kernels.mcmc(t[CANONICAL], **{k: o[k] for k in ("draws", "burn", "pilot") if k in o})),
    "posterior": Stage(lambda t, _: resampling.posterior(t["chains"]), ("chains",), "Posterior by Markov chains"),
    "checklist": Stage(_checklist, (CANONICAL, "quality", "design", "implied", "fits", "outliers", "peaks", "tests"), "Review list"),
}
#: Stages that take minutes; they run when they are asked for.
LONG = ("learning", "chains", "posterior")
USUAL = tuple(k for k in STAGES if k not in LONG)


def ordered(stages: tuple[str, ...]) -> list[str]:
    """The stages with all they need, each after its inputs."""
    out: list[str] = []

    def add(name: str) -> None:
        for i in STAGES[name].inputs:
            if i != CANONICAL:
                add(i)
        if name not in out:
            out.append(name)

    for name in stages:
        add(name)
    return out


def study(canonical: DataFrame, stages: tuple[str, ...] = USUAL, options: dict | None = None) -> dict[str, DataFrame]:
    """Each stage's table, lazily; they share the canonical frame and each other's plans."""
    made = {CANONICAL: canonical}
    for name in ordered(stages):
        made[name] = STAGES[name].build(made, options or {})
    return {name: made[name] for name in stages}


def content(df: DataFrame) -> str:
    """A digest of the rows in any order, of at most one row a task in the driver."""
    texts = [F.to_json(F.struct(F.col(f"`{c}`"))) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string") for c, t in df.dtypes]
    h = F.xxhash64(*texts)
    row = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 32))).head()
    return sha256(repr((df.dtypes, tuple(row))).encode()).hexdigest()


def manifest(spark: SparkSession, out: str) -> dict[str, dict[str, str]]:
    """What the folder's tables were made from, by stage; empty if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return {}
    rows = spark.read.text(f"{out}/manifest").collect()  # one line
    return json.loads(rows[0][0]) if rows else {}


def run(canonical: DataFrame, out: str, stages: tuple[str, ...] = USUAL, options: dict | None = None) -> dict[str, str]:
    """Write every table; a stage that fails is reported and stops only what needs it. Returns ok, reused or the error by stage.

    The manifest is written after each stage, so a run that was cut off is taken up where it ended.
    """
    spark, options = canonical.sparkSession, options or {}
    canonical.persist()
    known, found, made = manifest(spark, out), {}, {CANONICAL: canonical}
    digests = {CANONICAL: content(canonical)}
    for name in ordered(stages):
        stage = STAGES[name]
        missing = [i for i in stage.inputs if i not in made]
        if missing:
            found[name] = f"not run: needs {', '.join(missing)}"
            continue
        asked = sha256(json.dumps([VERSION, name, sorted(options.items()), [digests[i] for i in stage.inputs]]).encode()).hexdigest()
        try:
            if known.get(name, {}).get("inputs") == asked:
                table, found[name] = spark.read.parquet(f"{out}/{name}"), "reused"
            else:
                known.pop(name, None)
                files.write_table(stage.build(made, options), f"{out}/{name}", name)
                table, found[name] = spark.read.parquet(f"{out}/{name}"), "ok"
                known[name] = {"inputs": asked, "rows": content(table)}
                spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
            made[name], digests[name] = table, known[name]["rows"]
        except Exception as e:  # fail-soft by stage, the error goes into the record
            found[name] = f"{type(e).__name__}: {str(e)[:200]}"
    canonical.unpersist()
    return found


def markdown(table: DataFrame, title: str, rows: int = 50) -> str:
    """A report table of at most `rows` rows."""
    lines = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    show = lambda v: f"{v:,.4g}" if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join([*lines, *["| " + " | ".join(show(v) for v in r) + " |" for r in table.limit(rows).collect()], ""])


def report(spark: SparkSession, out: str, stages: tuple[str, ...] | None = None) -> str:
    """The report of a saved run, from its tables alone: the named stages, or all titled ones that the manifest lists."""
    if stages is None:
        known = manifest(spark, out)
        stages = tuple(k for k, s in STAGES.items() if s.title and k in known)
    return "\n".join(markdown(spark.read.parquet(f"{out}/{name}"), STAGES[name].title if name in STAGES and STAGES[name].title else name) for name in stages)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spillway", description="Frequency analysis of block maxima")
    p.add_argument("table", nargs="?", help="a table of times and values; left out, the report is rebuilt from the tables in `out`")
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="parquet", choices=("parquet", "csv", "orc", "json"))
    p.add_argument("--series", default="event_type", help="the column that names the series; with csv input it may be missing")
    p.add_argument("--ts", default="ts")
    p.add_argument("--value", default="value")
    p.add_argument("--block", default="day")
    p.add_argument("--stages", nargs="*", default=list(USUAL), choices=list(STAGES))
    p.add_argument("--reps", type=int, help="bootstrap replicates")
    p.add_argument("--draws", type=int, help="kept draws of each chain")
    p.add_argument("--burn", type=int, help="draws left out at the start of each chain")
    p.add_argument("--report", help="write the report in Markdown to this file")
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("spillway").getOrCreate()
    found = {}
    if a.table:
        rows = spark.read.format(a.format).options(**({"header": "true"} if a.format == "csv" else {})).load(a.table)
        if a.series not in rows.columns:
            rows = rows.withColumn(a.series, F.lit("record"))
        rows = rows.withColumns({a.ts: F.col(a.ts).cast("timestamp"), a.value: F.expr(f"try_cast(`{a.value}` AS double)")})
        options = {k: v for k, v in (("reps", a.reps), ("draws", a.draws), ("burn", a.burn)) if v is not None}
        found = run(series.block_maxima(rows, a.series, a.ts, a.value, a.block), a.out, tuple(a.stages), options)
        if not a.quiet:
            print("\n".join(f"{k}: {v}" for k, v in found.items()))
    text = report(spark, a.out)
    if a.report:
        with open(a.report, "w", encoding="utf-8") as f:
            f.write(text)
    elif not a.table:
        print(text)
    return int(any(v not in ("ok", "reused") for v in found.values()))


if __name__ == "__main__":
    raise SystemExit(main())
