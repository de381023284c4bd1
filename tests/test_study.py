"""Restarts of a study, its report from saved tables, and the command line."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F
from test_operators import frame

from spillway.operators import frequency, quality, series, station
from spillway.plans import study


def record(seed=0, n=40):
    return np.random.default_rng(seed).gumbel(100, 20, n)


def test_a_second_run_recomputes_nothing(spark, tmp_path, monkeypatch):
    stages, out = ("quality", "summary", "trend", "design", "implied"), str(tmp_path / "out")
    s = frame(spark, record(), record(1))
    built = []
    counted = {k: study.Stage(lambda t, o, k=k, b=v.build: (built.append(k), b(t, o))[1], v.inputs, v.title) for k, v in study.STAGES.items()}
    monkeypatch.setattr(study, "STAGES", counted)
    assert set(study.run(s, out, stages).values()) == {"ok"} and sorted(built) == sorted(stages)
    built.clear()
    assert set(study.run(s.repartition(5), out, stages).values()) == {"reused"} and not built
    # Another option asks for a stage anew, and so does another record; the others stay as they are.
    assert study.run(s, out, ("trend",), {"reps": 10})["trend"] == "ok"
    assert study.run(s.withColumn("q", F.col("q") + 1), out, ("summary",)) == {"summary": "ok"}
    assert study.run(s, out, ("implied",)) == {"design": "reused", "implied": "reused"}
    text = study.report(spark, out)
    assert "## Quality control" in text and "## Design values" in text and "greatest value" in text


def test_failures_stop_only_their_dependants(spark, tmp_path, monkeypatch):
    broken = study.STAGES | {"design": study.Stage(lambda t, o: t["canonical"].select("no such column"))}
    monkeypatch.setattr(study, "STAGES", broken)
    found = study.run(frame(spark, record()), str(tmp_path / "out"), ("design", "implied", "summary"))
    assert found["summary"] == "ok" and found["implied"] == "not run: needs design" and "no such column" in found["design"]


def test_command_line_on_csv(spark, tmp_path):
    rows = [((datetime(1990, 1, 1) + timedelta(days=365 * k)).isoformat(), str(v) if k != 3 else "n/a") for k, v in enumerate(record(2))]
    spark.createDataFrame(rows, "ts string, value string").coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    args = [str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--format", "csv", "--block", "year", "--stages", "summary", "design", "--reps", "50", "--quiet", "--report", str(tmp_path / "r.md")]
    assert study.main(args) == 0
    assert "record" in (tmp_path / "r.md").read_text() and spark.read.parquet(str(tmp_path / "out/summary")).head()["n"] == 39
    assert study.main(["--out", str(tmp_path / "out"), "--quiet", "--report", str(tmp_path / "again.md")]) == 0
    assert (tmp_path / "again.md").read_text() == (tmp_path / "r.md").read_text()


def test_review_list_needs_its_results(spark):
    s = frame(spark, record(3))
    status = lambda df: {r["clause"]: r["status"] for r in df.collect()}
    bare = status(station.checklist(s))
    assert bare["5.1"] == bare["5.2"] == station.MANUAL == bare["2.1"]
    full = status(station.checklist(s, quality=quality.checks(s), placed=series.probabilities(s), factors=frequency.factor_gap(s)))
    assert full["5.1"] == full["5.2"] == station.PASS
