import pytest

from spillway.operators import series
from spillway.plans import study
from spillway.sources import files
from spillway.streaming import maxima

SHEET = "﻿Sl. No.,Year,Peak WL (m),Recorded Date,Time,Discharge* (cumecs)\n1,1999-2000,551.2,05-08-1999,08:00:00,\"1,234\"\n2,2000-2001,550.9,14-12-2000,09:30:00,800\n3,2001-2002,n/a,03-04-2002,07:00:00,950\n"


def test_sheet(spark, tmp_path):
    (tmp_path / "a.csv").write_text(SHEET, encoding="utf-8")
    df = files.tidy(files.read_sheet(spark, str(tmp_path / "a.csv")), datum=550.0)
    rows = df.orderBy("t").collect()
    assert [r["q_cumecs"] for r in rows] == [1234.0, 800.0, 950.0] and rows[2]["wl_m"] is None
    assert [r["season"] for r in rows] == ["southwest_monsoon", "post_monsoon", "pre_monsoon"]
    assert rows[0]["wy_start_year"] == 1999 and abs(rows[0]["h"] - 1.2) < 1e-9 and rows[0]["peak_doy"] == 217
    assert len(files.digest(spark, str(tmp_path / "a.csv")).first()["sha256"]) == 64
    (tmp_path / "b.csv").write_text(SHEET + "4,2001-2002,551,01-07-2001,07:00:00,900\n", encoding="utf-8")
    with pytest.raises(Exception, match="occurs twice"):
        files.tidy(files.read_sheet(spark, str(tmp_path / "b.csv"))).collect()
    (tmp_path / "c.csv").write_text("Year,Q\n1999,1\n")
    with pytest.raises(ValueError, match="lacks"):
        files.read_sheet(spark, str(tmp_path / "c.csv"))


def test_study_is_fail_soft(spark, tmp_path, monkeypatch):
    s = series.synthetic(spark, 60)
    monkeypatch.setitem(study.STAGES, "summary", study.Stage(lambda t, o: t["canonical"].select("nowhere")))
    found = study.run(s, str(tmp_path / "out"), ("summary", "quality", "ranking", "design"))
    assert found["summary"] != "ok" and found["quality"] == found["ranking"] == found["design"] == "ok"
    text = study.report(spark, str(tmp_path / "out"), ("quality", "design"))
    assert "## Design values" in text and "| series_id |" in text
    assert spark.read.text(str(tmp_path / "out/quality.meta")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [("a" if i % 3 else "b", datetime(2024, 1, 1) + timedelta(hours=i), float((i * 37) % 101 + 1)) for i in range(240)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = maxima.start(maxima.stream_maxima(stream, "k", "ts", "v"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r[0], r[1]): r[2] for r in spark.read.parquet(str(tmp_path / "out")).select("series_id", "block", "q").collect()}
    want = {(r[0], r[1]): r[2] for r in series.block_maxima(df, "k", "ts", "v", "day").select("series_id", "block", "q").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_entry_without_training_data_part(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_headers_that_claim_one_column_or_tell_of_two_are_refused():
    for headers in (["Year", "Water year"], ["Date and time"], ["Other x", "other_x"], ["WL (m)", "Q at level"]):
        with pytest.raises(ValueError):
            files.canonical_names(headers)
    assert files.canonical_names(["Yearly note", "Wl"]) == {"Yearly note": "yearly_note", "Wl": "wl_m"}
