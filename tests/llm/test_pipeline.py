from conftest_data import sentences, words


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from spillway.llm._common import materialize

    text = [(" ".join(words(60, i)), "en") for i in range(30)]
    rows = [(i, t, lang, "ab"[i % 2], len(t)) for i, (t, lang) in enumerate([*sentences(60), *text, *text[:10], ("???", "en"), ("", "de"), ("mail me at a@b.example now please friend", "en")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), f"test-{name}")
        kept[name] = docs
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(kept[n].columns == columns for n in ("language_id", "near_duplicates", "personal_data", "mixing"))
    assert kept["language_id"].filter("text in ('', '???')").count() == 0
    assert kept["near_duplicates"].count() == kept["language_id"].count() - 10
    assert kept["personal_data"].filter("text like '%a@b.example%'").count() == 0
    total = kept["packing"].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in total) <= 2048
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.columns == kept["packing"].columns and run.count() == kept["packing"].count()


ODD = [
    (1, "the house and the river were quiet when the children came back from the field", "en", "a"),
    (1, "the house and the river were quiet when the children came back from the field", "en", "a"),
    (2, "the house and the river were quiet when the children came back from the field", "en", None),
    (2, "das haus und der fluss waren still als die kinder mit dem alten hund kamen", "de", "b"),
    (None, "the children came back from the river with the old dog in the morning light", "en", "b"),
    (None, None, None, None),
    (3, None, "en", "a"),
    (4, "", "en", None),
    (5, " \n\t ", None, "b"),
    (6, "call +49 30 1234567 or write to a.b@example.org about the house and the river", None, "a"),
    (7, ("the old dog and the children were by the river in the morning\n") * 3000, "en", "a"),
]
CLASHING = "_id _own _row _g best stays cls group least rows n size token a b label node shard copies taken target u p s e kind base wide added _text _spans piece start length".split()


def test_odd_rows_and_clashing_columns_through_all_stages(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F
    from spillway.llm._common import materialize

    rows = [(100 + i, t, lang, "ab"[i % 2]) for i, (t, lang) in enumerate(sentences(60))] + ODD
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"clash {c}") for c in CLASHING}).repartition(3)
    columns = docs.columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), f"test-odd-{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
            assert docs.select(*[F.count_distinct(f"`{c}`").alias(c) for c in CLASHING]).collect()[0] == tuple(1 for _ in CLASHING)
    assert kept["language_id"].filter("text is null or trim(text) = ''").count() == 0
    near = kept["near_duplicates"]
    assert near.filter("doc_id = 1").count() == 1 and near.filter("doc_id = 2 and lang = 'en'").count() == 0 and near.filter("doc_id = 2 and lang = 'de'").count() == 1
    assert near.filter("doc_id is null").count() == 1
    assert [r.text for r in kept["personal_data"].filter("doc_id = 6").collect()] == ["call <PHONE> or write to <EMAIL> about the house and the river"]
    assert kept["packing"].groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).collect()[0][0] <= 2048


def test_empty_table_through_all_stages(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, _id string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
