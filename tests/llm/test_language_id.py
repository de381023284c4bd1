import zlib

from conftest_data import sentences

from spillway.llm import language_id


def test_predicts_held_out_rows(documents):
    docs = documents([(i, t, lang, "s") for i, (t, lang) in enumerate(sentences(160))])
    rows = language_id.identify(docs).collect()
    truth = {i: lang for i, (_, lang) in enumerate(sentences(160))}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 160 and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows_and_empty_table(documents, odd_rows):
    rows = language_id.identify(documents(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    by = {r["doc_id"]: r for r in rows}
    for k in (3, 4, 5, 6):
        assert (by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0)
    assert by[7]["lang_pred"] in ("en", "de")
    assert language_id.identify(documents([])).count() == 0


def test_no_labels_gives_und(documents):
    assert {r["lang_pred"] for r in language_id.identify(documents([(1, "some words", None, "s")])).collect()} == {"und"}


def test_longest_known_ngram_decides():
    model = language_id.LanguageModel.of([("a", 0, "word", 5), ("b", 3, "^zz", 4), ("a", 1, "z", 4), ("a", 3, "abc", 1)])
    s = language_id.Scorer(model)
    assert s.predict("word")[0] == "a"
    assert s.predict("zzq")[0] == "b"  # its trigram is known, so the single letter is not asked


def test_numbers_are_no_letters_and_unseen_scripts_say_nothing(documents):
    docs = documents([*[(i, t, lang, "s") for i, (t, lang) in enumerate(sentences(120))], (900, "½ ² Ⅷ 12", "en", "s"), (901, "日本語 のテキスト", None, "s"), (902, "ÜBER straße", "en", "s")])
    by = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert (by[900]["lang_pred"], by[900]["score"]) == ("und", 0.0)
    assert by[901]["lang_pred"] in ("de", "en") and by[901]["score"] == 0.0
    assert by[902]["lang_pred"] == "de"
    kept = {r["doc_id"] for r in language_id.keep_identified(docs).collect()}
    assert kept.isdisjoint({900, 901}) and {0, 1, 902} <= kept


def test_scores_equal_a_plain_version():
    import math

    counts = [("a", 0, "stone", 3), ("b", 0, "stone", 1), ("b", 0, "wood", 2), ("a", 2, "on", 4), ("b", 2, "oo", 5), ("a", 1, "x", 2)]
    model = language_id.LanguageModel.of(counts)
    logs = {}
    for order in (0, 1, 2):
        grams = sorted({g for _, o, g, _ in counts if o == order})
        for lang in "ab":
            n = {g: sum(k for x, o, h, k in counts if (x, o, h) == (lang, order, g)) for g in grams}
            logs |= {(lang, order, g): math.log(n[g] + 0.5) - math.log(sum(n.values()) + 0.5 * len(grams)) for g in grams}
    got, known = model.scores(["stone", "oon", "xq", "qqq"])
    want = [[logs[x, 0, "stone"] for x in "ab"], [(logs[x, 2, "oo"] + logs[x, 2, "on"]) / 2 for x in "ab"], [logs[x, 1, "x"] for x in "ab"]]
    assert all(math.isclose(g, w, rel_tol=1e-5, abs_tol=1e-6) for gs, ws in zip(got, want, strict=False) for g, w in zip(gs, ws, strict=True))
    assert known.tolist() == [True, True, True, False]


def test_stage_keeps_columns_and_rejects_undetermined(documents, odd_rows):
    docs = documents(odd_rows)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {3, 4, 5, 6}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_stage_passes_columns_of_any_name(documents):
    from pyspark.sql import functions as F

    docs = documents([(i, t, lang, "s") for i, (t, lang) in enumerate(sentences(60))]).withColumns({"score": F.lit(1), "lang_pred": F.lit("x")})
    assert language_id.keep_identified(docs).filter("lang_pred = 'x' and score = 1").count() == 60
    assert language_id.keep_identified(docs.limit(0)).count() == 0
