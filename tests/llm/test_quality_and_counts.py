import re
from collections import Counter

from pyspark.sql import functions as F

from spillway.llm import quality_rules, token_counts
from spillway.llm._tokens import vocabulary

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = W.findall(t)
    tri = list(zip(w, w[1:], w[2:], strict=False))
    c, cover = Counter(tri), set()
    for i, k in enumerate(tri):
        if c[k] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if W.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_counts_match_brute_force(documents, odd_rows):
    rows = [*odd_rows, (20, "a b a b a b c", "en", "s"), (21, "x y z x y z # $\n\nx\nx\n \n", "en", "s"), (22, "a b c", "en", None), (23, "a a a a", "en", None)]
    out = quality_rules.judge(documents(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[n] for n in names) for r in out) == sorted(brute(r[1]) for r in rows)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(documents([])).count() == 0


def test_bad_host_loses_good_documents(documents):
    from conftest_data import words

    good = lambda i: " ".join(words(80, i))
    rows = [(i, good(i), "en", f"h{i % 6}") for i in range(120)] + [(1000 + i, "short", "en", "bad") for i in range(60)] + [(2000, good(7), "en", "bad")]
    out = {r["doc_id"]: r for r in quality_rules.judge(documents(rows)).collect()}
    assert not out[2000]["base_failed"] and not out[2000]["kept"]
    assert all(out[i]["kept"] for i in range(120))


def test_rollup_is_additive_and_idempotent(spark, documents, odd_rows):
    docs = documents(odd_rows)
    counts = docs.select("source", "lang", F.lit("v").alias("tokenizer"), token_counts.words_v1(F.col("text")).alias("tokens"))
    rollup = token_counts.Rollup(spark)
    assert rollup.totals().count() == 0
    assert rollup.commit("b1", token_counts.inserts(counts)) and not rollup.commit("b1", token_counts.inserts(counts))
    once = sorted(map(tuple, rollup.totals().collect()), key=str)
    want = Counter()
    for r in odd_rows:
        want[(r[3], r[2])] += len((r[1] or "").split())
    assert {(r[0], r[1]): r[4] for r in once} == dict(want)
    assert rollup.commit("b2", token_counts.deletes(counts))
    assert rollup.totals().count() == 0
    # A batch without its commit record, as a lost driver would leave it, is not seen; sent again it replaces itself.
    token_counts.inserts(counts).groupBy(*token_counts.KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{rollup.path}/deltas/b3")
    assert rollup.totals().count() == 0
    rollup.commit("b3", token_counts.inserts(counts))
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == once
    rollup.commit("b4", token_counts.revisions(counts.select(*token_counts.KEYS, F.col("tokens").alias("old_tokens"), (F.col("tokens") + 1).alias("new_tokens"))))
    assert rollup.totals().agg(F.sum("tokens")).first()[0] == sum(r[4] for r in once) + len(odd_rows)


def test_library_counts(documents, odd_rows):
    from spillway.llm._tokens import Encoder

    lib = Encoder(vocabulary("byte_bpe_50k.json")).library
    out = token_counts.library_counts(documents(odd_rows), vocabulary("byte_bpe_50k.json"), "bpe")
    assert out.agg(F.sum("tokens")).first()[0] == sum(len(lib.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows)
    assert token_counts.maintained(documents([]), documents([]).selectExpr("doc_id", "0 AS toxic")).count() == 0


def test_vocabulary_rollup_matches_brute_force(spark, documents, odd_rows, tmp_path):
    from spillway.llm import queries
    from spillway.llm._tokens import Encoder

    rows = [*odd_rows, (30, "one two\none two\nthree", "en", "a"), (31, "bad words\nbad words", "en", "a"), (32, "été\n日本\nété", "fr", "b")]
    toxic = {31, 8}
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in [*toxic, 31]] + [(30, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    lib = Encoder(vocabulary("byte_bpe_50k.json")).library
    counters = {
        "words-v1": lambda t, once: len(W.findall(once)),
        "bytes-v1": lambda t, once: len(t.encode()),
        "byte-bpe-50k": lambda t, once: len(lib.encode(once, add_special_tokens=False).ids),
    }
    want = {}
    for i, t, lang, source in rows:
        for v, f in counters.items() if i not in toxic else ():
            d, n = want.get((source, lang, v), (0, 0))
            t = t or ""
            want[(source, lang, v)] = (d + 1, n + f(t, "\n".join(dict.fromkeys(t.split("\n")))))
    out = queries.QUERIES["op10_vocabulary_counts"](spark, str(tmp_path)).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in out} == want
