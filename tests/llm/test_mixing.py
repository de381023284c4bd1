import pytest

from spillway.llm import mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets_and_taken(documents, odd_rows):
    rows = [*odd_rows, *[(100 + i, "w " * (1 + i * 7 % 23), "en", ("a", "b", "c", "d", None)[i % 5]) for i in range(400)]]
    docs = documents(rows)
    out = mixing.taken(docs).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = brute_targets(sizes)
    by = {round(r["target"], 6) for r in out}
    assert by == {round(v, 6) for v in want.values()}
    plan = mixing.copies(docs).collect()
    for s, goal in want.items():
        got = sum(r["size"] * r["copies"] for r in plan if r["source"] == s)
        longest = max(r["size"] for r in plan if r["source"] == s)
        assert goal - longest <= got <= goal + 1e-6, (s, goal, got, longest)
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.taken(docs).collect()), key=str)


def test_mixed_repeats_rows(documents, odd_rows):
    docs = documents(odd_rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = sum(r["copies"] for r in mixing.copies(docs).collect())
    assert out.count() == want
    assert mixing.taken(documents([])).count() == 0
    assert mixing.mixed(documents([])).count() == 0


def test_source_without_words(documents):
    out = mixing.taken(documents([(1, None, "en", "a"), (2, "", "en", "a"), (3, "some words here", "en", "b")])).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {1: 0, 2: 0, 3: 3}


def test_long_documents_are_taken_less_often(documents):
    rows = [(i, "w " * (1 if i % 2 else 40), "en", "ab"[i % 2 and i % 3 == 0]) for i in range(600)]
    plan = mixing.copies(documents(rows)).collect()
    free = [r for r in plan if 0 < r["target"] < 2 * r["source_size"] and r["source"] == "a"]
    mean = lambda rs: sum(r["copies"] for r in rs) / max(1, len(rs))
    short, long = [r for r in free if r["size"] == 1], [r for r in free if r["size"] == 40]
    if short and long and mean(long) not in (0, 1, 2):
        assert mean(short) >= mean(long)


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), ("a\x0bb\x0cc d", 3)])
def test_words(spark, text, n):
    assert spark.createDataFrame([(text,)], "text string").select(mixing.words_of()).first()[0] == n
