import random

import pytest
from conftest_data import words

from spillway.llm import jaccard_join


def brute(rows):
    sets = []
    for doc_id, text, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[find(i)] = min(a, least.get(find(i), a))
    return sorted(((a, len(s), None if a is None else least[find(i)]) for i, (a, s) in enumerate(sets)), key=str)


def corpus(seed, n_groups, group):
    r, rows, k = random.Random(seed), [], 0
    passage = words(30, 999)
    for g in range(n_groups):
        base = words(r.randint(6, 120), seed * 1000 + g)
        for _ in range(r.randint(1, group)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(("x", "Y", "changed"))
            if r.random() < 0.3:
                w = passage + w
            rows.append((k, (" " if r.random() < 0.5 else "\n").join(w), "en", "s"))
            k += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("short,block,degree", [(2, 3, 2), (16, 2000, 2000)])
def test_components_match_brute_force(documents, odd_rows, monkeypatch, short, block, degree):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "DEGREE", degree)
    rows = corpus(short, 12, 30) + [(10_000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in odd_rows]
    out = sorted(map(tuple, jaccard_join.join(documents(rows)).collect()), key=str)
    assert out == brute(rows)


def test_empty_and_unlinked(documents):
    assert jaccard_join.join(documents([])).count() == 0
    assert sorted(map(tuple, jaccard_join.join(documents([(1, None, None, None), (2, "", None, None)])).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_bitmap_bound_is_an_upper_bound():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(50):
        pool = r.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(r.choice(pool, r.integers(1, 390))) for _ in range(2))
        assert jaccard_join.most_common(jaccard_join.sketch(a), jaccard_join.sketch(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_stage_keeps_one_of_each_group(documents, odd_rows):
    docs = documents(corpus(4, 5, 8) + [(500, "same id one two three four", "en", "s"), (500, "same id one two three four", "en", "s"), (501, None, None, None), (None, "x", None, None)])
    out = jaccard_join.keep_one(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    want = {c for _, _, c in brute([tuple(r)[:2] for r in docs.select("doc_id", "text").collect()])}
    assert set(kept) == want and len(kept) == len(want)


def test_rows_of_one_identifier_are_told_apart_by_their_text(documents):
    a, b, c = ("one two three four five six seven eight", "alpha beta gamma delta epsilon zeta eta theta", "red green blue black white brown pink grey")
    docs = documents([(7, a, "en", "s"), (7, a + " ", "en", "t"), (7, b, "en", "s"), (3, b, "en", "s"), (9, c, "en", "s"), (9, None, "en", "s"), (9, None, "en", "s"), (8, a, "en", "s")])
    kept = sorted((r["doc_id"], (r["text"] or "").split(" ")[0]) for r in jaccard_join.keep_one(docs).collect())
    assert kept == [(3, "alpha"), (7, "one"), (7, "one"), (9, ""), (9, "red")] or kept == [(3, "alpha"), (7, "one"), (9, ""), (9, "red")]
    assert jaccard_join.keep_one(documents([])).count() == 0
