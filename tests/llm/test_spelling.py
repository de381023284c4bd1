import random
from collections import Counter
from zlib import crc32

import pytest

from spillway.llm import spelling

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100))


def brute_words(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "\xc0" <= c <= "\xff":
                run += c.lower() if "A" <= c <= "Z" else c
            elif run:
                h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
                if len(word) >= 6:
                    total[word] += 1
                run = ""
    return {w: n for w, n in total.items() if n >= 5}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def brute(rows):
    words = brute_words(rows)
    out, form = [], {}
    for w, n in words.items():
        others = [x for x in words if x != w and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out.append((w, n, len(others)))

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, k, words.get(form[w])) for w, n, k in out)


def mutated(r, w):
    k, c = r.randrange(len(w) + 1), r.choice(LETTERS)
    return r.choice((w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]))


def corpus(seed, n=60):
    r, rows = random.Random(seed), []
    words = ["aaaaaaa", "aaaaaaaa", "aaabaaa", "abababab", "babababa", "straße", "straßen", "naïveté", "x" * 300, "x" * 301]
    words += ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(40)]
    for w in list(words):
        words += [mutated(r, w) for _ in range(3)]
    for k in range(n):
        rows.append((k, " ".join(r.choice(words[: 1 + r.randrange(len(words))]).title() if r.random() < 0.1 else r.choice(words[: 1 + r.randrange(len(words))]) for _ in range(80)), "en", "s"))
    return rows


@pytest.mark.parametrize("block,scan", [(3, 2), (2000, 12)])
def test_matches_brute_force(documents, odd_rows, monkeypatch, block, scan):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "SCAN", scan)
    chain = [(1000 + k, "chainword " * 3 + "chainworde " * 20 + "chainwordes " * 150, None, None) for k in range(3)]
    rows = corpus(block) + odd_rows + odd_rows + chain
    out = sorted(map(tuple, spelling.variants(documents(rows)).collect()))
    want = brute(rows)
    assert out == want
    assert any(x[1] and x[1] != x[2] for x in out)  # a chain of two forms


def test_every_pair_is_found_once(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 5)
    monkeypatch.setattr(spelling, "SCAN", 3)
    r = random.Random(1)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 8))) for _ in range(300)})
    found = [(x[0], x[1]) for x in spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(u, v) for u in words for v in words if u != v and near(u, v)}


def test_empty(documents):
    assert spelling.variants(documents([])).count() == 0
    assert spelling.variants(documents([(1, None, "en", "a"), (2, "", None, None)])).count() == 0
