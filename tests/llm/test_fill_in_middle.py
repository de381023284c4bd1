import random
import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spillway.llm import fill_in_middle as fim


def brute(doc_id, text):
    """The definition over a whole array of units."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**12), st.text(alphabet="ab Z<>PSMé\n\t😀1", max_size=60))
def test_matches_the_definition(doc_id, text):
    assert fim.transform(doc_id, text) == brute(doc_id, text)


def test_all_ranks_of_the_lazy_iterator():
    text = "one, two\n\nthree  é4 five"
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert fim.count_units(text) == len(units)
    for a in range(len(units) + 1):
        for b in range(a, len(units) + 1):
            assert fim.cut_points(text, a, b) == (len("".join(units[:a])), len("".join(units[:b])))


def test_whole_table(documents, odd_rows):
    r = random.Random(3)
    rows = odd_rows + [(100 + k, "".join(r.choice(["ab", "C", " ", "<", ">", "P", "S", "M", "<S", "<P>", "<M", "é", "\n", "😀"]) for _ in range(r.randint(0, 40))), "en", "a") for k in range(300)]
    rows.append((900, "word 7 " * 200_000, "en", "a"))
    made = fim.transformed(documents(rows))
    out = sorted(map(tuple, fim.digests(made).collect()), key=str)
    sha = lambda t: sha256(t.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        *head, output = brute(i, t)
        want.append((i, *head, sha(output), sha(t or "")))
    assert out == sorted(want, key=str)
    assert {x[2] for x in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("flush", [1, 50])
def test_batches_are_bounded(documents, odd_rows, monkeypatch, flush):
    monkeypatch.setattr(fim, "FLUSH", flush)
    made = fim.transformed(documents(odd_rows))
    assert made.count() == len(odd_rows)
    assert fim.transformed(documents([])).count() == 0
