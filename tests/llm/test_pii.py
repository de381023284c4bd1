import hashlib
import re

import numpy as np
import pytest

from spillway.llm import pii

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # noqa: E741
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = [
    "write to a.b+c@mail7.example.com, or x@y.z+d@e.f now", "x@y_z.com a@b @c.d e@f.g-h", "host 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5.6.7.8", "001.002.003.0000255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 41111111111111111111111", "12 4111111111111111", "call +1 (017) 555-7713, +12, +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++49 30 1234567)", "é日本 x@y.de é +49 (0)30 123456 𝒳 1.1.1.1", "5" * 3000, "1 " * 3000, "a." * 3000 + "@x.y", None, "",
]


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in E.finditer(text)]
    out += [("ip", m) for m in I.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in C.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in P.finditer(text) if 8 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_base_spans_as_by_the_plain_patterns(documents):
    docs = documents([(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    out = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = base(t or "")
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, out[i]["spans"], want)
        assert set(want) <= set(filter(None, out[i]["spans"].split(",")))
        assert out[i]["n_card"] == sum(w.startswith("card") for w in want)
    assert pii.find(documents([])).count() == 0


def test_trees_learn_and_become_sql(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 4, size=(400, len(pii.FEATURES)))
    y = ((x[:, 1] > 1) & (x[:, 6] > 0)).astype(float)
    score = np.zeros(400)
    for _ in range(pii.TREES):
        p = 1 / (1 + np.exp(-score))
        tree = pii._grow(x, y - p, p * (1 - p), 2)
        score += pii._apply(tree, x)
    assert ((score > 0) == (y > 0)).mean() > 0.98
    model = pii.Model([tree], 0.5, {})
    df = spark.createDataFrame([tuple(map(int, row)) for row in x], list(pii.FEATURES)).selectExpr(f"struct({', '.join(pii.FEATURES)}) AS x")
    got = [row[0] for row in df.selectExpr(model.sql("x")).collect()]
    assert np.allclose(got, 0.5 + pii._apply(tree, x), atol=1e-6)


def test_redaction_keeps_columns_and_nulls(documents, odd_rows):
    docs = documents([*odd_rows, (50, "mail a@b.co or +49 30 1234567 ok", "en", "s")])
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[50] == "mail <EMAIL> or <PHONE> ok" and rows[3] is None and rows[1] == odd_rows[0][1]
    assert out.count() == docs.count()


HIDDEN = [
    ("email", "jane (at) host (dot) org"), ("email", "jo.do[at]mail.example.com"), ("phone", "555-123-4567"), ("phone", "(030) 123 4567"), ("ip", "2001:db8:0:0:8:800:200c:417a"), ("card", "3782 822463 10005"),
]


@pytest.mark.parametrize("n_base, n_hidden", [(400, 1), (400, 400), (4, 400), (0, 40)])
def test_hidden_data_is_selected_at_any_prevalence(documents, n_base, n_hidden):
    texts = ["write a@b.co, call +49 30 1234567, host 10.0.0.1, card 4111 1111 1111 1111"] * n_base
    texts += [f"we saw {v} there" for _, v in HIDDEN] * n_hidden
    other = ["sale (at) noon. Then home", "rows 12 345 678 of it", "part 55-123-4567-89 here", "300.400.1.2 is none", "id 1234567890123 kept"] * 200
    docs = documents([(i, t, "en", "s") for i, t in enumerate([*texts, *other])])
    out = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    for i, t in enumerate([*texts, *other]):
        if n_base <= i < len(texts):
            kind, v = HIDDEN[(i - n_base) % len(HIDDEN)]
            assert out[i] == f"{kind}:7:{7 + len(v)}", t
        elif i >= len(texts):
            assert out[i] == "", t


def test_a_telling_word_makes_a_possible_number_personal(documents):
    texts = ["tel 12 345 6789 ok", "rows 12 345 6789 ok"] * 30
    out = {r["doc_id"]: r["spans"] for r in pii.find(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert all(out[i] == ("" if i % 2 else "phone:4:15") for i in range(60))


def test_thresholds_cover_candidates_beyond_the_sample(documents, monkeypatch):
    monkeypatch.setattr(pii, "MODEL_ROWS", 2)
    texts = ["write a@b.co now"] * 300 + ["we saw jane (at) host (dot) org"] * 9 + ["tel 12 345 6789 ok", "rows 12 345 6789 ok"] * 9
    out = {r["doc_id"]: r["spans"] for r in pii.find(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert all(out[i] == "email:7:31" for i in range(300, 309))
    assert all(out[i] == "" for i in range(309, len(texts)))


def test_places_learnt_from_base_spans_select_what_no_rule_names(documents):
    known = ["ruf +49 30 1234567 an"] * 60 + ["knoten 10.20.30.40 lauft"] * 60 + ["post anna.b@mail.example.com raus"] * 60
    hidden = ["ruf 030 123 4567 an", "knoten fe80::1ff:23:4 lauft", "post jane at host dot org raus"] * 15
    alike = ["wert 030 123 4567 stk", "teil fe80::1ff:23:4 lang", "halt wait at stop dot two hier"] * 40
    texts = [*known, *hidden, *alike]
    docs = documents([(i, t, "de", "s") for i, t in enumerate(texts)])
    seeds = pii._real(pii.candidates(docs)).filter("seed").count()
    out = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    want = ["phone:4:16", "ip:7:21", "email:5:25"]
    n = len(known)
    assert seeds == 0 and [out[i] for i in range(n, n + len(hidden))] == want * 15
    assert not any(out[i] for i in range(n + len(hidden), len(texts)))


def test_context_levels_as_by_counting(documents, spark):
    texts = ["ruf +49 30 1234567 an"] * 20 + ["die uhr geht vor und die zeit vergeht"] * 40 + [None, ""]
    docs = documents([(i, t, "de", "s") for i, t in enumerate(texts)])
    got = pii.contexts(pii.candidates(docs), docs)
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in ("ruf", "die")], "w string").select("w", pii._bucket(pii.F.col("w")).alias("b")).collect()}
    lift = (20 + pii.SHRINK) / (20 * 20 / (20 * 2 + 40 * 8) + pii.SHRINK)
    assert int(got[3][bucket["ruf"]]) == int(np.log2(lift)) == 1 and got[3][bucket["die"]] == "0"
    assert got[0] == "0" * pii.BUCKETS


def test_rewritten_base_spans_are_proposed_by_the_wider_patterns(spark):
    values = {"email": [f"a.{i}@m{i}.example.com" for i in range(9)], "ip": [f"10.{i}.0.7" for i in range(9)], "card": ["4111111111111111", "4111-1111-1111-1111"], "phone": [f"+49 30 12345{i:02}" for i in range(9)]}
    for kind, vs in values.items():
        df = spark.createDataFrame([(v,) for v in vs], "v string").select(pii._rewritten(kind, pii.F.col("v")).alias("r"))
        found = df.select("r", pii.F.regexp_extract(pii.F.concat(pii.F.lit("x "), "r", pii.F.lit(" y")), pii.WIDER[kind], 0).alias("m")).collect()
        assert all(row["m"] and row["m"].endswith(row["r"]) for row in found), (kind, found)
