"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

1. Generators. Per kind, the base pattern and wider ones (written-out addresses, compressed IPv6, numbers without plus
   sign, chains that fail a check digit) propose spans, which may overlap. A span's place follows from the lengths of the
   pieces between the matches, so no text leaves its row; texts without a digit or an at sign are not searched.
2. Labels. Every base span is a positive, and once more in a wider form: rewritten (the address spelled out, IPv4 as
   IPv6, other separators, no plus sign) and described in its own place. A few seeds are positives too: further
   candidates whose form hardly anything else has, or whose form is possible with a known word before it. Negatives are
   further candidates whose form is impossible, or that stand where nothing tells of the kind. The rest, possible forms
   in telling places, is unlabelled and left to the trees. The seeds' rules (form, word list) are no features.
3. Features. Format (digits, separators, dots, plus sign, check digit, octets, at sign, colons), the characters beside,
   and context: how much more often the last WORDS words before it stand before positives of its kind than anywhere in
   the documents. Words are hashed to BUCKETS; both counts cover all documents, so every language teaches its own words.
4. Model. The distinct combinations of features are counted over all documents, and boosted trees of depth two are fitted
   to the most frequent MODEL_ROWS of one half of the documents. Labels, and base spans, rewritten ones and further
   candidates, weigh alike within a kind, however many there are of each.
5. Thresholds. Over all combinations on the other half, each kind gets the least score, from even odds up, above which at
   most 1 - PRECISION of the candidates that can be added are negatives: base spans and what overlaps them are not
   counted. A kind with nothing to add there takes both halves.
6. Selection. Base spans stay. A further candidate is added if its score passes its kind's threshold and it overlaps
   neither a base span nor another that passes and is longer (then of better score, earlier kind, earlier start).

The trees become one SQL expression, evaluated on the few candidates within their row; only counts are shuffled.

Cases: null text is empty and has no spans; repeated rows and null identifiers keep their rows; an empty table gives no
rows and no model; texts are searched whole, in time linear in their length but for the spans found; other columns
are kept by redacted() and not read by find().
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The bound of the sample of candidates that the trees are fitted on: distinct combinations of features.
MODEL_ROWS = 50_000
PRECISION = 0.99
#: Context: the last words before a span, hashed, and the count that a bucket's lift is drawn to one by.
WORDS, BUCKETS, SHRINK = 3, 4096, 8
TREES, RATE = 24, 0.3
#: Thresholds are multiples of 1 / STEPS, a power of two, so they are exact in nine decimals.
STEPS = 512
#: The contract's patterns. Possessive, and begun only where a match can begin, they find the same spans in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider patterns: what base patterns miss or what resembles them.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?+(?:\(at\)|\[at\]|\{at\}) ?+[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++| ?+\. ?+[a-z0-9][A-Za-z0-9-]*+| ?+(?:\(dot\)|\[dot\]) ?+[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+|(?:[0-9A-Fa-f]{1,4}+:){1,6}(?::[0-9A-Fa-f]{1,4}+){1,6}+)(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ .-])[0-9](?:[ .-]?+[0-9]){12,}+",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])",
}
_GATE = {"email": ("@", r"\(at\)|\[at\]|\{at\}| at [A-Za-z0-9-]++ dot "), "ip": ("[0-9]", ":[0-9A-Fa-f]{0,4}:"), "card": ("[0-9]", "[0-9]"), "phone": (r"\+[0-9]", "[0-9]")}
_TELLING = {
    "email": r"(?i)\b(?:e-?mail|mail|mailto|contact|write|reach|addr|address)\b",
    "ip": r"(?i)\b(?:ip|ipv4|ipv6|host|addr|address|server)\b",
    "card": r"(?i)\b(?:cards?|visa|mastercard|amex|credit|debit)\b",
    "phone": r"(?i)\b(?:tel|telefon|telephone|phones?|call|calling|fax|mobile|cell|contact)\b",
}
#: Shapes of issued card numbers, and phone and card numbers written in the groups that hardly anything else has.
_ISSUED = r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|6\d{15,18})$"
_CARD_GROUPS = r"^(?:\d{4}([ .-])\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ .-])\d{6}\2\d{5})$"
_PHONE_GROUPS = r"^(?:\([0-9]{3}\)[ .-][0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})$"
_PHONE_SHAPE = r"^(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3}[ .-]?[0-9]{3,4}$"
FEATURES = ("kind", "digits", "seps", "dots", "plus", "luhn", "octets", "at", "colons", "left", "right", "context")
#: Features that a span has by itself, before its words' counts are known.
_OWN = FEATURES[1:-1]

_SPAN = "struct<s:int,e:int,v:string>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """The check digit of the digits in v is right."""
    d = F.reverse(_digits(v))

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = 2 * x
        return total + F.when(i % 2 == 1, x).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0


def _octets(v: Column) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(p == "", 0).otherwise(F.substring(p, 1, 3).cast("int")) <= 255))


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    return {"email": F.lit(True), "ip": _octets(v), "card": n.between(16, 19) & F.when(n.between(16, 19), _luhn(v)).otherwise(False), "phone": n.between(8, 15)}[kind]


def _form(kind: str, v: Column) -> Column:
    """0 not of the kind, 1 possibly of the kind, 2 hardly anything else. For labels only; base spans are labelled without it."""
    if kind == "email":
        spoken = v.rlike(" at .* dot [A-Za-z]{2,24}$")
        ends = v.rlike(r"[(\[{]at[)\]}]") & v.rlike(r"(?:\.|[)\]]) ?[A-Za-z]{2,24}$")
        return F.when(ends, F.when(v.rlike(r" \.|\. "), 1).otherwise(2)).when(spoken, 1).otherwise(0)
    if kind == "ip":
        groups = v.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
        return F.when(groups, F.when(v.rlike("[0-9A-Fa-f]{3}"), 2).otherwise(1)).when(v.rlike("::"), 1).otherwise(0)
    if kind == "card":
        d = _digits(v)
        issued = d.rlike(_ISSUED) & F.when(F.length(d).between(12, 19), _luhn(v)).otherwise(False)
        return F.when(issued, F.when(v.rlike(_CARD_GROUPS), 2).otherwise(1)).otherwise(0)
    return F.when(v.rlike(_PHONE_GROUPS), 2).when(v.rlike(_PHONE_SHAPE) & F.length(_digits(v)).between(8, 11), 1).otherwise(0)


def _rewritten(kind: str, v: Column) -> Column:
    """A base span's value in a form that only the wider patterns propose; which one depends on the value."""
    turn = F.pmod(F.crc32(v), F.lit(3))
    if kind == "email":
        name, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
        spelled = F.concat(name, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) ")))
        spoken = F.concat(name, F.lit(" at "), F.replace(host, F.lit("."), F.lit(" dot ")))
        return F.when(turn == 0, F.concat(name, F.lit("[at]"), host)).when(turn == 1, spelled).otherwise(spoken)
    if kind == "ip":
        part = lambda i: F.element_at(F.split(v, r"\."), i).try_cast("long")
        pair = lambda i: F.lower(F.hex(part(i) * 256 + part(i + 1)))
        return F.concat(F.when(turn == 0, "2001:db8:0:0:0:0:").when(turn == 1, "2001:db8::").otherwise("fe80::"), pair(1), F.lit(":"), pair(3))
    d = _digits(v)
    if kind == "card":
        return F.regexp_replace(d, "([0-9]{4})(?=[0-9])", "$1.")
    return F.when(turn == 0, F.regexp_replace(F.right(d, F.lit(10)), "^([0-9]{2,3})([0-9]{3})([0-9]{3,4})$", "($1) $2 $3")).otherwise(
        F.regexp_replace(F.right(d, F.lit(10)), "^([0-9]{2,3})([0-9]{3})([0-9]{3,4})$", F.when(turn == 1, "$1-$2-$3").otherwise("$1 $2 $3"))
    )


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def lambda_of(f, first):
    """f with its first argument fixed, as a function of one column."""
    return lambda x: f(first, x)


def _checks(kind: str):
    return lambda x: _valid(kind, x["v"])


def _places(found: str, gaps: str) -> Column:
    """Spans of the matches in column `found`, from the lengths in column `gaps` of the pieces before each of them."""
    return F.expr(
        f"aggregate(sequence(1, size({found})), named_struct('at', 0, 'out', cast(array() as array<{_SPAN}>)), (a, i) -> named_struct("
        f"'at', cast(a.at + element_at({gaps}, i) + length(element_at({found}, i)) as int), "
        f"'out', concat(a.out, array(cast(named_struct('s', a.at + element_at({gaps}, i), 'e', a.at + element_at({gaps}, i) + length(element_at({found}, i)), 'v', element_at({found}, i)) as {_SPAN})))), a -> a.out)"
    )


def _side(c: Column) -> Column:
    """0 nothing or white space, 1 letter, 2 digit, 3 other."""
    return F.when(c.isNull() | (F.trim(c) == ""), 0).when(c.rlike("[0-9]"), 2).when(c.rlike("\\p{L}"), 1).otherwise(3)


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, base (array of kind, s, e), wide (array of kind, s, e and what is known of a candidate, base spans
    included) and forms (the like of base spans in a wider form, at their own places)."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")
    cols = {}
    for name, patterns, gate in (("b", BASE, 0), ("w", WIDER, 1)):
        for kind in KINDS:
            p, open_ = patterns[kind], F.col("_text").rlike(_GATE[kind][gate])
            cols[f"_{name}m_{kind}"] = F.when(open_, F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none)
            cols[f"_{name}g_{kind}"] = F.when(open_, F.transform(F.split("_text", p, -1), F.length))
    df = df.withColumns(cols)
    places = {}
    for name in "bw":
        for kind in KINDS:
            m, g = f"_{name}m_{kind}", f"_{name}g_{kind}"
            places[f"_{name}_{kind}"] = F.when(F.size(m) > 0, _places(m, g)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    df = df.withColumns(places).drop(*cols)
    base = {f"_v_{kind}": F.filter(f"_b_{kind}", _checks(kind)) for kind in KINDS}
    df = df.withColumns(base)
    bare = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    df = df.withColumn("base", F.concat(*[F.transform(f"_v_{kind}", bare(k)) for k, kind in enumerate(KINDS)]))

    def described(k: int, x: Column) -> Column:
        v, n = x["v"], F.length(_digits(x["v"]))
        flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        before = F.substring(F.col("_text"), F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
        values = {
            "digits": F.least(n, F.lit(20)),
            "seps": F.least(F.length(v) - F.length(F.translate(v, " ()-", "")), F.lit(6)),
            "dots": F.least(F.length(v) - F.length(F.translate(v, ".", "")), F.lit(4)),
            "plus": flag(F.startswith(v, F.lit("+"))),
            "luhn": flag(F.when(n.between(12, 19), _luhn(v))),
            "octets": flag(F.when(v.rlike(r"^[0-9]+(\.[0-9]+){3}$"), _octets(v))),
            "at": flag(F.contains(v, F.lit("@"))),
            "colons": F.least(F.length(v) - F.length(F.translate(v, ":", "")), F.lit(8)),
            "left": _side(F.when(x["s"] > 0, F.substring(F.col("_text"), x["s"], F.lit(1)))),
            "right": _side(F.when(x["e"] < F.length("_text"), F.substring(F.col("_text"), x["e"] + 1, F.lit(1)))),
            "telling": flag(before.rlike(_TELLING[KINDS[k]])),
        }
        # A link of a longer chain of numbers is none of the kinds; 1 may come before a phone number.
        chained = before.rlike(r"(?:(?<![0-9])[02-9]|[0-9]{2})[-./]$") | F.substring(F.col("_text"), x["e"] + 1, F.lit(2)).rlike("^[-./:][0-9]")
        beside = values["left"].isin(1, 2) | values["right"].isin(1, 2)
        values["form"] = F.when(F.lit(k > 0) & (chained | beside), 0).otherwise(_form(KINDS[k], v))
        near = _words(F.substring(F.col("_text"), F.greatest(x["s"] - 47, F.lit(1)), F.least(x["s"], F.lit(48))))
        last = F.transform(F.slice(near, F.greatest(F.size(near) - (WORDS - 1), F.lit(1)), F.lit(WORDS)), _bucket)
        return F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), *[c.cast("int").alias(name) for name, c in values.items()], last.alias("words"))

    def other(kind: str):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _rewritten(kind, x["v"]).alias("v"))

    wide = [F.transform(f"_{name}_{kind}", lambda_of(described, k)) for k, kind in enumerate(KINDS) for name in "bw"]
    df = df.withColumns({f"_r_{kind}": F.transform(f"_v_{kind}", other(kind)) for kind in KINDS})
    forms = [F.transform(f"_r_{kind}", lambda_of(described, k)) for k, kind in enumerate(KINDS)]
    df = df.withColumns({"wide": F.array_distinct(F.concat(*wide)), "forms": F.concat(*forms)})
    return df.select(*keep, "base", "wide", "forms")


class Model:
    """Boosted trees over small integers, as nested (feature, threshold, below, above) or leaf values; a threshold a kind."""

    def __init__(self, trees: list, start: float, limits: dict[int, float]):
        self.trees, self.start, self.limits = trees, start, limits

    def sql(self, x: str) -> str:
        """The score of the candidate in lambda variable x."""

        def of(node) -> str:
            if isinstance(node, float):
                return f"{node:.9f}D"
            f, at, low, high = node
            return f"CASE WHEN {x}.{f} <= {at} THEN {of(low)} ELSE {of(high)} END"

        return " + ".join([f"{self.start:.9f}D", *[f"({of(t)})" for t in self.trees]])


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(RATE * g.sum() / (h.sum() + 1.0))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients g and curvatures h, by histograms of the integer features."""
    best = (1e-9, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1] if depth else 0):
        gs, hs = np.bincount(x[:, f], g).cumsum()[:-1], np.bincount(x[:, f], h).cumsum()[:-1]
        if len(gs):
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
    _, f, at = best
    if f is None:
        return _leaf(g, h)
    low = x[:, f] <= at
    return (FEATURES[f], at, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _apply(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    f, at, low, high = node
    return np.where(x[:, FEATURES.index(f)] <= at, _apply(low, x), _apply(high, x))


def _real(found: DataFrame) -> DataFrame:
    """half, x and grp (1 base span, 0 further candidate clear of them) and seed, of all candidates in place."""
    one = found.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), "base", F.explode("wide").alias("x"))
    is_base = F.exists("base", lambda b: (b["kind"] == F.col("x.kind")) & (b["s"] == F.col("x.s")) & (b["e"] == F.col("x.e")))
    clear = ~F.exists("base", lambda b: (b["s"] < F.col("x.e")) & (F.col("x.s") < b["e"]))
    seed = (F.col("x.form") == 2) | ((F.col("x.form") == 1) & (F.col("x.telling") == 1))
    one = one.withColumn("grp", is_base.cast("int")).filter((F.col("grp") == 1) | clear)
    return one.select("half", "x", "grp", ((F.col("grp") == 0) & seed).alias("seed"))


def contexts(found: DataFrame, docs: DataFrame) -> list[str]:
    """A string of digits a kind: for each bucket of words, how many times its share before positives doubles that in all texts."""
    positive = _real(found).filter("grp = 1 OR seed").select(F.col("x.kind").alias("kind"), F.explode("x.words").alias("b")).groupBy("kind", "b").count().collect()
    if not positive:
        return ["0" * BUCKETS] * len(KINDS)
    words = docs.select(F.explode(_words(F.col("text"))).alias("w")).groupBy(_bucket(F.col("w")).alias("b")).count().collect()
    before, everywhere = np.zeros((len(KINDS), BUCKETS)), np.zeros(BUCKETS)
    for r in positive:
        before[r["kind"], r["b"]] = r["count"]
    for r in words:
        everywhere[r["b"]] = r["count"]
    expected = before.sum(axis=1, keepdims=True) * everywhere / max(everywhere.sum(), 1.0)
    level = np.log2((before + SHRINK) / (expected + SHRINK)).clip(0, 6).astype(int)
    return ["".join(map(str, row)) for row in level]


def _described(found: DataFrame, tables: list[str]) -> DataFrame:
    """candidates() with the context of each."""
    digit = f"cast(substring(element_at(array({', '.join(repr(t) for t in tables)}), x.kind + 1), w + 1, 1) as int)"
    context = f"aggregate(x.words, 0, (a, w) -> greatest(a, {digit}))"
    own = ", ".join(f"'{f}', x.{f}" for f in ("kind", "s", "e", *_OWN, "telling", "form", "words"))
    return found.withColumns({c: F.expr(f"transform({c}, x -> named_struct({own}, 'context', {context}))") for c in ("wide", "forms")})


def _counted(found: DataFrame) -> DataFrame:
    """half, features, grp (0 further candidate, 1 base span, 2 rewritten one), label (null: unlabelled) and n."""
    real = _real(found)
    label = F.when((F.col("grp") == 1) | F.col("seed"), 1).when((F.col("x.form") == 0) | (F.col("x.context") == 0), 0)
    other = found.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), F.explode("forms").alias("x"))
    both = real.select("half", "x", "grp", label.alias("label")).unionAll(other.select("half", "x", F.lit(2).alias("grp"), F.lit(1).alias("label")))
    return both.groupBy("half", *[F.col(f"x.{f}").alias(f) for f in FEATURES], "grp", "label").agg(F.count(F.lit(1)).alias("n"))


def _even(w: np.ndarray, *groups: np.ndarray) -> np.ndarray:
    """w with the same sum in every group that occurs, the largest group's."""
    _, g = np.unique(np.column_stack(groups), axis=0, return_inverse=True)
    total = np.bincount(g.ravel(), w)
    return w * (total.max() / total)[g.ravel()]


def fit(found: DataFrame) -> Model | None:
    """found: candidates() with contexts. None if none of them is labelled."""
    counted = materialize(_counted(found), "pii-counted")
    rows = counted.filter("label IS NOT NULL").orderBy(F.desc("n"), "half", *FEATURES, "grp", "label").limit(MODEL_ROWS).collect()
    if not rows:
        return None
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    y, w, half, group = (np.array([float(r[c]) for r in rows]) for c in ("label", "n", "half", "grp"))
    fit_on = half == 0 if (half == 0).any() else half == 1
    xs, ys = x[fit_on], y[fit_on]
    ws = _even(w[fit_on], xs[:, 0], ys, group[fit_on])
    share = min(max(float((ws @ ys) / ws.sum()), 0.01), 0.99)
    start = math.log(share / (1 - share))
    score, trees = np.full(len(xs), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(xs, ws * (ys - p), ws * p * (1 - p), 2)
        trees.append(tree)
        score += _apply(tree, xs)
    return Model(trees, start, _limits(counted, Model(trees, start, {}), int(half[fit_on][0])))


def _limits(counted: DataFrame, model: Model, fitted: int) -> dict[int, float]:
    """Each kind's threshold over all counted candidates that can be added, in steps of a score of 1 / STEPS."""
    x = F.struct(*FEATURES).alias("x")
    step = F.expr(f"floor(({model.sql('x')}) * {STEPS})")
    df = counted.filter("grp = 0").select("half", "label", "n", x).select("half", F.col("x.kind").alias("kind"), step.alias("step"), "label", "n")
    rows = df.groupBy("kind", "half", "step").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == 0, 0).otherwise(F.col("n"))).alias("good")).collect()
    limits = {}
    for k in range(len(KINDS)):
        own = [r for r in rows if r["kind"] == k and r["step"] >= 0]
        if any(r["good"] and r["half"] != fitted for r in own):
            own = [r for r in own if r["half"] != fitted]
        own.sort(key=lambda r: -r["step"])
        n = good = 0
        limits[k] = math.inf
        for i, r in enumerate(own):
            n, good = n + r["n"], good + r["good"]
            below = own[i + 1]["step"] if i + 1 < len(own) else -1
            if below != r["step"] and good and good >= PRECISION * n:
                limits[k] = (below + 1) / STEPS
    return limits


def select(found: DataFrame, model: Model | None) -> DataFrame:
    """Adds `added` (kind, s, e) to candidates() with contexts: what the model selects beside the base spans."""
    if model is None or all(math.isinf(v) for v in model.limits.values()):
        return found.withColumn("added", F.array().cast("array<struct<kind:int,s:int,e:int>>"))
    scored = F.expr(f"transform(wide, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'p', {model.sql('x')}))")
    passes = " OR ".join(f"(x.kind = {k} AND x.p >= {v:.9f}D)" for k, v in model.limits.items() if not math.isinf(v))
    clear = "NOT exists(base, b -> b.s < x.e AND x.s < b.e)"
    better = "struct(x.s - x.e, -x.p, x.kind, x.s) > struct(y.s - y.e, -y.p, y.kind, y.s)"
    out = found.withColumn("_scored", scored).withColumn("_passed", F.expr(f"filter(_scored, x -> ({passes}) AND {clear})"))
    best = F.expr(f"filter(_passed, x -> NOT exists(_passed, y -> y.s < x.e AND x.s < y.e AND {better}))")
    return out.withColumn("added", F.transform(best, lambda x: F.struct(x["kind"], x["s"], x["e"]))).drop("_scored", "_passed")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    found = materialize(candidates(docs), "pii-candidates")
    found = _described(found, contexts(found, docs))
    chosen = select(found, fit(found))
    n = {f"n_{kind}": F.size(F.filter("base", lambda_of(lambda k, x: x["kind"] == k, k))).cast("long") for k, kind in enumerate(KINDS)}
    bare = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return chosen.select("doc_id", *[c.alias(name) for name, c in n.items()], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat(bare("base"), bare("added"))).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; all columns stay, null texts too.

    Overlapping spans of different kinds are replaced together, under the kind of the first. The row travels as one
    column, so its names can't clash.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    found = materialize(candidates(packed, ("_row", "doc_id")), "pii-documents")
    found = _described(found, contexts(found, docs)).withColumn("text", F.col("_row.text"))
    chosen = select(found, fit(found))
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    names_of = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(a: Column, x: Column) -> Column:
        mark = F.element_at(names_of, x["kind"] + 1)
        piece = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["s"] - a["at"]), mark)
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], piece).otherwise(a["out"]).alias("out"))

    tail = lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    text = F.when(F.col("text").isNotNull() & (F.size("_spans") > 0), F.aggregate("_spans", start, cut, tail)).otherwise(F.col("text"))
    done = chosen.withColumn("_spans", spans).withColumn("_text", text)
    return done.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
