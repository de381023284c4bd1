"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word backs off to character n-grams of the
word between boundary marks: the longest order, from five characters down to one, of which it has a known n-gram, decides
by the mean log frequency of those; a mark alone is no n-gram. A word of which nothing is known says nothing. A text's
score for a language is the sum over all its words; the prediction is the best language (ties: the first by name),
`score` the posterior under equal priors, or 0 if nothing is known of any word.

Fitting uses a bounded sample of labelled rows: about PER_LANGUAGE rows of each language, chosen by a hash of the
identifier. All their words and n-grams are kept, by 64-bit hashes, with a frequency for each language that has them, so
the model is as large as the sample's vocabulary. Its number of languages is the number of distinct labels. Every row is
predicted on its whole text.

Cases: null texts and texts without a letter are `und` with score 0, and so is every text where no labelled row exists;
null languages and null identifiers are never learned from; repeated rows are predicted alike; other columns are not
read, and the stage adds none, so no name can clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

#: The bound of the sample that the model is fitted on, in rows of each language.
PER_LANGUAGE = 500
LONGEST = 5
UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_ASCII = re.compile("[a-z]+")
_CHUNK = 500_000
_MARKS = (ord("^"), ord("$"))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def held_out():
    """Rows whose crc32 of the identifier as text leaves remainder 2 by 4; they are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _words(text: str):
    """Words of the whole text, in lists of bounded length."""
    pattern = _ASCII if text.isascii() else _WORD
    if len(text) < _CHUNK:
        yield pattern.findall(text.lower())
        return
    found = pattern.finditer(text.lower())
    while words := [m[0] for m in islice(found, _CHUNK)]:
        yield words


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of whole words, order 0."""
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)


class Grams:
    """The marked words one after the other, and their n-grams of any order as (word, hash)."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32)
        self.word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])

    def of(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.codes) - order + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = self.word[:n] == self.word[order - 1 :]
        if order == 1:
            inside = ~np.isin(self.codes, _MARKS)
        at = np.flatnonzero(inside)
        h = np.full(len(at), order, np.uint64)
        for k in range(order):
            h = (h ^ (h >> np.uint64(29))) * _BASE + self.codes[at + k].astype(np.uint64) * _MIX
        return self.word[at], h ^ (h >> np.uint64(32))


class LanguageModel:
    """Log frequencies of known words (order 0) and n-grams: a row each, with the languages that have it."""

    def __init__(self, languages: list[str], lang: np.ndarray, order: np.ndarray, gram: np.ndarray, n: np.ndarray):
        """Counts in columns: place of the language in languages (sorted by name), order, hash and count."""
        self.languages = languages
        at = np.argsort(gram, kind="stable")
        lang, order, gram, n = lang[at], order[at], gram[at], n[at].astype(np.float64)
        self.grams, first = np.unique(gram, return_index=True)
        self.begin = np.append(first, len(gram))
        self.lang = lang.astype(np.int32)
        self.value = (np.log(n + 0.5) - math.log(0.5)).astype(np.float32)
        total = np.zeros((LONGEST + 1, max(1, len(languages))))
        np.add.at(total, (order, lang), n)
        distinct = np.bincount(order[first], minlength=LONGEST + 1)[:, None]
        #: What a language without a count gives; `value` is what a count adds.
        self.rest = math.log(0.5) - np.log(np.maximum(total + 0.5 * distinct, 0.5))

    @classmethod
    def of(cls, counts: list[tuple[str, int, str, int]]) -> LanguageModel:
        """From (language, order, gram, count), grams as text with their marks."""
        languages = sorted({c[0] for c in counts})

        def hashed(order: int, gram: str) -> np.uint64:
            if not order:
                return word_hashes([gram])[0]
            g = Grams([gram.strip("^$")])
            word = f"^{gram.strip('^$')}$"
            at = [i for i in range(len(word) - order + 1) if order > 1 or word[i] not in "^$"]
            return g.of(order)[1][[word[i : i + order] for i in at].index(gram)]

        lang, order, gram, n = ([*c] for c in zip(*[(languages.index(x), o, hashed(o, g), k) for x, o, g, k in counts], strict=True))
        return cls(languages, np.array(lang), np.array(order), np.array(gram, np.uint64), np.array(n))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the hashes, -1 for unknown ones."""
        if not len(self.grams):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
        return np.where(self.grams[at] == hashes, at, -1)

    def _sums(self, rows: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """What the languages of the rows add, summed by owner."""
        sizes = self.begin[rows + 1] - self.begin[rows]
        at = np.repeat(self.begin[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        width = len(self.languages)
        return np.bincount(np.repeat(owner, sizes) * width + self.lang[at], self.value[at], owners * width).reshape(owners, width)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of log scores for each word, and whether anything is known of it."""
        out = np.zeros((len(words), len(self.languages)))
        row = self.find(word_hashes(words))
        known = row >= 0
        if known.any():
            out[known] = self.rest[0] + self._sums(row[known], np.arange(known.sum()), int(known.sum()))
        open_ = np.flatnonzero(~known)
        grams = Grams([words[k] for k in open_])
        for order in range(LONGEST, 0, -1):
            word, h = grams.of(order)
            row = self.find(h)
            word, row = open_[word[row >= 0]], row[row >= 0]
            fresh = ~known[word]
            word, row = word[fresh], row[fresh]
            if len(word):
                own, place, times = np.unique(word, return_inverse=True, return_counts=True)
                out[own] = self.rest[order] + self._sums(row, place, len(own)) / times[:, None]
                known[own] = True
        return out.astype(np.float32), known


class Scorer:
    """Predicts texts; keeps the scores of at most `cells` values of distinct words by languages."""

    def __init__(self, model: LanguageModel, cells: int = 1_600_000):
        self.model, self.limit = model, cells // max(1, len(model.languages))
        self.at: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.languages)), dtype=np.float32)
        self.known = np.zeros(1024, bool)

    def add(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.limit:
            self.at.clear()
            new = list(words)
        first, need = len(self.at), len(self.at) + len(new)
        if need > len(self.scores):
            room = max(need, 2 * len(self.scores))
            self.scores, self.known = np.resize(self.scores, (room, self.scores.shape[1])), np.resize(self.known, room)
        if new:
            self.scores[first:need], self.known[first:need] = self.model.scores(new)
            self.at.update(zip(new, range(first, need), strict=True))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """predict() of every text; the words of short texts are scored together first."""
        size, words = 0, set()
        for text in texts:
            if text and len(text) < _CHUNK:
                size += len(text)
                words.update(*_words(text))
                if size > 1 << 22:
                    self.add(words)
                    size, words = 0, set()
        self.add(words)
        return [self.predict(text) for text in texts]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages:
            return UNDETERMINED, 0.0
        total, n, known = np.zeros(len(self.model.languages)), 0, False
        for words in _words(text):
            self.add(set(words))
            rows = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            total += self.scores[rows].sum(axis=0, dtype=np.float64)
            known = known or bool(self.known[rows].any())
            n += len(words)
        if not n:
            return UNDETERMINED, 0.0
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum()) if known else 0.0


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """labelled: doc_id, text, lang; rows with a null in any of them are left out."""
    small_batches(labelled.sparkSession)
    labelled = labelled.select("doc_id", "text", "lang").dropna()
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        none = np.zeros(0, np.int64)
        return LanguageModel([], none, none, none.astype(np.uint64), none)
    scale = 1 << 20
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, math.ceil(scale * min(1.0, per_language / n)))])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < shares[F.col("lang")])

    def count(batches):
        place = {x: k for k, x in enumerate(languages)}
        words: dict[str, Counter] = defaultdict(Counter)

        def rows():
            for lang, seen in words.items():
                own, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
                grams = Grams(own)
                for order in range(LONGEST + 1):
                    word, h = grams.of(order) if order else (np.arange(len(own)), word_hashes(own))
                    found, at = np.unique(h, return_inverse=True)
                    total = np.bincount(at, n[word], len(found)).astype(np.int64)
                    cols = [pa.array(np.full(len(found), place[lang], np.int32)), pa.array(np.full(len(found), order, np.int32)), pa.array(found.view(np.int64)), pa.array(total)]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "ord", "gram", "n"])
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                for found in _words(text):
                    words[lang].update(found)
                if sum(map(len, words.values())) > 200_000:
                    yield from rows()
        yield from rows()

    counts = sample.mapInArrow(count, "lang int, ord int, gram long, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, order, gram, n = (counts.column(c).to_numpy() for c in ("lang", "ord", "gram", "n"))
    return LanguageModel(languages, lang, order, gram.view(np.uint64), n)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the bounded sample's vocabulary
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer.predict_all(batch.column("text").to_pylist())
            cols = [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from the rows that are not held out."""
    model = fit(docs.filter(~held_out()))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Documents in some language with at least that posterior; the others are rejected. All columns stay."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs.filter(~held_out())))  # as large as the bounded sample's vocabulary
    small_batches(spark)
    at = docs.columns.index("text")

    def keep(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = scorer.predict_all(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
