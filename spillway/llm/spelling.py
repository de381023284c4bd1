"""Spelling variants: words of a corpus that differ by one edit, found by forward and reversed dictionaries.

Words are counted per document (a run that occurs often in a text is hashed once) and summed over Spark. One edit at a
position of the shorter word, length m, leaves the letters before it and those after it as they are. So a pair shares the
first half of the shorter word (a block of the forward dictionary) or its second half (a block of the reversed one). A
block is described by (m, a, b): the first a and the last m - b letters of the shorter word are shared, and the edit lies
in between. Blocks of more than BLOCK words are halved again, in the forward direction (a moves up) and in the reversed
one (b moves down), until they are small or one letter is left open; that last kind can hold no more words than the alphabet
allows, so no block grows with the vocabulary. What is left is range-scanned in key order and verified; blocks that fit a task are
halved further there in the same way. A pair is taken in the one block on the path of its edit's position, so none is
found twice.

Cases: null and empty texts have no words; a null identifier is hashed as empty text; repeated rows count each time; words
of any length take part; ties of the largest count go to the first word in code-point order; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, scratch, small_batches

#: Shortest word, least occurrences, how much more frequent a form must be, one of how many runs is misspelt.
SHORTEST, LEAST, FORM_TIMES, MISSPELT = 6, 5, 5, 199
#: A maximal run of at least SHORTEST letters; shorter ones give no word.
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % SHORTEST)
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Words of one block that a task may hold; larger blocks are halved by a shuffle.
BLOCK = 2000
#: Blocks up to this size are compared word by word within a task.
SCAN = 12
#: Distinct words that a task counts before it hands them on.
FLUSH = 200_000


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """Words and their occurrences in one text, with the runs that the hash picks misspelt."""
    head = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(x.translate(LOWER) for x in RUN.findall(text or "")).items():
        h = crc32(run.encode(), head)
        if h % MISSPELT == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= SHORTEST:
            out[run] += n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    for given in batches:
        ids, texts = given.column(0), given.column(1)
        for k in range(given.num_rows):
            total.update(words_of(ids[k].as_py(), texts[k].as_py()))
            if len(total) > FLUSH:
                yield batch()
                total = Counter()
    if total:
        yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of every word with at least LEAST occurrences."""
    small_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def half(a: int, b: int) -> int:
    return (a + b) // 2


def one_edit(u: str, v: str, m: int, a: int, b: int) -> bool:
    """Whether v is u with one letter replaced or inserted, at a place on the path of block (m, a, b); len(u) = m.

    The place is where the words begin to differ. It lies in one of the two halves at each step, so in one block of each size.
    """
    at = a
    while at < m and u[at] == v[at]:
        at += 1
    if at >= b and not at == b == m:
        return False
    return u[at + 1 :] == v[at + 1 :] if len(v) == m else u[at:] == v[at + 1 :]


def pairs_in(block: list[str], m: int, a: int, b: int) -> Iterator[tuple[str, str]]:
    """Near pairs of the distinct words of a block, halved until at most SCAN words or one open letter are left."""
    short = [w for w in block if len(w) == m]
    if not short:
        return
    if len(block) <= SCAN or b - a <= 1:
        long = [w for w in block if len(w) > m]
        for k, u in enumerate(short):
            for v in short[k + 1 :]:
                if one_edit(u, v, m, a, b):
                    yield u, v
            for v in long:
                if one_edit(u, v, m, a, b):
                    yield u, v
        return
    c = half(a, b)
    for low, high in ((c, b), (a, c)):
        parts: dict[str, list[str]] = {}
        for w in block:
            parts.setdefault(w[a:c] if low == c else w[len(w) - m + c : len(w) - m + b], []).append(w)
        for part in parts.values():
            if len(part) > 1:
                yield from pairs_in(part, m, low, high)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; each block's words are held once, and its pairs handed on in both directions."""
    key, block, made = None, {}, []

    def close():
        if len(block) > 1:
            for u, v in pairs_in(list(block), *key[:3]):
                made.append((u, v, block[v]))
                made.append((v, u, block[u]))

    def batch():
        cols = zip(*made, strict=True) if made else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "n_of_near"])

    for given in batches:
        cols = [given.column(k).to_pylist() for k in range(7)]
        for m, a, b, head, tail, word, n in zip(*cols, strict=True):
            if (m, a, b, head, tail) != key:
                close()
                key, block = (m, a, b, head, tail), {}
                if len(made) > 50_000:
                    yield batch()
                    made.clear()
            block[word] = n
    close()
    yield batch()


def _dealt(words: DataFrame) -> DataFrame:
    """Words in their blocks: with m, a, b, the block's shared first and last letters are head and tail."""
    m, extra = F.col("m"), F.length("word") - F.col("m")
    head, tail = F.substring("word", 1, F.col("a")), F.substring("word", extra + F.col("b") + 1, m - F.col("b"))
    return words.select("m", "a", "b", head.alias("head"), tail.alias("tail"), "word", "n")


def _halved(words: DataFrame) -> DataFrame:
    """Each row of (m, a, b, word, n) in the two halves of its block."""
    c = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(c.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), c.alias("b")))
    return words.select("m", "word", "n", F.explode(halves).alias("h")).select("m", "h.a", "h.b", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, n_of_near of all ordered pairs of words (word, n; words distinct and not empty) that are one edit apart."""
    length = F.length("word")
    roles = F.explode(F.array(length, length - 1)).alias("m")  # as the shorter or equal word of a pair, and as the longer one
    first = words.select(roles, "word", "n").filter("m > 0").select("m", F.lit(0).alias("a"), F.col("m").alias("b"), "word", "n")
    block = ["m", "a", "b", "head", "tail"]
    left, ready = _halved(first), None
    while True:
        dealt = materialize(_dealt(left), "spelling-blocks")
        large = materialize(dealt.filter("b - a > 1").groupBy(*block).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK).drop("size"), "spelling-large")
        if not large.limit(1).count():
            ready = dealt if ready is None else ready.unionByName(dealt)
            break
        done = dealt.join(large, block, "left_anti")
        ready = done if ready is None else ready.unionByName(done)
        left = _halved(dealt.join(large, block, "left_semi"))
    return ready.repartition(*block).sortWithinPartitions(*block).mapInArrow(_scan, "word string, near string, n_of_near long")


def _rooted(formed: DataFrame) -> DataFrame:
    """formed: word, form, form_n of words with a form. Adds root, by doubling the length of the steps until none moves.

    Each step multiplies the count by FORM_TIMES at least, so a chain has under 28 steps and five rounds are the most.
    """
    at = formed.select("word", F.col("form").alias("root"))
    while True:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not at.filter("moved").limit(1).count():
            return at.drop("moved")
        at = at.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus."""
    spark = docs.sparkSession
    with scratch() as used:
        words = materialize(vocabulary(docs), "spelling-words")
        near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_of_near")).alias("k"), "near")).alias("best"))
        joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.k")).alias("near_n"))
        formed = F.col("near_n") >= FORM_TIMES * F.col("n")
        joined = materialize(joined.select("word", "n", "n_near", F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "spelling-forms")
        roots = _rooted(joined.filter("form is not null").select("word", "form"))
        out = joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = materialize(out, "spelling-variants")
    discard(spark, used)
    return out
