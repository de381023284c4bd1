"""Fill-in-the-middle transformation by a matcher that runs through a text twice and keeps no units.

A text's units are runs of letters A-Z and single other characters. The first pass only counts them; the cuts are ranks
drawn from a hash of the identifier; the second pass lets a lazy match iterator run on to the lower rank and then to the
upper one and reads the character positions there. Memory is that of the text itself, whatever its number of units.

The form is plain (the text as it is) for empty texts, for texts that hold one of the markers, and for a tenth of the
identifiers; otherwise a fifth is suffix-prefix-middle and the rest prefix-suffix-middle. No marker can arise where a
marker meets a part, so the first occurrence of each marker after the leading one is the marker itself: restored() finds
them with string functions, without knowing the cuts.

Cases: null text is empty; a null identifier is hashed as empty text; repeated rows give repeated rows; an empty table
gives an empty result; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
#: The markers, and the shares of plain texts and of suffix-first forms in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Characters of output that a batch may hold before it is handed on.
FLUSH = 1 << 23
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def count_units(text: str) -> int:
    """First pass: the last match that enumerate() numbers, with nothing else kept."""
    last = deque(enumerate(UNIT.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def cut_points(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the units of rank low and high (low <= high) end, in characters."""
    matches, ends = UNIT.finditer(text), [0, 0]
    for k, ahead in enumerate((low, high - low)):
        ends[k] = ends[k - 1] if k else 0
        if ahead:
            ends[k] = next(islice(matches, ahead - 1, None)).end()
    return ends[0], ends[1]


def transform(doc_id: int | None, text: str | None) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    text = text or ""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut_points(text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    made: list[tuple] = []
    held = 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    for given in batches:
        ids, texts = given.column(0), given.column(1)
        for k in range(given.num_rows):
            doc_id = ids[k].as_py()
            made.append((doc_id, *transform(doc_id, texts[k].as_py())))
            held += len(made[-1][-1])
            if held > FLUSH:
                yield batch()
                made.clear()
                held = 0
    if made:
        yield batch()


def transformed(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (the text to train on) of every document."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        at = F.locate(second, body)
        rest = F.substr(body, at + len(second))
        return F.substring(body, 1, at - 1), F.substring_index(rest, MIDDLE, 1), F.substr(rest, F.locate(MIDDLE, rest) + len(MIDDLE))

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """The contract's columns: digests of each output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
