"""The corpus pipeline: language ID, n-gram Jaccard join, personal data, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`:

language_id     documents in no language, or in one by less than half of the posterior, go
near_duplicates one document of each group of linked word-shingle sets stays, the one with the least identifier
personal_data   personal data is replaced by its kind in angle brackets
mixing          each document stays as often as the mix takes it
packing         pieces of at most 2048 tokens with their sequence and offset

Each stage's result must be written before the next stage begins, as run() does: the next one deletes its tables.

Cases: documents with null, empty or letterless texts go in the first stage, as they are in no language; texts of any
length are read whole; null languages and sources are values like others; documents without an identifier stay in the
second stage, and repeated rows become one; ties go by identifier; an empty table gives an empty result with the same
columns; further columns pass through the first four stages under any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spillway.llm import jaccard_join, language_id, mixing, packing, pii
from spillway.llm._common import discard, materialize, scratch, table
from spillway.llm._tokens import vocabulary

#: Tables that the last stage of a run has left, by application and input.
_left: dict[tuple[str, str], list[str]] = {}


def _stage(work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose own tables are deleted when the next one begins: its result has been written by then."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        discard(spark, _left.pop(key, []))
        with scratch() as used:
            out = work(docs)
        _left[key] = used
        return out

    return stage


def _pack(docs: DataFrame) -> DataFrame:
    return packing.packed_digests(packing.token_pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language_id", _stage(language_id.keep_identified)),
    ("near_duplicates", _stage(jaccard_join.keep_one)),
    ("personal_data", _stage(pii.redacted)),
    ("mixing", _stage(mixing.mixed)),
    ("packing", _stage(_pack)),
]

#: Fitted trees, components and packing have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each one's table is deleted when the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as written:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, before)
        before = [p for p in written if f"/pipeline-{name}-" in p]
    return docs
