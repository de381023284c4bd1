"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of changes becomes signed deltas: an insert adds a document and its tokens, a delete takes both away, and a
revised count takes the old tokens away and adds the new ones. The deltas are summed by key before they are written, so
a batch adds at most one row a key, and totals are the sum of the committed batches: additive, in any order.

Commits are idempotent: a batch is written to a folder named by its identifier, replacing whatever an earlier attempt
left there, and counts once its commit record, written last, exists. Committing it again changes nothing; a batch
whose executors were lost before the record is not seen and can be sent again.

Cases: null source or language is a key of its own; null text counts no tokens, the document still counts; an empty
batch commits nothing but its record; keys whose documents and tokens return to zero are left out of the totals.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shared_path, small_batches
from ._tokens import encoder

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


def words_v1(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def bytes_v1(text: Column) -> Column:
    """UTF-8 bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def library_counts(docs: DataFrame, vocabulary: str, version: str, keep: tuple[str, ...] = (), revised: str | None = None) -> DataFrame:
    """source, lang, tokenizer, tokens of every document by a public vocabulary of the tokenizers library.

    The columns in keep stay. With revised, a column of revised texts, new_tokens counts those.
    """
    small_batches(docs.sparkSession)
    read = docs.select(*keep, "source", "lang", "text", *([F.col(revised).alias("_revised")] if revised else []))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds + ', ' if keep else ''}source string, lang string, tokenizer string, tokens long{', new_tokens long' if revised else ''}"
    names = [*keep, "source", "lang", "tokenizer", "tokens", *(["new_tokens"] if revised else [])]

    def count(batches):
        for batch in batches:
            ids = encoder(vocabulary).ids
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [len(x) // 4 for x in ids(texts)]
            out = [*[batch.column(c) for c in (*keep, "source", "lang")], pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())]
            if revised:
                new = [t or "" for t in batch.column("_revised").to_pylist()]
                other = [i for i, t in enumerate(new) if t != texts[i]]
                again = n.copy()
                for i, x in zip(other, ids([new[i] for i in other]), strict=True):
                    again[i] = len(x) // 4
                out.append(pa.array(again, pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return read.mapInArrow(count, schema)


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(changes: DataFrame) -> DataFrame:
    """changes: the keys, old_tokens and new_tokens of documents whose text or count was revised."""
    return changes.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col("new_tokens") - F.col("old_tokens")).alias("tokens"))


class Rollup:
    """A rollup in a folder: deltas/<batch> holds a batch's summed deltas, commits/<batch> its commit record."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "token-rollup")

    def _committed(self) -> list[str]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        names = [s.getPath() for s in fs.listStatus(fs_path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.getName() for p in names if fs.exists(done(p, "_SUCCESS")))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch of signed deltas once; False if it was already applied."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError("a batch is named by letters, digits, dots and dashes")
        if batch in self._committed():
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens over the committed batches."""
        done = [f"{self.path}/deltas/{b}" for b in self._committed()]
        rows = self.spark.read.schema(DELTAS).parquet(*done) if done else self.spark.createDataFrame([], DELTAS)
        summed = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.filter("docs <> 0 or tokens <> 0")


def maintained(docs: DataFrame, labels: DataFrame, vocabularies: dict[str, str] | None = None) -> DataFrame:
    """Totals after a load by each counter, a deletion and a revision over all documents, two of them sent twice.

    The word and byte counters and every vocabulary (version to path) load every document; toxic documents are deleted;
    documents with repeated lines are revised to the words and vocabulary tokens of their distinct lines.
    """
    spark = docs.sparkSession
    toxic = labels.filter("toxic = 1").select("doc_id").distinct().withColumn("_toxic", F.lit(True))
    text, lines = F.col("text"), F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    once = F.array_join(F.array_distinct(lines), "\n")
    rollup = Rollup(spark)

    def kept(counts: DataFrame, name: str) -> DataFrame:
        counts = counts.join(toxic, "doc_id", "left")
        counts.write.parquet(f"{rollup.path}/{name}")
        return spark.read.schema(counts.schema).parquet(f"{rollup.path}/{name}")

    counts = kept(docs.select("doc_id", "source", "lang", words_v1(text).alias("words"), bytes_v1(text).alias("bytes"), words_v1(once).alias("once")), "counts")
    by = {"words-v1": ("words", "once"), "bytes-v1": ("bytes", "bytes")}
    one = {v: counts.select("source", "lang", F.lit(v).alias("tokenizer"), F.col(c).alias("tokens"), F.col(o).alias("new_tokens"), "_toxic") for v, (c, o) in by.items()}
    for version, path in (vocabularies or {}).items():
        one[version] = kept(library_counts(docs.withColumn("_once", once), path, version, ("doc_id",), "_once"), f"counts-{version}").drop("doc_id")
    every = reduce(DataFrame.unionByName, one.values())
    gone = inserts(every.filter("_toxic"))
    revised = every.filter("_toxic is null and new_tokens <> tokens").withColumnRenamed("tokens", "old_tokens")
    loads = [(f"load-{v}", inserts(c)) for v, c in one.items()]
    for batch, deltas in (*loads, ("delete-toxic", deletes(gone)), ("delete-toxic", deletes(gone)), ("revise-lines", revisions(revised)), loads[0]):
        rollup.commit(batch, deltas)
    return rollup.totals()
