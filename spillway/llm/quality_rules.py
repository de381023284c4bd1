"""Host-level quality rules, in DataFrame functions only.

Every text gets its counts within its own row: no word is ever exploded or shuffled. A document fails by its base rules;
its failures are then summed up by host, the hosts' failure rates are shrunk towards the corpus rate with a beta prior
fitted to them by moments, and a host whose shrunk rate exceeds the limit loses all its documents.

The join back is on the host: its verdict table has a row a host, which Spark broadcasts only if it is small, and a hot
host's documents are split by adaptive execution otherwise; the sums are pre-aggregated by task.

Cases: null text has no words and fails; null hosts form one host of their own; repeated rows count as often as they
occur; an empty table gives no rows; columns other than identifier, text and host are not read, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Fixed values of the contract: white space, symbols, least words, most percent of repeated words.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def count_text(docs: DataFrame) -> DataFrame:
    """docs has the column text; adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A repeated window is found by its hash: the hashes are sorted with their places only in texts where two are equal.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_text", t).drop("text")
    df = df.withColumn("_words", F.filter(F.split("_text", "[ \\t-\\r]+"), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(_without(x, SPACE)) > 0))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    df = df.withColumns(
        {
            "word_chars": F.length(_without(F.col("_text"), SPACE)).cast("long"),
            "n_symbols": (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.when(F.size("_words") >= 4, windows),
        }
    ).drop("_text", "_lines", "_words")
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    same = lambda x, k, d: F.coalesce(F.get("_sorted", k + d)["h"] == x["h"], F.lit(False))
    found = F.filter("_sorted", lambda x, k: same(x, k, -1) | same(x, k, 1))
    df = df.withColumn("_at", F.array_sort(F.transform(found, lambda x: x["i"]))).drop("_sorted")
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_at", zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(rows: DataFrame, limit: float) -> DataFrame:
    """rows: host, failed. A row a host: its counts, the shrunk rate and whether it stays.

    The prior's mean is the pooled rate m, its strength k = m (1 - m) / v - 1 from the variance v of the hosts' rates,
    at least 1; with no variance the rates are all the pooled one.
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("fails"))
    rate = F.col("fails") / F.col("n")
    pooled = hosts.agg((F.sum("fails") / F.sum("n")).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    k = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))
    shrunk = F.coalesce((F.col("fails") + F.col("m") * k) / (F.col("n") + k), F.col("m"))
    both = hosts.join(F.broadcast(pooled), F.lit(True))  # one row
    return both.select("host", "n", "fails", shrunk.alias("host_rate"), (shrunk <= limit).alias("host_kept"))


def judge(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, host_rate and kept of every document."""
    counted = count_text(docs.select("doc_id", F.col(host).alias("host"), "text"))
    rows = materialize(counted.withColumn("base_failed", base_failed()), "quality-counts")
    verdicts = host_verdicts(rows.select("host", F.col("base_failed").alias("failed")), limit)
    joined = rows.join(verdicts.select(F.col("host").alias("_host"), "host_rate", "host_kept"), F.col("host").eqNullSafe(F.col("_host")))
    kept = ~F.col("base_failed") & F.col("host_kept")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", kept.alias("kept"))
