"""Ranks, percentiles and running sums of raw records of any length, with no series in one task.

Percentiles and sums over thresholds need the distinct values of a series only, each with its number of rows: a record is read
once and counted by value, and all else works on the counts. A series of over BUCKET values is cut at approximate
percentiles, each border value being a bucket of its own; what lies below a value is counted within its bucket and added to
the counts of all lower buckets. Only those few counts of a series meet in one place. Percentiles are refined: the counts
tell in which bucket a rank lies, and only such buckets are sorted. Where each row is ranked (descending, running), a first
job looks for series of over BUCKET rows, and a value that holds much of a series is one task, which spills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows or distinct values of a series from which it is cut into buckets, and the number of approximate percentiles that cut it.
BUCKET, CUTS = 200_000, 200


def _long(base: DataFrame) -> bool:
    return base.groupBy("series_id").count().filter(F.col("count") > BUCKET).limit(1).count() > 0


def _below(borders: str, bits: int = 16) -> Column:
    """The number of borders (a rising array of fewer than 2 ** bits) below x, by binary search; 0 without borders."""
    steps = F.array(*[F.lit(2**k) for k in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(borders, at + step - 1) < F.col("x"), at + step).otherwise(at))


def _bucketed(base: DataFrame) -> DataFrame:
    """base with bucket: 2 k between the k-th and the next border, 2 k + 1 for a border itself; rising with x. 0 in short series.

    Only long series have borders, at most one row for each BUCKET rows of base, so these are broadcast.
    """
    cuts = [i / CUTS for i in range(1, CUTS)]
    large = base.groupBy("series_id").agg(F.count(F.lit(1)).alias("_c"), F.array_distinct(F.percentile_approx("x", cuts, 20 * CUTS)).alias("_cuts"))
    df = base.join(F.broadcast(large.filter(F.col("_c") > BUCKET).select("series_id", "_cuts")), "series_id", "left")
    df = df.withColumn("_below", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(_below("_cuts", CUTS.bit_length())))
    at = 2 * F.col("_below") + F.coalesce(F.get("_cuts", F.col("_below")) == F.col("x"), F.lit(False)).cast("int")
    return df.withColumn("bucket", at).drop("_cuts", "_below")


def _counts(placed: DataFrame, rows: Column) -> DataFrame:
    """series_id, bucket, rows, before (rows of lower buckets), beyond (of higher ones) and n."""
    c = placed.groupBy("series_id", "bucket").agg(rows.alias("rows"))
    up = W.partitionBy("series_id").orderBy("bucket")
    before = F.coalesce(F.sum("rows").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumns({"before": before, "n": F.sum("rows").over(W.partitionBy("series_id"))})
    return c.withColumn("beyond", F.col("n") - F.col("before") - F.col("rows"))


def counted(base: DataFrame) -> DataFrame:
    """The distinct values of each series with their number of rows c, other columns (equal within a series) beside them; no null x."""
    base = base.withColumn("x", F.col("x").cast("double")).filter("x IS NOT NULL")
    return base.groupBy(*base.columns).agg(F.count(F.lit(1)).alias("c"))


def beyond(values: DataFrame) -> DataFrame:
    """counted values with n, the rows of the series, and above, those of greater x."""
    placed = _bucketed(values)
    over = W.partitionBy("series_id", "bucket").orderBy(F.desc("x")).rowsBetween(W.unboundedPreceding, -1)
    counts = _counts(placed, F.sum("c")).select("series_id", "bucket", "beyond", "n")
    placed = placed.withColumn("above", F.coalesce(F.sum("c").over(over), F.lit(0))).join(counts, ["series_id", "bucket"])
    return placed.withColumn("above", F.col("above") + F.col("beyond")).drop("bucket", "beyond")


def descending(base: DataFrame) -> DataFrame:
    """base (series_id, x and other columns) with n and rank, 1 for the greatest x of a series; equal values in any order."""
    if not _long(base):
        return base.withColumns({"rank": F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("x"))).cast("long"), "n": F.count(F.lit(1)).over(W.partitionBy("series_id"))})
    placed = _bucketed(base)
    within = F.row_number().over(W.partitionBy("series_id", "bucket").orderBy(F.desc("x")))
    counts = _counts(placed, F.count(F.lit(1))).select("series_id", "bucket", "beyond", "n")
    return placed.withColumn("rank", within).join(counts, ["series_id", "bucket"]).withColumn("rank", F.col("rank") + F.col("beyond"))


def running(base: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """descending(base) with, for each name, the sum of a column of x, rank and n over all rows of lower rank (greater x)."""
    ranked = descending(base).withColumns({f"_{k}": c for k, c in sums.items()})
    big = "bucket" in ranked.columns
    keys = ["series_id", "bucket"] if big else ["series_id"]
    w = W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    out = ranked.withColumns({k: F.coalesce(F.sum(f"_{k}").over(w), F.lit(0.0)) for k in sums})
    if big:
        down = W.partitionBy("series_id").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
        whole = ranked.groupBy(*keys).agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
        whole = whole.select(*keys, *[F.coalesce(F.sum(f"_{k}").over(down), F.lit(0.0)).alias(f"_o{k}") for k in sums])
        out = out.join(whole, keys).withColumns({k: F.col(k) + F.col(f"_o{k}") for k in sums}).drop("bucket", *[f"_o{k}" for k in sums])
    return out.drop(*[f"_{k}" for k in sums])


def percentiles(base: DataFrame, at: Sequence[float]) -> DataFrame:
    """series_id, n and values: exact percentiles of x with linear interpolation, in the order of `at`. Null x count for nothing."""
    return counted_percentiles(counted(base.select("series_id", "x")), at)


def counted_percentiles(values: DataFrame, at: Sequence[float]) -> DataFrame:
    """percentiles of counted values. Between equal values nothing is interpolated, since x (1 - w) + x w may round below x."""
    placed = _bucketed(values.select("series_id", "x", "c"))
    counts = _counts(placed, F.sum("c"))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(at)])
    place = F.col("p") * (F.col("n") - 1)
    inside = (F.ceil(place) >= F.col("before")) & (F.floor(place) < F.col("before") + F.col("rows"))
    found = counts.select("*", F.inline(asked)).filter(inside).select("series_id", "bucket", "before", "n", "i", place.alias("_at"))
    needed = found.groupBy("series_id", "bucket", "before", "n").agg(F.collect_list(F.struct("i", "_at")).alias("_asked"))
    upto = F.sum("c").over(W.partitionBy("series_id", "bucket").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))
    told = placed.join(needed, ["series_id", "bucket"]).withColumn("_upto", upto + F.col("before")).select("series_id", "n", "x", "c", "_upto", F.inline("_asked"))
    told = told.filter((F.ceil("_at") >= F.col("_upto") - F.col("c")) & (F.floor("_at") < F.col("_upto")))
    ends = told.groupBy("series_id", "n", "i", "_at").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    w = F.col("_at") - F.floor("_at")
    v = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") * (1 - w) + F.col("_hi") * w)
    one = ends.select("series_id", "n", F.struct("i", v.alias("v")).alias("_v"))
    return one.groupBy("series_id", "n").agg(F.sort_array(F.collect_list("_v")).alias("_v")).select("series_id", "n", F.col("_v.v").alias("values"))


def intervals(values: DataFrame, steps: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """values: counted; steps: series_id, us (rising thresholds). series_id, k, u, n and for each name the sum of a column, both over x > u_k.

    A value counts once, for the last threshold below it, and the sums of all higher ones follow from running sums over the few
    thresholds of a series.
    """
    df = values.join(steps, "series_id").withColumn("k", _below("us") - 1).filter("k >= 0")
    g = df.groupBy("series_id", "k").agg(F.sum("c").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    every = steps.select("series_id", F.posexplode("us").alias("k", "u"))
    g = every.join(g, ["series_id", "k"], "left").fillna(0, ["n", *sums])
    down = W.partitionBy("series_id").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return g.select("series_id", "k", "u", *[F.sum(c).over(down).alias(c) for c in ("n", *sums)])
