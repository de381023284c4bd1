"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets: the sources, in code-point order with null last, weigh 5, 2, 1, repeating, and share a part of all words; no
target exceeds `cap` times its source, the excess goes to the others by weight (water filling, in closed form over the
sources in order of cap by weight).

Sampling, within a source: every document gets the certain whole copies k that all can have, then one more copy goes
to a fixed-size sample of the rest of the target. A document's inclusion odds come from a probability p that falls with
its length: p = c / sqrt(1 + size / mean size), at most 1, with c such that the expected words are the rest. Its random
number u comes from a hash of its identifier and text, and documents are ranked by v = x / (1 + x) with the ratio of
odds x = [u / (1 - u)] / [p / (1 - p)]. In this order every document that still fits is taken, so what is left of the
rest is less than any document that was left out.

No text moves and nothing is sorted as a whole: a source's decision is a short list of ranges of v, each with the words
that were left when it began, and of single documents where a range ends (see cutoffs), and a row compares its own v
with its source's list. Sums by source and range are made in each task before they meet.

Cases: null text has size 0 and takes 0; an empty table gives no rows; repeated rows are documents of their own; a null
identifier hashes as empty text; rows alike in identifier and text are taken all or not at all; other columns of
`documents` pass through mixed() unread, and working columns start with `_mix`. Sources are fewer than documents by
far: one row a source is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import discard, materialize, scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Ranges of v that a step tells apart, a power of two: products with its powers are exact.
PARTS = 1024
#: Documents at the end of a range that are gone through one by one, in one task a source.
EDGE = 5000
#: Rows of a table of sources that may be broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000
_SCALE = 1_000_000


def words_of(text: str = "text") -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sized: source, size. A row a source: source_size, n, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # One task orders the sources, not their documents.
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", cap * F.col("source_size"))
    by = W.orderBy(F.col("_cap") / F.col("_w"), "_w", F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns({"_total": F.sum("source_size").over(all_rows), "_weights": F.sum("_w").over(all_rows), "_full": F.coalesce(F.sum("_cap").over(before), F.lit(0)), "_used": F.coalesce(F.sum("_w").over(before), F.lit(0))})
    per = per.withColumn("_level", (share * F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_used")))
    open_ = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_full"), F.col("_used"), F.col("_level")))
    per = per.withColumn("_level", F.min(open_).over(all_rows)["_level"])
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double")))
    return per.select("source", "source_size", "n", target.alias("target"))


def uniform(seed: str = "mix") -> Column:
    """A number strictly between 0 and 1 from the md5 of the seed, the identifier and the text."""
    own = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def _weight(size: str, n: str, source_size: str) -> Column:
    """A whole number for 1 / sqrt(1 + size / mean size), so that sums are exact."""
    return F.floor(_SCALE / F.sqrt(1 + F.col(size) * F.col(n) / F.col(source_size)))


def odds(sized: DataFrame, per: DataFrame) -> DataFrame:
    """per (targets) with sure (certain copies), rest (words of the sample) and c, null where every document is taken.

    p = c weight is clipped at 1. As the weight falls with the size, it is clipped up to some size: over the sizes of a
    source in ascending order, c is that of the first size which is not clipped when all below it are.
    """
    whole = F.greatest(F.ceil(F.col("target") / F.col("source_size")) - 1, F.lit(0))
    per = per.withColumn("sure", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("int"))
    per = per.withColumn("rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("sure") * F.col("source_size")).otherwise(0.0))
    sizes = sized.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("_k"))
    df = _with_source(sizes, per.select("source", "source_size", "n", "rest")).withColumn("_i", _weight("size", "n", "source_size"))
    by = W.partitionBy("source").orderBy("size")
    below = F.coalesce(F.sum(F.col("size") * F.col("_k")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("_i") * F.col("size") * F.col("_k")).over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    df = df.withColumn("_c", (F.col("rest") - below) / mass).filter(F.col("_c") * F.col("_i") <= 1)
    c = df.groupBy("source").agg(F.min(F.struct("size", "_c"))["_c"].alias("c")).withColumnRenamed("source", "_s")
    return per.join(c, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _with_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows with the columns of their source, which is compared null-safely."""
    per = per.withColumnRenamed("source", "_mix_s")
    side = F.broadcast(per) if per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else per
    return rows.join(side, F.col("source").eqNullSafe(F.col("_mix_s"))).drop("_mix_s")


def order_of(u: str, size: str) -> Column:
    """v of a row with u, size and its source's n, source_size and c."""
    p = F.when(F.col("c").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("c") * _weight(size, "n", "source_size")))
    out, in_ = F.col(u) * (1 - p), (1 - F.col(u)) * p
    return F.when(p > 0, out / (out + in_)).otherwise(1.0)


_RANGES = "array<struct<lo:double,hi:double,gap:double>>"
_PICKS = "array<struct<v:double,u:double,size:bigint>>"


def cutoffs(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows: source, u, size, v. per: source, rest. A row a source: ranges, picks and until.

    In order of v, a document is taken if it is no longer than what is left. From any point on, all that are short enough
    for what is left then are taken up to the one at which their sum exceeds it: that is a range. Its end is found by sums
    over PARTS parts of v, a part with more than EDGE documents being divided again. The documents from there on, EDGE
    at most, are gone through one by one; whoever is taken is a pick, and the next range begins after them. This ends
    when no document is short enough for what is left.
    """
    state = per.select("source", F.col("rest").alias("gap"), F.lit(0.0).alias("until"), F.array().cast(_RANGES).alias("ranges"), F.array().cast(_PICKS).alias("picks"))
    ended = None
    while True:
        state = materialize(state, "mix-state")
        fits = _with_source(rows, state.select("source", "gap", "until")).filter("v >= until and size > 0 and size <= gap")
        left, ends, level = fits.withColumn("_before", F.lit(0).cast("long")), None, 1
        while True:
            scale = float(PARTS) ** level
            sums = left.groupBy("source", F.floor(F.col("v") * scale).alias("_part")).agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.first("gap").alias("gap"), F.first("_before").alias("_before"))
            by = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
            sums = sums.withColumn("_upto", F.col("_before") + F.sum("_sum").over(by))
            over = F.when(F.col("_upto") > F.col("gap"), F.struct("_part", (F.col("_upto") - F.col("_sum")).alias("before"), "_n"))
            sums = sums.withColumn("_edge", F.min(over).over(W.partitionBy("source")))
            reached = F.col("_part") >= F.col("_edge._part")
            sums = sums.withColumn("_after", F.sum(F.when(reached, F.col("_n"))).over(by))
            near = reached & ((F.col("_part") == F.col("_edge._part")) | (F.col("_after") <= EDGE))
            last = F.max(F.when(near, F.col("_part"))).alias("last")
            found = materialize(sums.groupBy("source").agg(F.first("_edge").alias("e"), F.sum("_sum").alias("all"), last), "mix-edges")
            coarse = (F.col("e._n") > EDGE) & F.lit(level < 5)
            own = found.filter(F.coalesce(~coarse, F.lit(True)))
            none = F.col("e").isNull()
            own = own.select("source", F.when(none, 2.0).otherwise(F.col("e._part") / scale).alias("lo"), F.when(none, 2.0).otherwise((F.col("last") + 1) / scale).alias("hi"), F.when(none, F.col("all")).otherwise(F.col("e.before")).alias("before"))
            ends = own if ends is None else ends.unionByName(own)
            deeper = found.filter(coarse)
            if not deeper.limit(1).count():
                break
            deeper = deeper.select("source", (F.col("e._part") / scale).alias("_from"), ((F.col("e._part") + 1) / scale).alias("_to"), F.col("e.before").alias("_before"))
            left = _with_source(fits, deeper).filter("v >= _from and v < _to")
            level += 1
        ends = materialize(ends, "mix-ends")
        if not ends.limit(1).count():
            out = state if ended is None else state.unionByName(ended)
            return out.select("source", "ranges", "picks", "until")
        edge = _with_source(fits.select("source", "u", "size", "v"), ends.select("source", "lo", "hi")).filter("v >= lo and v < hi")
        edge = edge.groupBy("source", "v", "u", "size").agg(F.count(F.lit(1)).alias("k"))
        edge = edge.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("v", "u", "size", "k"))).alias("edge"))  # EDGE rows at most, but for equal v
        now = state.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        now = now.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        start = F.struct((F.col("gap") - F.col("before")).alias("left"), F.array().cast(_PICKS).alias("picks"))

        def go(a: Column, x: Column) -> Column:
            words = x["size"] * x["k"]
            one = F.array(F.struct(x["v"].alias("v"), x["u"].alias("u"), x["size"].alias("size")))
            fit = words <= a["left"]
            return F.struct((a["left"] - F.when(fit, words).otherwise(0)).alias("left"), F.when(fit, F.concat(a["picks"], one)).otherwise(a["picks"]).alias("picks"))

        gone = F.aggregate(F.coalesce("edge", F.array().cast("array<struct<v:double,u:double,size:bigint,k:bigint>>")), start, go)
        one = F.array(F.struct(F.col("until").alias("lo"), F.col("lo").alias("hi"), F.col("gap").alias("gap")))
        now = now.withColumn("_x", F.when(F.col("lo").isNotNull(), gone))
        over = now.filter("_x is null").select("source", "gap", "until", "ranges", "picks")
        ended = over if ended is None else ended.unionByName(over)
        state = now.filter("_x is not null").select("source", F.col("_x.left").alias("gap"), F.col("hi").alias("until"), F.concat("ranges", one).alias("ranges"), F.concat("picks", F.col("_x.picks")).alias("picks"))


def _copies() -> Column:
    """Of a row with size, u, v and its source's sure, ranges, picks and until."""
    size, v = F.col("_mix_size"), F.col("_mix_v")
    ranged = F.exists("ranges", lambda r: (v >= r["lo"]) & (v < r["hi"]) & (size <= r["gap"]))
    picked = F.exists("picks", lambda p: (p["v"] == v) & (p["u"] == F.col("_mix_u")) & (p["size"] == size))
    extra = F.when(size == 0, False).when(ranged, True).when(v >= F.col("until"), False).otherwise(picked)
    return F.col("sure") + extra.cast("int")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, u of every document; a row a source with all that decides on its documents)."""
    sized = materialize(docs.select("doc_id", "source", words_of().alias("size"), uniform(seed).alias("u")), "mix-sizes")
    with scratch() as used:
        per = materialize(odds(sized, targets(sized, weights, share, cap)), "mix-targets")
        rows = _with_source(sized, per).withColumn("v", order_of("u", "size")).select("source", "u", "size", "v")
        rows = materialize(rows, "mix-order")
        cut = cutoffs(rows, per).withColumnRenamed("source", "_s")
    whole = materialize(per.join(cut, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-plan")
    discard(docs.sparkSession, used)
    return sized, whole


def copies(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document."""
    sized, per = plan(docs, **how)
    rows = _with_source(sized, per).withColumns({"_mix_v": order_of("u", "size"), "_mix_size": F.col("size"), "_mix_u": F.col("u")})
    return rows.select("doc_id", "source", "size", "source_size", "target", _copies().cast("long").alias("copies"))


def taken(docs: DataFrame) -> DataFrame:
    """The contract's columns: the words of every document that the mix takes, with source_size and target."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns. Every row decides by itself."""
    _, per = plan(docs, **how)
    rows = docs.select(F.col("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row"), words_of().alias("_mix_size"), uniform(how.get("seed", "mix")).alias("_mix_u"))
    rows = _with_source(rows, per).withColumn("_mix_v", order_of("_mix_u", "_mix_size")).withColumn("_mix_n", _copies()).filter("_mix_n > 0")
    return rows.select("_mix_row", F.explode(F.sequence(F.lit(1), "_mix_n"))).select("_mix_row.*")
