"""Statistics over all pairs of a series' values, counted without forming the pairs.

Kendall's S needs only the number of inversions: pairs that time orders one way and value the other. Values and times are
cut into buckets at approximate percentiles, a border value being a bucket of its own, so that a value that fills much of
a record needs no work. Pairs in one bucket of values are counted there, pairs in one bucket of times but different ones of
values there, both by merging sorted runs in Arrow batches that hold many small buckets or one large one; all other pairs
follow from the counts of rows per pair of buckets by running sums. No task holds more of a series than a bucket.

Slopes of all pairs are never listed either: as many slopes are at most b as pairs whose order q - b t turns round, so a
slope of given rank is enclosed by counting, and only the few slopes left within the last bounds are written out. That part
keeps one series in a task, in memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: About how many rows of a series one bucket holds, and the most buckets either way; beyond, buckets grow instead.
BUCKET, MOST = 20_000, 500
#: Rows of small buckets that are counted at once.
TOGETHER = 100_000
#: Slopes that may be written out at last, at least and per value of the series.
LISTED = 20_000


def counted(order: np.ndarray) -> np.ndarray:
    """For each value how many earlier ones are greater. Runs of doubling length are merged; equal values are no inversion."""
    n, out = len(order), np.zeros(len(order), np.int64)
    rank = np.unique(order, return_inverse=True)[1].astype(np.int64)
    at, width = np.arange(n), 1
    while width < n:
        block = at // (2 * width)
        at = at[np.argsort(block * n + rank[at], kind="stable")]  # runs are sorted already, and the left one comes first at ties
        block = at // (2 * width)
        left = at % (2 * width) < width
        within = np.cumsum(left) - block * width
        whole = np.minimum(width, n - block * 2 * width)
        right = ~left
        out[at[right]] += (whole - within)[right]
        width *= 2
    return out


def listed(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all inversions, i < j and order[i] > order[j]; for orders with few."""
    n, first, second = len(order), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rank = np.unique(order, return_inverse=True)[1].astype(np.int64)
    at, width = np.arange(n), 1
    while width < n:
        block = at // (2 * width)
        at = at[np.argsort(block * n + rank[at], kind="stable")]
        block = at // (2 * width)
        left = at % (2 * width) < width
        lefts = at[left]  # by block, sorted within
        done = np.cumsum(left)[~left]
        end = np.minimum(block[~left] * width + width, len(lefts))
        more = end - done
        hit = more > 0
        if hit.any():
            k, reps = done[hit], more[hit]
            shift = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            first.append(lefts[np.repeat(k, reps) + shift])
            second.append(np.repeat(at[~left][hit], reps))
        width *= 2
    return np.concatenate(first), np.concatenate(second)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (series_id, bucket, v) sorted by series, bucket and order: the inversions of v within each bucket, by series."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def close(table: pa.Table) -> pa.RecordBatch:
        sid, bucket, v = table.column(0), table.column(1).to_numpy(), table.column(2).to_numpy()
        sid = sid.combine_chunks().dictionary_encode()
        sid = sid.combine_chunks() if isinstance(sid, pa.ChunkedArray) else sid
        code = sid.indices.to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])])
        group = np.cumsum(new)
        rank = np.unique(v, return_inverse=True)[1]
        found = counted(group * np.int64(len(v) + 1) + rank)  # later groups are greater, so none is counted across groups
        total = np.zeros(len(sid.dictionary), np.int64)
        np.add.at(total, code, found)
        return pa.RecordBatch.from_arrays([sid.dictionary.cast(pa.string()), pa.array(total)], names=["series_id", "d"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows > TOGETHER:
            table = pa.Table.from_batches(held)
            sid, bucket = table.column(0), table.column(1)
            last = (sid[rows - 1], bucket[rows - 1])
            lo, hi = 0, rows - 1  # where the last bucket begins: all before it is whole
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if (sid[mid], bucket[mid]) == last else (mid + 1, hi)
            if lo:
                yield close(table.slice(0, lo))
                held = table.slice(lo).to_batches()
                rows -= lo
    if rows:
        yield close(pa.Table.from_batches(held))


def _bucket(x: str, borders: str) -> Column:
    """2 k + 1 for the k-th border itself and 2 k between the borders."""
    return F.expr(f"2 * size(filter({borders}, b -> b < {x})) + CAST(array_contains({borders}, {x}) AS INT)")


def _plain(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.col("series_id").cast("string").alias("series_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()


def _counted(df: DataFrame, key: str) -> DataFrame:
    """series_id, d: inversions of v in the order of x within each (series_id, key). Values sorted within equal x rise, so
    pairs with equal x are none."""
    order = ["series_id", key, "x", "v"]
    return df.select(*order).repartition("series_id", key).sortWithinPartitions(*order).select("series_id", key, "v").mapInArrow(_sums, "series_id string, d long")


def inversions(rows: DataFrame, x: str = "t", y: str = "q") -> DataFrame:
    """series_id, d: pairs of a series with unequal x and unequal y that x and y order differently. Rows with a null count for
    nothing. A first job looks for series of over BUCKET rows; only with such are there buckets."""
    rows = _plain(rows, x, y)
    size = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET)
    if not size.limit(1).count():
        return _counted(rows.select("series_id", F.lit(0).alias("j"), "x", F.col("y").alias("v")), "j")
    cuts = [i / MOST for i in range(1, MOST)]
    large = size.select("series_id", F.least(F.ceil(F.col("n") / BUCKET), F.lit(MOST)).cast("int").alias("g"))
    percentiles = lambda c: F.percentile_approx(c, cuts, 20 * MOST)
    found = rows.join(large, "series_id").groupBy("series_id").agg(F.first("g").alias("g"), percentiles("x").alias("px"), percentiles("y").alias("py"))
    every = lambda p: F.expr(f"array_distinct(transform(sequence(1, g - 1), i -> {p}[CAST(i * {MOST} / g AS INT) - 1]))")
    borders = found.select("series_id", every("px").alias("bx"), every("py").alias("by"))
    none = F.array().cast("array<double>")
    placed = rows.join(borders, "series_id", "left").withColumns({"bx": F.coalesce("bx", none), "by": F.coalesce("by", none)})
    placed = placed.select("series_id", "x", "y", _bucket("x", "bx").alias("i"), _bucket("y", "by").alias("j"), (F.size("by") > 0).alias("cut"))
    by_value = _counted(placed.filter("j % 2 = 0").withColumn("v", F.col("y")), "j")  # odd buckets hold one value each
    by_time = _counted(placed.filter("cut AND i % 2 = 0").withColumn("v", F.col("j").cast("double")), "i")
    cells = placed.filter("cut").groupBy("series_id", "i", "j").agg(F.count(F.lit(1)).alias("c"))
    return by_value.unionByName(by_time).unionByName(_across(cells)).groupBy("series_id").agg(F.sum("d").alias("d"))


def _across(cells: DataFrame) -> DataFrame:
    """series_id, d: pairs in different buckets both ways, the earlier one with the greater value. cells: series_id, i, j, c.

    The grid of a series has at most (2 MOST)^2 cells. For each column of times running sums over time count the rows before it
    by bucket of values; the sum of those above a cell's bucket is that of its column less that up to the bucket.
    """
    width = cells.groupBy("series_id").agg(F.max("i").alias("mi"), F.collect_set("j").alias("js"))
    grid = width.select("series_id", F.explode(F.sequence(F.lit(0), F.col("mi"))).alias("i"), "js").select("series_id", "i", F.explode("js").alias("j"))
    dense = grid.join(cells, ["series_id", "i", "j"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    before = F.coalesce(F.sum("c").over(W.partitionBy("series_id", "j").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    above = F.coalesce(F.sum("b").over(W.partitionBy("series_id", "i").orderBy(F.desc("j")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dense.withColumn("b", before).withColumn("a", above).groupBy("series_id").agg(F.sum(F.col("c") * F.col("a")).alias("d"))


def kendall_counts(rows: DataFrame, x: str = "t", y: str = "q", unique_x: bool = False) -> DataFrame:
    """series_id, n, s (concordant less discordant pairs), pairs, tied pairs tx, ty, and the tie term vy of the variance of s.

    unique_x: no two rows of a series have the same x, as in a series in time; tx is 0 then.
    """
    plain = _plain(rows, x, y)
    c = F.col("c")

    def ties(*keys: str) -> DataFrame:
        t = plain.groupBy("series_id", *keys).agg(F.count(F.lit(1)).cast("double").alias("c"))
        return t.groupBy("series_id").agg(F.sum("c").alias("n"), F.sum(c * (c - 1) / 2).alias("p"), F.sum(c * (c - 1) * (2 * c + 5)).alias("v"))

    df = ties("y").toDF("series_id", "n", "ty", "vy")
    if unique_x:
        df = df.withColumns({"tx": F.lit(0.0), "txy": F.lit(0.0)})
    else:
        df = df.join(ties("x").select("series_id", F.col("p").alias("tx")), "series_id").join(ties("x", "y").select("series_id", F.col("p").alias("txy")), "series_id")
    found = inversions(rows, x, y).groupBy("series_id").agg(F.sum("d").alias("d"))
    df = df.join(found, "series_id", "left")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    s = pairs - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.coalesce("d", F.lit(0))
    return df.select("series_id", "n", s.alias("s"), pairs.alias("pairs"), "tx", "ty", "vy")


# --- Slopes of given rank.


def _all_slopes(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(t), 1)
    return np.sort((q[j] - q[i]) / (t[j] - t[i]))


def _at_most(t: np.ndarray, q: np.ndarray, b: float) -> int:
    """How many pairs have a slope of at most b."""
    z = q - b * t
    rank = np.unique(z, return_inverse=True)[1].astype(np.int64)
    return int(counted(rank * len(z) - np.arange(len(z))).sum())  # later ones of equal values count as turned round


def _between(t: np.ndarray, q: np.ndarray, low: float, high: float) -> np.ndarray:
    """The slopes beyond low and up to high, sorted."""
    a, b = q - low * t, q - high * t
    order = np.lexsort((-t, a))
    rank = np.unique(b[order], return_inverse=True)[1].astype(np.int64)
    i, j = listed(rank * len(t) - np.arange(len(t)))
    i, j = order[i], order[j]
    i, j = np.minimum(i, j), np.maximum(i, j)
    return np.sort((q[j] - q[i]) / (t[j] - t[i]))


def slope_of_rank(t: np.ndarray, q: np.ndarray, k: int) -> float:
    """The k-th least slope (from 0) of all pairs; t rises strictly. Bounds come from a sample of pairs and are then narrowed by
    interpolation between counts until few slopes are left."""
    n = len(t)
    if n * (n - 1) // 2 <= LISTED:
        return float(_all_slopes(t, q)[k])
    pairs, most = n * (n - 1) // 2, max(LISTED, 4 * n)
    r = np.random.default_rng([n, 7])
    i = r.integers(0, n, 40_000)
    j = (i + r.integers(1, n, 40_000)) % n
    sample = np.sort((q[j] - q[i]) / (t[j] - t[i]))
    share, reach = k / pairs, 4 / np.sqrt(len(sample))
    pick = lambda p: sample[int(np.clip(p * len(sample), 0, len(sample) - 1))]
    low, high = float(pick(share - reach)), float(pick(share + reach))
    below, upto = _at_most(t, q, low), _at_most(t, q, high)
    step = max(abs(low), abs(high), high - low, 1e-300)
    while below > k:
        low -= step
        step *= 4
        below = _at_most(t, q, low)
    while upto <= k:
        high += step
        step *= 4
        upto = _at_most(t, q, high)
    # Slopes closer than this cannot be told apart by counting.
    least = 4e-16 * max(abs(low), abs(high), float(np.ptp(q) / np.ptp(t)))
    turn = 0
    while upto - below > most and high - low > least:
        turn += 1
        inside = sample[(sample > low) & (sample < high)] if turn % 2 else sample[:0]
        if len(inside):  # a slope of the sample, which may be that of many pairs
            v = float(inside[int(np.clip((k - below) / (upto - below) * len(inside), 0, len(inside) - 1))])
            c = _at_most(t, q, v + least)
            if c <= k:
                low, below = v + least, c
                continue
            c = _at_most(t, q, v - least)
            if c <= k:
                return v
            high, upto = v - least, c
            continue
        share, width = (k + 0.5 - below) / (upto - below), high - low
        marks = [(low + high) / 2] if turn % 4 == 0 else [low + width * min(max(share + e, 0.0), 1.0) for e in (-0.02, 0.02)]
        for b in marks:
            if not low < b < high:
                continue
            c = _at_most(t, q, b)
            if c > k:
                high, upto = b, c
            else:
                low, below = b, c
    if upto - below > most:
        return high  # more equal slopes than may be listed
    found = _between(t, q, low, high)
    return float(found[min(max(k - below, 0), len(found) - 1)]) if len(found) else high


def slopes(series: DataFrame, ranks: DataFrame) -> DataFrame:
    """series: series_id, t, q; ranks: series_id, ks (array<long>). slopes (array<double>) at these ranks, from 0, of all pairs' slopes."""
    rows = series.select("series_id", F.col("t").cast("double").alias("t"), F.col("q").cast("double").alias("q")).dropna().join(ranks, "series_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, ks, parts = None, None, []

        def close() -> pa.RecordBatch:
            t, q = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
            if len(ks) and len(t) * (len(t) - 1) // 2 <= LISTED:
                every = _all_slopes(t, q)
                found = [float(every[k]) for k in ks]
            else:
                found = [slope_of_rank(t, q, k) for k in ks]
            return pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([found], pa.list_(pa.float64()))], names=["series_id", "slopes"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for a, b in zip([0, *cut], [*cut, len(ids)], strict=True):
                if a == b:
                    continue
                if ids[a] != sid:
                    if sid is not None:
                        yield close()
                    sid, ks, parts = ids[a], batch.column(3)[int(a)].as_py(), []
                parts.append([batch.column(c).to_numpy()[a:b] for c in (1, 2)])
        if sid is not None:
            yield close()

    return rows.repartition("series_id").sortWithinPartitions("series_id", "t").select("series_id", "t", "q", "ks").mapInArrow(run, "series_id string, slopes array<double>")


# --- Exact null laws of small samples.


def inversion_counts(n: int) -> list[int]:
    """How many of the n! orders have 0, 1, 2 ... inversions: a new greatest value adds 0 to n - 1 of them."""
    counts = [1]
    for m in range(2, n + 1):
        run, out = 0, []
        for k in range(len(counts) + m - 1):
            run += counts[k] if k < len(counts) else 0
            run -= counts[k - m] if k >= m else 0
            out.append(run)
        counts = out
    return counts


def kendall_law(spark, most: int = 30) -> DataFrame:
    """n, d, p: two-sided probability of at most min(d, pairs - d) discordant pairs or as few concordant ones, without ties.

    A constant table of about most^3 / 6 rows.
    """
    out = []
    for n in range(2, most + 1):
        counts, total, run = inversion_counts(n), 0, 0
        total, low = sum(counts), []
        for c in counts:
            run += c
            low.append(run)
        last = len(counts) - 1
        out += [(n, d, min(1.0, 2 * low[min(d, last - d)] / total)) for d in range(len(counts))]
    return spark.createDataFrame(out, "n int, d long, p double")


def spearman_law(spark, most: int = 8) -> DataFrame:
    """n, d2, p: two-sided permutation probability of a sum of squared rank differences as far from its mean as d2, without ties.

    A constant table of under 300 rows, from all orders of up to 8 values.
    """
    from itertools import permutations

    out = []
    for n in range(2, most + 1):
        d2 = ((np.array(list(permutations(range(n)))) - np.arange(n)) ** 2).sum(1)
        values, counts = np.unique(d2, return_counts=True)
        middle = (n**3 - n) / 6
        out += [(n, int(v), float(counts[np.abs(values - middle) >= abs(v - middle) - 1e-9].sum() / len(d2))) for v in values]
    return spark.createDataFrame(out, "n int, d2 long, p double")
