"""Best-fit packing: documents into sequences of at most `capacity` tokens, by exact complements.

1. Each task encodes its texts, appends the end id and cuts longer documents into pieces of `capacity` tokens; the
   pieces with their ids are written once to the shared folder, each with its number among its task's pieces of the
   same length. No shuffle.
2. The plan needs only how many pieces have each length, a table of at most `capacity` rows whatever the input. The
   driver consumes combinations that fill a sequence exactly: for the longest length left, one length that fills the
   gap, else a pair from an index of pair sums, else a triple, each as often as the availability counts allow, so a
   step empties at least one length; the rest goes best-fit, longest first, into the tightest gap.
3. A piece's number within its length (its task's offset plus its number there) falls into one interval of the plan,
   which gives its sequence and offset. Hot lengths stay spread: the offsets are per task and length.

Cases: null text is empty, one piece of the end id; repeated rows are packed each; an empty table gives no rows;
ties between pieces of one length are settled by their place in the input; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialize, small_batches
from ._tokens import encoder

#: Rows of the table of places that may be broadcast, counted first: 48 bytes each; beyond, the join shuffles.
BROADCAST_SLOTS = 500_000
PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, seq long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit), written to the shared folder."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()), ("part", pa.int32()), ("seq", pa.int64())])

    def cut(batches):
        from pyspark import TaskContext

        part, seen, tail = TaskContext.get().partitionId(), defaultdict(int), np.uint32(end_id).tobytes()
        encode, step = encoder(vocabulary).ids, 4 * capacity
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), step)):
                    part_ids = ids[at : at + step]
                    length = len(part_ids) // 4
                    for col, x in zip(cols, (doc_id, piece, at // 4, length, part_ids, part, seen[length]), strict=True):
                        col.append(x)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.mapInArrow(cut, PIECES), "pieces")


class _Available:
    """Counts by length, and an index of the sums of pairs that may still be there."""

    def __init__(self, counts: np.ndarray):
        self.n = counts
        has = (counts > 0).astype(np.float64)
        self.pairs = np.convolve(has, has)[: len(counts)] > 0.5

    def times(self, lengths: tuple[int, ...]) -> int:
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        return min(int(self.n[x]) // k for x, k in need.items())

    def pair(self, gap: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths that sum to gap and, with those beside, are all available."""
        if gap < 2 or not self.pairs[gap]:
            return None
        low = np.arange(1, gap // 2 + 1)
        found = low[(self.n[low] > 0) & (self.n[gap - low] > 0)]
        for x in found[::-1]:
            if self.times((*beside, int(x), gap - int(x))):
                return gap - int(x), int(x)
        if not len(found):
            self.pairs[gap] = False  # a stale entry: counts only fall
        return None

    def triple(self, gap: int, beside: tuple[int, ...]) -> tuple[int, int, int] | None:
        third = np.arange(gap - 2, 0, -1)
        for x in third[(self.n[third] > 0) & self.pairs[gap - third]]:
            if two := self.pair(gap - int(x), (*beside, int(x))):
                return (int(x), *two)
        return None


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using each length exactly as often as counted."""
    have = _Available(np.array([counts.get(x, 0) for x in range(capacity + 1)], dtype=np.int64))
    plan: list[tuple[tuple[int, ...], int]] = []

    def consume(lengths: tuple[int, ...]) -> None:
        k = have.times(lengths)
        plan.append((lengths, k))
        for x in lengths:
            have.n[x] -= k

    if have.n[capacity]:
        consume((capacity,))
    for longest in range(capacity - 1, 0, -1):
        while have.n[longest]:
            gap = capacity - longest
            if have.times((longest, gap)):
                consume((longest, gap))
            elif two := have.pair(gap, (longest,)):
                consume((longest, *two))
            elif three := have.triple(gap, (longest,)):
                consume((longest, *three))
            else:
                break
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(have.n[length])
        for gap in sorted(g for g in gaps if g >= length):
            while left and gaps[gap]:
                lengths, k = gaps[gap].pop()
                used = min(k, left)
                if k > used:
                    gaps[gap].append((lengths, k - used))
                left -= used
                gaps[gap - length].append(((*lengths, length), used))
                if gap - length >= length and left:
                    each = (gap - length) // length  # the same sequences take more of the same length
                    full = min(each * used, left)
                    lengths, _ = gaps[gap - length].pop()
                    for extra, n in ((full // used, used - full % used), (full // used + 1, full % used)):
                        if n:
                            gaps[gap - length * (1 + extra)].append(((*lengths, *[length] * extra), n))
                    left -= full
            if not left:
                break
        if left:
            each = capacity // length
            if left // each:
                gaps[capacity - each * length].append(((length,) * each, left // each))
            if left % each:
                gaps[capacity - left % each * length].append(((length,) * (left % each), 1))
    plan += [x for gap in sorted(gaps) for x in gaps[gap]]
    return plan


def intervals(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, end number, first sequence, offset): the numbers within a length that a slot takes."""
    out, used, first = [], defaultdict(int), 0
    for lengths, k in plan:
        offset = 0
        for x in lengths:
            out.append((x, used[x], used[x] + k, first, offset))
            used[x] += k
            offset += x
        first += k
    return out


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to the pieces; every other column stays."""
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    found = intervals(pack_lengths(total, capacity))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["length", "part"]).withColumn("number", F.col("before") + F.col("seq"))
    # A length's numbers are divided evenly into as many steps as it has intervals, and an interval is listed with the
    # steps that it meets, two on average: a piece looks at those of its own step only.
    many: dict[int, int] = defaultdict(int)
    for x, *_ in found:
        many[x] += 1
    width = {x: max(1, -(-total[x] // many[x])) for x in many}
    listed = [(x, step, low, high, first, offset) for x, low, high, first, offset in found for step in range(low // width[x], (high - 1) // width[x] + 1)]
    slots = spark.createDataFrame(listed, "slot_length int, step long, low long, high long, first long, offset long")
    side = F.broadcast(slots) if len(listed) <= BROADCAST_SLOTS else slots
    wide = F.create_map(*[F.lit(v) for pair in width.items() for v in pair]) if width else F.create_map(F.lit(0), F.lit(1))
    numbered = numbered.withColumn("_step", F.floor(F.col("number") / wide[F.col("length")]))
    placed = numbered.join(side, (F.col("length") == F.col("slot_length")) & (F.col("_step") == F.col("step")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    return placed.withColumn("sequence_id", F.col("first") + F.col("number") - F.col("low")).drop("before", "number", "slot_length", "step", "_step", "low", "high", "first", "part", "seq")


def packed_digests(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """The contract's columns; the ids become their crc32 before anything is shuffled."""
    slim = pieces.select("doc_id", "piece", "start", F.col("length"), F.crc32("ids").alias("ids_crc32"), "part", "seq")
    return place(slim, capacity).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
