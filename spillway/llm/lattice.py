"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, neighbouring cells probed, cosine verified.

In each of several tables a unit vector is projected to blocks of eight coordinates, each block is decoded to the nearest
point of the E8 lattice, and the blocks' points together are its cell. A vector stands in its own cell and looks into that
and the PROBES - 1 neighbouring cells that are least further from it: neighbours are reached by the lattice's 240 shortest
vectors, ranked by the residual. Vectors meet if one looks into the cell in which the other stands. Meetings of single
vectors pass a sketch of 64 signs before their cosine is taken.

Dense groups don't meet pair by pair. Equal vectors are one class. Classes that share a finer cell with enough others are
held against their mean direction: those within half of the link's angle of it are linked with each other for certain, and
are one group, met through their mean. Two groups are linked wholly, not at all, or are verified block against block, by what the
triangle inequality of angles leaves open. So no pairs of a group are emitted, and links are counts by class.

Recall: with two blocks a pair at cosine 0.93 meets in a table with probability 0.6 or more and in one of eight with over
0.999; closer pairs meet more often. Random directions meet with about 0.0001 a table, and one block more, for
over two million classes of a label, divides that by about 200.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing; vectors of different dimensions are not compared; rows without an identifier are counted as links, and are never
kept; rows that repeat an identifier are rows of their own; a component whose rows have no identifier has a null one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, scratch
from .jaccard_join import components

COSINE = 0.93
#: Width of a lattice cell against a unit vector's projections, and cells looked into per table.
SCALE, PROBES = 2.2, 8
#: Neighbours of a block's point that are combined with those of the other blocks.
NEIGHBOURS = 8
#: Blocks of the finer cells, and classes in one of them from which they are held against their mean.
FINE_BLOCKS, GROUP = 3, 8
#: Classes of a label up to which two blocks are enough, and by how many times one more block thins out random meetings.
TWO_BLOCKS, THINNER = 2_000_000, 200
#: Most differing signs of 64. At cosine 0.93 the mean is 7.7 and 24 is over six deviations away; random ones differ in 32.
SIGNS = 24
#: About how many members of a group are verified at once.
BLOCK = 400
SEED = 1109
#: Angles this close to a bound are verified instead.
SLACK = 1e-6
#: Rows of a batch handed on.
ROWS = 50_000


def plan(classes: int) -> tuple[int, int]:
    """(blocks, tables) for so many classes of the most frequent label."""
    more = max(0, math.ceil(math.log(max(classes, 1) / TWO_BLOCKS, THINNER)))
    return 2 + more, round(8 * 1.7**more)


@lru_cache(1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, by its definition: all integer or all half-integer coordinates with an even sum."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(s) % 2 == 0]
    return np.array(whole + halves)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates and an even sum: where it is odd, the worst coordinate is rounded the other way."""
    near = np.rint(x)
    left = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(left[odd]).argmax(1)
    near[odd, worst] += np.where(left[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to every row of x."""
    whole, halves = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - halves) ** 2).sum(1))[:, None], whole, halves)


@lru_cache(8)
def _projections(dims: int, tables: int, blocks: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets, and odd multipliers by which a cell's coordinates are hashed."""
    r = np.random.default_rng([SEED, dims, tables, blocks, kind])
    width = tables * blocks * 8
    return r.normal(size=(dims, width)) / SCALE, r.uniform(0, 2, width), r.integers(0, 1 << 63, (tables, blocks, 8), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length one; divided by the largest component first, so nothing overflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def cells(x: np.ndarray, room: np.ndarray, tables: int, blocks: int, probes: int, kind: int = 0) -> np.ndarray:
    """Hashes (rows, tables, probes) of the cells of unit vectors, the own one first. room: a number of label and dimension."""
    at, offset, odd = _projections(x.shape[1], tables, blocks, kind)
    y = (x @ at + offset).reshape(len(x), tables, blocks, 8)
    out = np.empty((len(x), tables, probes), np.uint64)
    steps = np.concatenate([np.zeros((1, 8)), shortest()])
    for t in range(tables):
        best, keys = np.zeros((len(x), 1)), np.broadcast_to(np.uint64(t + 1) + room[:, None], (len(x), 1))
        for b in range(blocks):
            home = decode(y[:, t, b])
            near = np.zeros((len(x), 1), np.int64)
            further = np.zeros((len(x), 1))
            if probes > 1:
                away = 2 - 2 * (y[:, t, b] - home) @ steps[1:].T  # of squared distance, by each of the 240
                near = np.argpartition(away, NEIGHBOURS - 2, axis=1)[:, : NEIGHBOURS - 1]
                further = np.concatenate([further, np.take_along_axis(away, near, 1)], 1)
                near = np.concatenate([np.zeros((len(x), 1), np.int64), near + 1], 1)
            points = (2 * (home[:, None, :] + steps[near])).astype(np.int64).astype(np.uint64)
            hashed = (points * odd[t, b]).sum(2, dtype=np.uint64)
            best = (best[:, :, None] + further[:, None, :]).reshape(len(x), -1)
            keys = (_mixed(keys)[:, :, None] + hashed[:, None, :]).reshape(len(x), -1)
            if best.shape[1] > probes:  # sums only grow, so what is behind now stays behind
                first = np.argpartition(best, probes - 1, axis=1)[:, :probes]
                best, keys = np.take_along_axis(best, first, 1), np.take_along_axis(keys, first, 1)
        out[:, t] = np.take_along_axis(_mixed(keys), np.argsort(best, axis=1, kind="stable"), 1)[:, :probes]
    return out


def signs(x: np.ndarray) -> np.ndarray:
    r = np.random.default_rng([SEED, x.shape[1]]).normal(size=(x.shape[1], 64))
    return np.packbits(x @ r > 0, axis=1).view(np.int64)[:, 0]


def _by_dims(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, vectors) of the vectors of each dimension in an Arrow list column without nulls."""
    ends = column.offsets.to_numpy()
    flat, ends = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]
    size = np.diff(ends)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, flat[ends[at][:, None] + np.arange(d)]


def _each(work: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], list], names: list[str], step: int = 500):
    """An Arrow function: work(positions, unit vectors, batch) gives columns; the batch's first column is the vectors."""

    def run(batches):
        for batch in batches:
            for at, x in _by_dims(batch.column(0)):
                for k in range(0, len(at), step):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(at[k : k + step], units(x[k : k + step]), batch)], names=names)

    return run


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, h1, h2 of every row, null where it links with nothing; the distinct vectors with h1, h2, cls, room, weight, least)."""
    sound = "embedding IS NOT NULL AND label IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("ok", F.expr(sound))
    h = [F.when(F.col("ok"), F.xxhash64(F.lit(k), "label", "embedding")).alias(f"h{k}") for k in (1, 2)]
    room = F.xxhash64("label", F.size("embedding")).alias("room")
    rows = rows.select("vec_id", *h, F.when(F.col("ok"), F.col("embedding")).alias("embedding"), room)
    found = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.first("room").alias("room"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    classes = materialize(found.withColumn("cls", F.monotonically_increasing_id()), "lattice-classes")
    return rows.select("vec_id", "h1", "h2"), classes


def grouped(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, entity, block of the classes in groups; entity, vec, angle, weight, blocks of the groups)."""

    def fine(at, x, batch):
        room = batch.column(2).to_numpy()[at].astype(np.uint64)
        return [batch.column(1).to_numpy()[at], cells(x, room, 1, FINE_BLOCKS, 1, kind=1)[:, 0, 0].astype(np.int64)]

    keyed = materialize(classes.select("embedding", "cls", "room").mapInArrow(_each(fine, ["cls", "fine"]), "cls long, fine long"), "lattice-fine")
    dense = keyed.groupBy("fine").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= GROUP).select("fine")
    members = materialize(keyed.join(dense, "fine").join(classes.select("cls", "embedding", "weight"), "cls"), "lattice-members")

    def sums(batches):
        held: dict[int, np.ndarray] = {}

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["fine", "part"])

        for given in batches:
            for at, x in _by_dims(given.column(0)):
                x, key = units(x), given.column(1).to_numpy()[at]
                for k in np.unique(key):
                    held[int(k)] = held.get(int(k), 0) + x[key == k].sum(0)
            if len(held) > 5000:
                yield batch()
                held = {}
        if held:
            yield batch()

    parts = members.select("embedding", "fine").mapInArrow(sums, "fine long, part array<double>").select("fine", F.posexplode("part").alias("i", "x"))
    means = parts.groupBy("fine", "i").agg(F.sum("x").alias("x")).groupBy("fine").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")).select("fine", F.col("m.x").alias("vec"))
    means = materialize(means.filter("exists(vec, x -> x <> 0)"), "lattice-means")

    def angles(at, x, batch):
        m = np.stack([batch.column(3)[int(k)].values.to_numpy() for k in at])
        return [batch.column(1).to_numpy()[at], batch.column(2).to_numpy()[at], np.arccos(np.clip((x * units(m)).sum(1), -1, 1)), batch.column(4).to_numpy()[at]]

    names = "cls long, fine long, angle double, weight long"
    told = members.join(means, "fine").select("embedding", "cls", "fine", "vec", "weight").mapInArrow(_each(angles, ["cls", "fine", "angle", "weight"]), names)
    told = materialize(told.filter(F.col("angle") <= (math.acos(COSINE) - SLACK) / 2), "lattice-angles")
    groups = told.groupBy("fine").agg(F.min("cls").alias("entity"), F.max("angle").alias("angle"), F.sum("weight").alias("weight"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    groups = materialize(groups.join(means, "fine"), "lattice-groups")
    inside = told.join(groups.select("fine", "entity", "blocks"), "fine").select("cls", "entity", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"))
    return inside, groups.drop("fine")


def _meetings(placed: DataFrame, tables: int, blocks: int) -> DataFrame:
    """a, b (a < b) of entities of which one looks into a cell in which the other stands."""

    def at_cells(probes: int):
        def work(at, x, batch):
            room = batch.column(2).to_numpy()[at].astype(np.uint64)
            found = cells(x, room, tables, blocks, probes).reshape(len(at), -1).astype(np.int64)
            n = found.shape[1]
            return [found.ravel(), *(np.repeat(c, n) for c in (batch.column(1).to_numpy()[at], signs(x), batch.column(3).to_numpy(zero_copy_only=False)[at]))]

        one = placed.select("embedding", "entity", "room", "group").mapInArrow(_each(work, ["key", "entity", "signs", "group"]), "key long, entity long, signs long, group boolean")
        many = one.filter("group").withColumn("signs", F.lit(0).cast("long")).distinct()
        return one.filter("not group").unionByName(many)

    stand, look = at_cells(1).toDF("key", "x", "xs", "xg"), at_cells(PROBES).toDF("key", "y", "ys", "yg")
    met = stand.join(look, "key").filter((F.col("x") != F.col("y")) & (F.col("xg") | F.col("yg") | (F.bit_count(F.col("xs").bitwiseXOR(F.col("ys"))) <= SIGNS)))
    return materialize(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "lattice-meetings")


def _judged(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """a, b, whole (all of a links with all of b; false: some may), and the weights and blocks of both; the rest is dropped."""
    link = math.acos(COSINE)

    def judge(batches):
        for batch in batches:
            n = batch.num_rows
            dot = np.zeros(n)
            others = {int(k): x for at, x in _by_dims(batch.column(1)) for k, x in zip(at, units(x), strict=True)}
            for at, x in _by_dims(batch.column(0)):
                dot[at] = (units(x) * np.stack([others[int(k)] for k in at])).sum(1)
            spread = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            apart = np.arccos(np.clip(dot, -1, 1))
            whole = np.where(spread == 0, dot >= COSINE, apart + spread <= link - SLACK)
            some = np.where(spread == 0, whole, apart - spread <= link + SLACK)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:4], pa.array(whole), *batch.columns[6:]], names=["a", "b", "whole", "wa", "wb", "ka", "kb"]).filter(pa.array(some))

    side = lambda k: entities.select(F.col("entity").alias(k), F.col("vec").alias(f"v{k}"), F.col("angle").alias(f"t{k}"), F.col("weight").alias(f"w{k}"), F.col("blocks").alias(f"k{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("va", "vb", "a", "b", "ta", "tb", "wa", "wb", "ka", "kb")
    return materialize(both.mapInArrow(judge, "a long, b long, whole boolean, wa long, wb long, ka int, kb int"), "lattice-judged")


def _verified(open_: DataFrame, classes: DataFrame, placed: DataFrame) -> DataFrame:
    """a, b, cls, n of pairs (a, b) that the bounds left open: the rows of the other side that a class of either side links with."""
    ends = open_.select(F.col("a").alias("entity")).unionByName(open_.select(F.col("b").alias("entity"))).distinct()
    held = placed.join(ends, "entity").groupBy("entity", "block").agg(F.collect_list(F.struct("cls", "weight", F.col("embedding").cast("array<double>").alias("v"))).alias("m"))
    held = materialize(held, "lattice-held")
    pairs = open_.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("i"), "kb").select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("j"))
    one, two = held.toDF("a", "i", "ma"), held.toDF("b", "j", "mb")

    def verify(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            for k in range(batch.num_rows):
                ids = [batch.column(c)[k].as_py() for c in (0, 1)]
                sides = [batch.column(c)[k].values for c in (2, 3)]
                x, y = (units(np.stack(s.field(2).to_numpy(zero_copy_only=False))) for s in sides)
                linked = x @ y.T >= COSINE
                for s, other, hits in ((sides[0], sides[1], linked), (sides[1], sides[0], linked.T)):
                    n = hits @ other.field(1).to_numpy()
                    at = np.flatnonzero(n)
                    for col, v in zip(out, (np.full(len(at), ids[0]), np.full(len(at), ids[1]), s.field(0).to_numpy()[at], n[at]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.array([]), pa.int64()) for c in out], names=["a", "b", "cls", "n"])

    joined = pairs.join(one, ["a", "i"]).join(two, ["b", "j"]).select("a", "b", "ma", "mb")
    return materialize(joined.mapInArrow(verify, "a long, b long, cls long, n long"), "lattice-verified")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    with scratch() as used:
        rows, classes = classes_of(vectors)
        most = classes.groupBy("room").count().agg(F.max("count")).head()[0] or 0
        blocks, tables = plan(most)
        inside, groups = grouped(classes)
        placed = classes.select("cls", "room", "embedding", "weight").join(inside, "cls", "left")
        placed = placed.select("cls", "room", "embedding", "weight", F.coalesce("entity", "cls").alias("entity"), F.coalesce("block", F.lit(0)).alias("block"), F.col("entity").isNotNull().alias("group"))
        placed = materialize(placed, "lattice-placed")
        single = placed.filter("not group").select("entity", F.col("embedding").cast("array<double>").alias("vec"), F.lit(0.0).alias("angle"), "weight", F.lit(1).alias("blocks"))
        entities = single.unionByName(groups.select("entity", "vec", F.greatest("angle", F.lit(SLACK)).alias("angle"), "weight", "blocks"))
        judged = _judged(_meetings(placed, tables, blocks), entities)
        whole = judged.filter("whole")
        verified = _verified(judged.filter("not whole").select("a", "b", "ka", "kb"), classes, placed)
        by_entity = whole.select(F.col("a").alias("entity"), F.col("wb").alias("n")).unionByName(whole.select(F.col("b").alias("entity"), F.col("wa").alias("n")))
        own = groups.select("entity", F.col("weight").alias("n")).unionByName(single.select("entity", F.col("weight").alias("n")))
        by_entity = by_entity.unionByName(own).groupBy("entity").agg(F.sum("n").alias("n"))
        by_class = verified.groupBy("cls").agg(F.sum("n").alias("more"))
        labels = components(whole.select("a", "b").unionByName(verified.select("a", "b").distinct()))
        counted = placed.select("cls", "entity").join(by_entity, "entity").join(labels, F.col("entity") == F.col("node"), "left").join(by_class, "cls", "left")
        counted = counted.select("cls", F.coalesce("label", "entity").alias("component"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
        counted = materialize(counted.join(classes.select("cls", "h1", "h2", "least"), "cls"), "lattice-counted")
        least = counted.groupBy("component").agg(F.min("least").alias("component_id"))
        told = counted.join(least, "component").select("h1", "h2", "n_links", "component_id")
        out = rows.join(told, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "lattice-rows")
    discard(spark, used)
    return out
