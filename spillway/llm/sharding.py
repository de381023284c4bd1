"""Sharding by balanced label propagation, in DataFrame functions only. Law: `rows`, counts at most one apart.

Linked documents share a link key (here: equal texts), and each of them is a neighbour of all others of its key. As they
have the same neighbours, the state is kept as (key, shard, how many documents), never as pairs, and a hot key has at
most one row a shard.

1. Labels: a linked document starts with a shard by a hash of its identifier; a key counts its documents by label. A
   key is one block of documents, or blocks of a shard's quota each if it is larger than that.
2. Rounds, each a few joins. A block asks for the shard that most of its neighbours have at that time - those
   that were admitted somewhere, with the others' labels - among the shards with room for all of it, or else for one of
   those with room by a hash; the blocks of one key, which fill a shard each, ask for one shard after the other. Wishes are summed by shard and priority class, the largest blocks first, since they save
   the most edges, and admitted as long as they fit: a quota is never exceeded. Whoever is refused takes the wish as its
   label and asks again in the next round, when the neighbours' shards and the room have changed. A block that has room
   nowhere is cut in halves. This ends when every block is admitted, as single documents always find room.
3. Documents without links fill the shards' remaining places: they are numbered, and shard s takes as many numbers as it
   has places. The counts are then at most one apart.

The driver sees no more than a number for each shard and round. No step brings a key's documents into one task: numbers
are dealt by hash buckets, whose number grows with the table, and only keys of several blocks are numbered at all.

Cases: null text is as an empty one, of size 16 and linked with the other empty ones; repeated rows are documents of
their own; a null identifier is allowed; an empty table gives no rows; ties go by hash, then key; fewer documents than
shards leave some shards empty; only identifier and text are read, so other columns' names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import discard, materialize, ranked, scratch

SHARDS = 40
#: Documents of a hash bucket over which the documents of a key, a shard or the whole table are numbered, about.
BUCKET = 2000
#: Priority classes of a target's wishes: by the doubled logarithm of the block's size, then by a hash that is another one in each round.
SIZES, TICKETS = 128, 64


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and link key of every document."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("key"),
    )


def _quota(n: int, shards: int, shard: int) -> int:
    return n // shards + (shard < n % shards)


def _admitted(wish: DataFrame, room: dict[int, int], turn: int) -> DataFrame:
    """wish: key, begin, end, target. The rows that fit into the room of their target, largest first by priority class."""
    size = F.col("end") - F.col("begin")
    weight = F.least(F.floor(2 * F.log2(size.cast("double"))), F.lit(SIZES - 1)).cast("int")
    ticket = F.pmod(F.xxhash64("begin", "key", F.lit(turn)), F.lit(TICKETS)).cast("int")
    wish = wish.withColumns({"turn": (SIZES - 1 - weight) * TICKETS + ticket, "size": size})
    asked = wish.groupBy("target", "turn").agg(F.sum("size").alias("asked"))
    upto = W.partitionBy("target").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    rooms = F.create_map(*[F.lit(x) for pair in room.items() for x in pair])
    won = asked.withColumn("upto", F.sum("asked").over(upto)).filter(F.col("upto") <= rooms[F.col("target")]).select("target", "turn", F.lit(True).alias("won"))
    # At most shards x SIZES x TICKETS rows, whatever the input.
    return wish.join(F.broadcast(won), ["target", "turn"], "left").select("key", "begin", "end", "target", F.coalesce("won", F.lit(False)).alias("won"))


def propagate(labels: DataFrame, n: int, shards: int = SHARDS) -> DataFrame:
    """labels: key, shard, n (documents of the key with that label). Returns key, begin, end, shard: the documents of a
    key that are numbered from begin and below end are in that shard."""
    spark, quota = labels.sparkSession, max(1, n // shards)
    with scratch() as used:
        labels = materialize(labels, "shard-labels")
        totals = labels.groupBy("key").agg(F.sum("n").alias("n"))
        begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(quota).cast("long")))
        blocks = totals.select("key", "n", begin.alias("begin")).select("key", "begin", F.least("n", F.col("begin") + quota).alias("end"))
        asking, votes = materialize(blocks, "shard-asking"), labels
        settled, turn = None, 0
        while asking.limit(1).count():
            held = {} if settled is None else {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.sum(F.col("end") - F.col("begin")).alias("n")).collect()}  # a row a shard
            room = {s: _quota(n, shards, s) - held.get(s, 0) for s in range(shards)}
            rooms = F.create_map(*[F.lit(x) for pair in room.items() for x in pair])
            widest = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(room[s]).cast("long").alias("room")) for s in sorted(room, key=lambda s: (-room[s], s))])
            size = F.col("end") - F.col("begin")
            # Neighbours' shards of now: labels of those that ask, places of those that were admitted.
            ranks = votes.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("key", "shard").alias("h"), "shard")), asc=False).alias("ranks"))  # a shard each at most
            wish = asking.join(ranks, "key", "left").withColumn("ranks", F.filter("ranks", lambda x: rooms[x["shard"]] >= size))
            exact = F.filter("ranks", lambda x: rooms[x["shard"]] == size)  # fills the shard, so nothing is left over there
            wish = wish.withColumn("ranks", F.when(F.size(exact) > 0, exact).otherwise(F.col("ranks")))
            liked = F.get("ranks", F.pmod(F.floor(F.col("begin") / quota), F.greatest(F.size("ranks"), F.lit(1))).cast("int"))["shard"]
            open_, tight = (F.filter(widest, f) for f in (lambda r: r["room"] >= size, lambda r: r["room"] == size))
            open_ = F.when(F.size(tight) > 0, tight).otherwise(open_)
            other = F.get(open_, F.pmod(F.xxhash64("key", "begin", F.lit(turn)), F.greatest(F.size(open_), F.lit(1))).cast("int"))["shard"]
            wish = materialize(wish.withColumn("target", F.coalesce(liked, other)).select("key", "begin", "end", "target"), "shard-wishes")
            told = materialize(_admitted(wish.filter("target is not null"), room, turn), "shard-told")
            mine = told.filter("won").select("key", "begin", "end", F.col("target").alias("shard"))
            settled = mine if settled is None else settled.unionByName(mine)
            half = F.floor((F.col("begin") + F.col("end")) / 2)
            parts = F.array(F.struct(F.col("begin").alias("b"), half.alias("e")), F.struct(half.alias("b"), F.col("end").alias("e")))
            cut = wish.filter("target is null").select("key", F.inline(parts)).select("key", F.col("b").alias("begin"), F.col("e").alias("end"))
            refused = told.filter("not won")
            asking = materialize(refused.select("key", "begin", "end").unionByName(cut), "shard-asking")
            placed = settled.join(asking.select("key").distinct(), "key", "left_semi")
            now = placed.unionByName(refused.select("key", "begin", "end", F.col("target").alias("shard")))
            votes = materialize(now.groupBy("key", "shard").agg(F.sum(F.col("end") - F.col("begin")).alias("n")), "shard-labels")
            turn += 1
        empty = spark.createDataFrame([], "key binary, begin long, end long, shard int")
    out = materialize(empty if settled is None else settled, "shard-settled")
    discard(spark, used)
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows = materialize(linked_documents(docs), "shard-documents")
    n = rows.count()
    spread = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(7)), F.lit(max(64, n // BUCKET))).cast("int")
    label = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    by_shard = rows.groupBy("key", label.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    linked = materialize(by_shard.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "shard-keys")
    settled = propagate(by_shard.join(linked, "key", "left_semi"), n, shards)
    by_key = settled.groupBy("key").agg(F.count(F.lit(1)).alias("blocks"), F.first("shard").alias("shard"))
    tagged = rows.join(by_key, "key", "left")  # a hot key's rows are split by adaptive execution: nothing is gathered by key
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    whole = tagged.filter("blocks = 1").select(*rows.columns, "shard")
    several = ranked(tagged.filter("blocks > 1").select(*rows.columns), ["key"], order, spread, "number")
    parts = settled.join(by_key.filter("blocks > 1").select("key"), "key", "left_semi")
    split = several.join(parts, (several["key"] == parts["key"]) & (F.col("number") >= F.col("begin")) & (F.col("number") < F.col("end"))).select(*[several[c] for c in rows.columns], "shard")
    alone = tagged.filter("blocks is null").select(*rows.columns, F.lit(None).cast("int").alias("shard"))
    state = materialize(whole.unionByName(split).unionByName(alone), "shard-state")
    held = {r["shard"]: r["n"] for r in state.filter("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    places, at = [], 0
    for s in range(shards):
        free = _quota(n, shards, s) - held.get(s, 0)
        places.append((s, at, at + free))
        at += free
    free = docs.sparkSession.createDataFrame(places, "to int, begin long, end long")  # a row a shard
    filler = ranked(state.filter("shard is null").drop("shard").withColumn("_one", F.lit(0)), ["_one"], order, spread, "number")
    filled = filler.join(F.broadcast(free), (F.col("number") >= F.col("begin")) & (F.col("number") < F.col("end"))).select(*rows.columns, F.col("to").alias("shard"))
    everyone = materialize(state.filter("shard is not null").unionByName(filled), "shard-filled")
    out = ranked(everyone, ["shard"], order, spread, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(sharded: DataFrame) -> DataFrame:
    """One row: edges between documents of equal texts, and how many of them are cut, from the counts by text and shard."""
    pairs = lambda c: c * (c - 1) / 2
    n = F.col("n").cast("double")
    by_shard = sharded.groupBy("size", "text_crc32", "shard").agg(F.count(F.lit(1)).alias("n"))
    keys = by_shard.groupBy("size", "text_crc32").agg(F.sum("n").alias("n"), F.sum(pairs(n)).alias("kept")).withColumn("edges", pairs(n))
    return keys.agg(F.coalesce(F.sum("edges"), F.lit(0.0)).alias("edges"), F.coalesce(F.sum(F.col("edges") - F.col("kept")), F.lit(0.0)).alias("cut"))
