"""Exact n-gram Jaccard self-join by set-relation skipping, and the components of its links.

A document's set holds the 64-bit hashes of its distinct five-word shingles (of the whole word sequence below five
words). Two sets link when 100 x intersection >= 75 x union. Equal sets form a class, named by a hash of the set; every
later step works on classes, so copies are never compared.

1. Order. All tasks sort a set's shingles by the same global order, rarest first: long shingles before short ones, and
   the shingles found often in some task (an exact sum over the tasks, the HOT most frequent of them) last. The order
   steers only the cost; any order gives the same links.
2. Index. A set of size s enters s - ceil(3s/4) + 1 shingles; two linked sets share one of them. Entries carry class,
   size and position and are dealt by shingle into buckets whose number follows the size of the index. They travel as
   packed columns, a row per task and bucket.
3. Index-level skipping. In a shingle's list, sorted by size, a set meets only the block of sizes within 3/4 of its
   own; a pair is skipped where positions leave too little overlap, or where both have the same shingle before, which
   lists the pair already.
4. Answer-level skipping. A list longer than SHORT is not paired out at once. In ROUNDS rounds sets propose members of
   other components in their lists, next to them in size, and keep the PROPOSALS that most of their lists make; the
   proposals are answered and the components taken anew. Then the remaining pairs of each list are
   formed, only between different components: what a set shares with its component's other members is not asked. Where
   both sets of a pair were answered by the same leader L, they share at most what one shares with L plus what the other
   has beside L, and the pair is skipped if that is too little.
5. Verification is exact. Parity bitmaps of the sets, two bits an element, bound the intersection of a pair from above
   and drop most chance pairs; the rest have their sets, recomputed from the texts, meet in one task. A leader's pairs
   are salted by its degree.

Components: nodes move to lesser neighbours and links are drawn anew between those that are left; all in tables, nothing
is collected.

Cases: null or wordless text has an empty set and links with nothing; a null identifier keeps its row, links with
nothing and has a null component; repeated rows are in one class; an empty table gives no rows; texts of any length are
read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, materialize, scratch, small_batches

WORDS = 5
#: Frequent shingles that the broadcast order knows: 16 bytes each.
HOT = 200_000
#: Lists up to this length yield all their pairs at once.
SHORT = 16
#: Rounds of proposals in the longer lists.
ROUNDS = 2
#: Proposals of a set that a round answers.
PROPOSALS = 4
#: Index entries of a bucket.
BUCKET = 500_000
#: Entries of a longer list whose pairs one task forms; longer ones are dealt out in blocks, and blocks meet two by two.
BLOCK = 2000
#: Entries of a list that one task goes through for proposals, which are as many as its entries at most.
LINE = 100_000
#: Pairs of a leader, or leaders of a set, that one task verifies.
DEGREE = 2000
#: Bytes of an identifier table that may be broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 48 << 20
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)
_ENTRY = [("token", np.uint32), ("cls", np.int64), ("size", np.uint32), ("pos", np.uint32), ("prev", np.uint32)]


def need(a, b):
    """The least intersection of linked sets of sizes a and b: 100 i >= 75 (a + b - i)."""
    return (3 * (a + b) + 6) // 7


class Shingler:
    """Sets of texts: sorted distinct hashes, and each one's length in bytes. Keeps at most `words` words' hashes."""

    def __init__(self, words: int = 400_000):
        self.limit, self.hash = words, {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        kept = self.hash
        missing = [w for w in set(words) if w not in kept]
        if len(kept) + len(missing) > self.limit:
            kept.clear()
            missing = set(words)
        for w in missing:
            kept[w] = xxhash.xxh64_intdigest(w)
        return np.array([kept[w] for w in words], dtype=np.uint64)

    def set_of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode().lower().split() if text else []  # bytes: exactly ASCII letters and white space
        n = len(words) - WORDS + 1
        if n < 1:
            if not words:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            joined = b" ".join(words)
            return np.array([xxhash.xxh64_intdigest(joined, seed=len(words))], np.uint64), np.array([len(joined)])
        h, long = self._hashes(words), np.array([len(w) for w in words])
        mixed = h[:n] * _MULTIPLIERS[0]
        for k in range(1, WORDS):
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * _MULTIPLIERS[0] + h[k : n + k] * _MULTIPLIERS[k]
        mixed ^= mixed >> np.uint64(32)
        total = np.concatenate([[0], np.cumsum(long)])
        found, first = np.unique(mixed, return_index=True)
        return found, (total[WORDS:] - total[:-WORDS])[first]


def class_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), seed=len(found))).astype(np.int64))


def sketch(found: np.ndarray) -> bytes:
    """A parity bitmap of at least two bits an element."""
    bits = 1 << max(8, (2 * len(found)).bit_length())
    return np.packbits((np.bincount((found >> np.uint64(9)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def most_common(a: bytes, b: bytes, na: int, nb: int) -> int:
    """An upper bound of the intersection: elements outside it flip at least the bits in which the bitmaps differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _describe(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, cls, bitmap) and of shingles found more than twice in a task (token, n), by `token`."""

    def scan(batches):
        shingler, kept, size = Shingler(), [], 0

        def frequent():
            found, counts = np.unique(np.concatenate(kept), return_counts=True)
            found, counts = found[counts > 2], counts[counts > 2]
            none = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(counts, pa.int64()), none, pa.array(found.astype(np.int64))], names=["doc_id", "n", "cls", "token"]).append_column("bitmap", pa.nulls(len(found), pa.binary()))

        for batch in batches:
            n, cls, bitmap = [], [], []
            for text in batch.column("text").to_pylist():
                found, _ = shingler.set_of(text)
                n.append(len(found))
                cls.append(class_of(found) if len(found) else None)
                bitmap.append(sketch(found) if len(found) else None)
                kept.append(found)
                size += len(found)
                if size > 2_000_000:
                    yield frequent()
                    kept, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(len(n), pa.int64()), pa.array(bitmap, pa.binary())], names=["doc_id", "n", "cls", "token", "bitmap"])
        if kept:
            yield frequent()

    return materialize(_texts(docs).mapInArrow(scan, "doc_id long, n long, cls long, token long, bitmap binary"), "jaccard-sets")


class _Order:
    """The global order of shingles, by a broadcast table of the hot ones."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.tokens = tokens[at]
        self.rank = 256 + np.minimum(np.log2(np.maximum(counts[at], 1)) * 64, 4000).astype(np.uint64)

    def sort(self, found: np.ndarray, long: np.ndarray) -> np.ndarray:
        rank = np.uint64(255) - np.minimum(long, 255).astype(np.uint64)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, found), len(self.tokens) - 1)
            hot = self.tokens[at] == found
            rank[hot] = self.rank[at[hot]]
        return found[np.argsort((rank << np.uint64(48)) | (found >> np.uint64(16)))]


def _index(docs: DataFrame, order, buckets: int) -> DataFrame:
    """Packed index entries: bucket, n, body."""

    def build(batches):
        shingler, seen, kept, size = Shingler(), set(), [], 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def packed():
            token = np.concatenate([k[0] for k in kept])
            bucket = (token % np.uint64(buckets)).astype(np.int32)
            at = np.argsort(bucket, kind="stable")
            cols = [(token // np.uint64(buckets)).astype(np.uint32)] + [np.concatenate([k[i] for k in kept]) for i in range(1, 5)]
            edge = np.flatnonzero(np.diff(bucket[at])) + 1
            rows = [at[i:j] for i, j in zip([0, *edge], [*edge, len(at)], strict=True)]
            body = [squeeze.compress(b"".join(c[r].tobytes() for c in cols)) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[r[0]]) for r in rows], pa.int32()), pa.array([len(r) for r in rows], pa.int32()), pa.array(body, pa.binary())], names=["bucket", "n", "body"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                found, long = shingler.set_of(text)
                n = len(found)
                if not n or (cls := class_of(found)) in seen:
                    continue
                seen.add(cls)
                keep = n - (3 * n + 3) // 4 + 1
                token = order.value.sort(found, long)[:keep]
                prev = np.concatenate([[0], token[:-1] >> np.uint64(32)]).astype(np.uint32)
                kept.append((token, np.full(keep, cls, np.int64), np.full(keep, n, np.uint32), np.arange(keep, dtype=np.uint32), prev))
                size += keep
                if size > 1_000_000:
                    yield packed()
                    kept, size = [], 0
        if kept:
            yield packed()

    return _texts(docs).mapInArrow(build, "bucket int, n int, body binary")


def _pairs_within(e: np.ndarray, label: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Candidate pairs of one list, sorted by size; with labels, only between different ones."""
    size = e["size"].astype(np.int64)
    end = np.searchsorted(size, 4 * size // 3, side="right")  # the block of sizes that can link
    for i in range(len(e) - 1):
        if end[i] <= i + 1 or 7 * e["pos"][i] > size[i]:
            continue
        j = np.arange(i + 1, end[i])
        if label is not None:
            j = j[label[j] != label[i]]
        j = j[_admits(e[i], e[j])]
        if len(j):
            yield np.stack([np.full(len(j), e["cls"][i]), e["cls"][j]], axis=1)


def _admits(a, b) -> np.ndarray:
    """Filters of pairs whose first is the smaller: size, position, and the shingle before."""
    sa, sb = a["size"].astype(np.int64), b["size"].astype(np.int64)
    pa_, pb = a["pos"].astype(np.int64), b["pos"].astype(np.int64)
    o = need(sa, sb)
    fits = (4 * sa >= 3 * sb) & (np.minimum(sa - pa_, sb - pb) >= o) & (a["cls"] != b["cls"])
    listed = (pa_ > 0) & (pb > 0) & (a["prev"] == b["prev"])
    return fits & ~listed


def _lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by token and size, without repeated classes and single entries; begin and end of every list."""
    e = entries[np.lexsort((entries["cls"], entries["size"], entries["token"]))]
    again = np.zeros(len(e), bool)
    again[1:] = (e["token"][1:] == e["token"][:-1]) & (e["cls"][1:] == e["cls"][:-1])
    e = e[~again]
    edge = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1], [True]])) if len(e) else np.zeros(1, int)
    begin, end = edge[:-1], edge[1:]
    many = end - begin > 1
    return e, begin[many], end[many]


CANDIDATES = "a long, b long, token long, cls long, size int, pos int, prev long"
_CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("cls", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("prev", pa.int64())])


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    none = [pa.nulls(len(pairs), f.type) for f in list(_CANDIDATES)[2:]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *none], schema=_CANDIDATES)


def _candidates(index: DataFrame, buckets: int) -> DataFrame:
    """Pairs (a, b) to verify at once, and the entries of the long lists (token, cls, size, pos, prev)."""

    def lists_of(bucket: int, entries: np.ndarray):
        e, begin, end = _lists(entries)
        two = end - begin == 2
        a, b = e[begin[two]], e[begin[two] + 1]
        ok = _admits(a, b) & (7 * a["pos"].astype(np.int64) <= a["size"])
        pairs = [np.stack([a["cls"][ok], b["cls"][ok]], axis=1)]
        for i, j in zip(begin[~two], end[~two], strict=True):
            run = e[i:j]
            if j - i <= SHORT:
                pairs.extend(_pairs_within(run))
                continue
            n = len(run)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(run["token"].astype(np.int64) * buckets + bucket), pa.array(run["cls"]), pa.array(run["size"].astype(np.int32)), pa.array(run["pos"].astype(np.int32)), pa.array(run["prev"].astype(np.int64))], schema=_CANDIDATES)
        both = np.concatenate(pairs)
        if len(both):
            yield _pair_batch(both)

    def meet(batches):
        unpack, last, kept = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for bucket, n, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != last and kept:
                    yield from lists_of(last, np.concatenate(kept))
                    kept = []
                last, raw, at = bucket, unpack.decompress(body), 0
                e = np.zeros(n, _ENTRY)
                for name, kind in _ENTRY:
                    width = np.dtype(kind).itemsize * n
                    e[name] = np.frombuffer(raw[at : at + width], kind)
                    at += width
                kept.append(e)
        if kept:
            yield from lists_of(last, np.concatenate(kept))

    dealt = index.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return materialize(dealt.mapInArrow(meet, CANDIDATES), "jaccard-candidates")


def _by_list(entries: DataFrame, columns: tuple[str, ...], pairs_of) -> DataFrame:
    """Pairs (a, b) that pairs_of(run, columns by name) yields for every (token, block) of the entries, sorted by size."""

    def meet(batches):
        kept, last = [], None

        def answered(parts):
            rows = dict(zip(columns, (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True))
            run = np.zeros(len(rows["cls"]), _ENTRY)
            for name in ("cls", "size", "pos", "prev"):
                run[name] = rows[name]
            found = pairs_of(run, rows)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            token, block = batch.column("token").to_numpy(), batch.column("block").to_numpy()
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            edge = [0, *(np.flatnonzero((np.diff(token) != 0) | (np.diff(block) != 0)) + 1), len(token)]
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if i == j:
                    continue
                if kept and (token[i], block[i]) != last:
                    yield from answered(kept)
                    kept = []
                last = (token[i], block[i])
                kept.append([c[i:j] for c in cols])
        if kept:
            yield from answered(kept)

    dealt = entries.select("token", "block", *columns).repartition("token", "block").sortWithinPartitions("token", "block", "size", "cls")
    return dealt.mapInArrow(meet, "a long, b long")


def _open_lists(known: DataFrame, entries: int) -> DataFrame:
    """known: the long lists with labels. Those with more than one, with `blocks`, how many of so many entries they make, and own."""
    lists = known.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    lists = lists.select("token", F.ceil(F.col("n") / entries).cast("int").alias("blocks"))
    return known.join(lists, "token").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))


def _proposals(known: DataFrame, turn: int) -> DataFrame:
    """known: the long lists with labels. (a, b): sets b with members a of other components, at most PROPOSALS each.

    In even turns a set outside its list's commonest component proposes the member next to it in size, in later turns
    the ones further off; in odd turns every set proposes the next one in size of another component.
    """

    def pairs_of(run, rows):
        label, size = rows["label"], run["size"].astype(np.int64)
        names, counts = np.unique(label, return_counts=True)
        if len(names) == 1:
            return np.zeros((0, 2), np.int64)
        if turn % 2:
            change = np.flatnonzero(label[1:] != label[:-1]) + 1
            a, b = run[change - 1], run[change]
        else:
            home = label == names[counts.argmax()]
            inside, b = run[home], run[~home]
            at = np.searchsorted(size[home], size[~home])
            side = -1 - turn // 4 if turn % 4 else turn // 4
            a = inside[np.clip(at + side, 0, len(inside) - 1)]
        s, t = a["size"].astype(np.int64), b["size"].astype(np.int64)
        fits = 4 * np.minimum(s, t) >= 3 * np.maximum(s, t)
        return np.stack([a["cls"], b["cls"]], axis=1)[fits]

    dealt = _open_lists(known, LINE).withColumn("block", F.col("own").cast("long"))
    asked = _by_list(dealt, ("cls", "size", "pos", "prev", "label"), pairs_of).groupBy("b", "a").agg(F.count(F.lit(1)).alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("n", "a")), asc=False), 1, PROPOSALS)
    return asked.groupBy("b").agg(best.alias("best")).select(F.explode("best.a").alias("a"), "b")


def _between(known: DataFrame) -> DataFrame:
    """known: the long lists with labels, leaders, bounds low and high of what a set shares with its leader, and bitmaps.

    Pairs between different labels that neither the leaders' answers nor the bitmaps settle. Block p meets block q >= p
    in a group of their own, so no task holds more than two blocks of a list.
    """

    def pairs_of(run, rows):
        label, lead, low, high, bitmap, own = (rows[c] for c in ("label", "lead", "low", "high", "bitmap", "own"))
        if len(np.unique(label)) == 1:
            return np.zeros((0, 2), np.int64)
        two = own.min() != own.max()
        at, size, found = {c: k for k, c in enumerate(run["cls"].tolist())}, run["size"].astype(np.int64), [np.zeros((0, 2), np.int64)]
        for x in _pairs_within(run, label):
            i, j = at[int(x[0, 0])], np.array([at[c] for c in x[:, 1].tolist()])
            if two:  # pairs within a block have a group of their own
                x, j = x[own[j] != own[i]], j[own[j] != own[i]]
            most = np.minimum(high[i] + size[j] - low[j], high[j] + size[i] - low[i])
            still = (lead[i] != lead[j]) | (most >= need(size[i], size[j]))
            for k in np.flatnonzero(still):
                still[k] = most_common(bitmap[i], bitmap[j[k]], int(size[i]), int(size[j[k]])) >= need(size[i], size[j[k]])
            found.append(x[still])
        return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = known.withColumn("_other", other).withColumn("block", F.least("own", "_other").cast("long") * F.col("blocks") + F.greatest("own", "_other"))
    return _by_list(dealt, ("cls", "size", "pos", "prev", "label", "lead", "low", "high", "bitmap", "own"), pairs_of)


def _bounded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs: a, b. Adds most, the bitmaps' bound of the intersection, and possible, whether it reaches what a link needs."""

    def bound(batches):
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(k).to_pylist() for k in range(6))
            most = [most_common(*row) for row in zip(x, y, na, nb, strict=True)]
            ok = [m >= need(i, j) and 4 * min(i, j) >= 3 * max(i, j) for m, i, j in zip(most, na, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(most, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "most", "possible"])

    one = members.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("xa"))
    two = members.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("xb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "xa", "xb")
    return materialize(both.mapInArrow(bound, "a long, b long, most long, possible boolean"), "jaccard-bounds")


def _small(table: DataFrame, n: str) -> DataFrame:
    """A written table, broadcast if its rows and the 24 bytes of each of their n entries are few enough."""
    held = table.agg(F.sum(F.expr(n) * 24 + 64)).head()[0] or 0
    return F.broadcast(table) if held <= BROADCAST_BYTES else table


def _verify(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared and linked of every pair (a, b). members: cls, doc_id of one document of each class."""
    degree = F.count(F.lit(1))
    leaders = pairs.groupBy("a").agg(F.ceil(degree / DEGREE).cast("int").alias("salts"))
    led = pairs.groupBy("b").agg(F.ceil(degree / DEGREE).cast("int").alias("parts"))
    salted = pairs.join(leaders, "a").join(led, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.struct(F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind")).alias("to"))
    own = leaders.select(F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    own = own.select("b", F.floor(F.col("salt") / DEGREE).cast("int").alias("part"), F.struct(F.col("b").alias("lead"), "salt", F.lit(0).alias("kind")).alias("to"))
    wanted = salted.unionByName(own).groupBy(F.col("b").alias("cls"), "part").agg(F.collect_list("to").alias("to"))  # about DEGREE entries a row
    wanted = materialize(wanted.join(members.select("cls", "doc_id"), "cls").drop("part"), "jaccard-wanted")
    texts = _texts(docs).join(_small(wanted, "size(to)"), "doc_id").select("text", "cls", "to")
    rows = pa.schema([("lead", pa.int64()), ("salt", pa.int32()), ("kind", pa.int32()), ("cls", pa.int64()), ("body", pa.binary())])

    def send(batches):
        shingler = Shingler()
        for batch in batches:
            out: list[list] = [[] for _ in rows]
            size = 0
            for row in batch.to_pylist():
                found, _ = shingler.set_of(row["text"])
                if not len(found) or class_of(found) != row["cls"]:
                    continue  # another text under the same identifier
                body = found.tobytes()
                for to in row["to"]:
                    for col, x in zip(out, (to["lead"], to["salt"], to["kind"], row["cls"], body), strict=True):
                        col.append(x)
                    size += len(body)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, rows, strict=True)], schema=rows)
                    out, size = [[] for _ in rows], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, rows, strict=True)], schema=rows)

    def meet(batches):
        lead, found = None, None
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                key = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                other = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64)
                if batch.column(2)[k].as_py() == 0:
                    lead, found = key, other.copy()
                elif key == lead:
                    at = np.searchsorted(found, other)
                    at[at == len(found)] = 0
                    shared = int((found[at] == other).sum())
                    out.append((key[0], batch.column(3)[k].as_py(), shared, shared >= need(len(found), len(other))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            cols = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["a", "b", "shared", "linked"])

    sent = texts.mapInArrow(send, "lead long, salt int, kind int, cls long, body binary")
    met = sent.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "kind").mapInArrow(meet, "a long, b long, shared long, linked boolean")
    return materialize(met.distinct(), "jaccard-answers")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node that is reachable) of every node of the undirected links (a, b).

    In each round a node moves to its least neighbour's least neighbour, and the links are drawn anew between the nodes
    that are left: links within what has come together vanish, so every round has fewer. The least node of a component
    never moves, and it is the one that is left.
    """
    spark, state = links.sparkSession, None
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    with scratch() as used:
        edges = materialize(links.select(*ends("a", "b")).filter("a < b").distinct(), "component-edges")
        while edges.limit(1).count():
            both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
            up = materialize(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("up")), "component-up")
            hop = materialize(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"), "component-hop")
            first = edges.join(hop.select(F.col("node").alias("a"), F.col("top").alias("ta")), "a")
            moved = first.join(hop.select(F.col("node").alias("b"), F.col("top").alias("tb")), "b").select(*ends("ta", "tb"))
            edges = materialize(moved.filter("a < b").distinct(), "component-edges")
            if state is None:
                state = hop.select("node", F.col("top").alias("label"))
            else:
                state = state.join(hop.select(F.col("node").alias("label"), "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
            state = materialize(state, "component-labels")
        out = spark.createDataFrame([], "node long, label long") if state is None else state
    out = materialize(out, "component-labels")
    discard(spark, used)
    return out


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls of every document; a, b of links that connect all linked classes)."""
    spark = docs.sparkSession
    small_batches(spark)
    described = _describe(docs)
    rows = described.filter("token is null").select("doc_id", "n", "cls")
    hot = described.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HOT).collect()
    order = spark.sparkContext.broadcast(_Order(np.array([r["token"] for r in hot], np.int64).astype(np.uint64), np.array([r["n"] for r in hot], np.int64)))
    members = described.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "n", "bitmap")).alias("m")).select("cls", "m.*")
    members = materialize(members, "jaccard-classes")
    entries = members.agg(F.sum(F.col("n") / 4 + 1)).head()[0] or 0
    buckets = max(1, int(entries // BUCKET))
    found = _candidates(_index(docs, order, buckets), buckets)
    bounds = _bounded(found.filter("a is not null").select("a", "b").distinct(), members)
    answers = _verify(docs, members, bounds.filter("possible").select("a", "b"))
    links, long = answers.filter("linked").select("a", "b"), found.filter("token is not null")
    if not long.limit(1).count():
        return rows, links
    led = None

    def labelled(links: DataFrame) -> DataFrame:
        labels = components(links)
        return long.join(labels, long["cls"] == labels["node"], "left").withColumn("label", F.coalesce("label", "cls")).drop("node")

    for turn in range(ROUNDS):
        bounds = _bounded(_proposals(labelled(links), turn), members)
        answers = _verify(docs, members, bounds.filter("possible").select("a", "b"))
        told = bounds.join(answers, ["a", "b"], "left").select(F.col("b").alias("led"), F.col("a").alias("lead"), F.coalesce("shared", F.lit(0)).alias("low"), F.coalesce("shared", "most").alias("high"))
        led = told if led is None else led.unionByName(told)
        links = materialize(links.unionByName(answers.filter("linked").select("a", "b")), "jaccard-links")
    led = led.groupBy("led").agg(F.max(F.struct("high", "lead", "low")).alias("x")).select("led", "x.*")
    known = labelled(links)
    known = known.join(led, known["cls"] == led["led"], "left")
    known = known.withColumns({"lead": F.coalesce("lead", "cls"), "low": F.coalesce("low", "size").cast("long"), "high": F.coalesce("high", "size").cast("long")})
    known = _open_lists(known, BLOCK).join(members.select("cls", "bitmap"), "cls")
    more = materialize(_between(known).distinct(), "jaccard-between")
    if more.limit(1).count():
        links = links.unionByName(_verify(docs, members, more).filter("linked").select("a", "b"))
    return rows, links


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls and least (the component's least identifier) of every document, written."""
    spark = docs.sparkSession
    with scratch() as used:
        rows, links = link_classes(docs)
        labels = components(links)
        labelled = rows.join(labels, rows["cls"] == labels["node"], "left").select("doc_id", "n", "cls", F.coalesce("label", "cls").alias("group"))
        least = labelled.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
        out = labelled.join(least, "group", "left")
    out = materialize(out.select("doc_id", "n", "cls", "group", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("least")), "jaccard-joined")
    discard(spark, used)
    return out


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least identifier reachable by links) of every document."""
    return _labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: the least identifier, with its least class if it has several. All columns stay.

    Documents without an identifier all stay. Of rows that repeat an identifier and a text, one stays; another text under
    that identifier is another document, which stays if its component has none with a lesser identifier. The texts stay in
    place: they are held against the identifiers that go, or those that occur more than once.
    """
    found = _labelled(docs).filter("doc_id is not null")
    best = found.filter("doc_id = least and group is not null").groupBy("group").agg(F.min("cls").alias("best")).select(F.col("group").alias("_g"), "best")
    found = found.join(best, F.col("group") == F.col("_g"), "left").withColumn("stays", F.coalesce((F.col("doc_id") == F.col("least")) & (F.col("cls") == F.col("best")), F.col("group").isNull()))
    ids = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("stays").alias("stays")), "jaccard-ids")
    again = ids.filter("rows > 1").select(F.col("doc_id").alias("_id"))
    gone = materialize(ids.filter("rows > 1 or not stays").select(F.col("doc_id").alias("_id")), "jaccard-gone")
    # The row travels as one column, so its names can't clash with those used here.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_own"), "text")
    stay = packed.join(_small(gone, "1"), F.col("_own") == F.col("_id"), "left_anti").select("_row.*")
    if not again.limit(1).count():
        return stay
    several = packed.join(again, F.col("_own") == F.col("_id"), "left_semi").dropDuplicates(["_own", "text"]).select("_row")
    kinds = materialize(found.join(again, F.col("doc_id") == F.col("_id"), "left_semi").filter("stays").select("doc_id", F.coalesce("cls", F.lit(0)).alias("cls")).distinct(), "jaccard-several")
    at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")

    def classed(batches):
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.set_of(t)[0] for t in batch.column(0).field(at).to_pylist()]
            cls = [class_of(x) if len(x) else 0 for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(id_at).cast(pa.int64()), pa.array(cls, pa.int64())], names=["_row", "_id", "_cls"])

    schema = T.StructType([*several.schema.fields, T.StructField("_id", T.LongType()), T.StructField("_cls", T.LongType())])
    rows = several.mapInArrow(classed, schema)
    kept = rows.join(kinds, (rows["_id"] == kinds["doc_id"]) & (rows["_cls"] == kinds["cls"]), "left_semi")
    return stay.unionByName(kept.select("_row.*"))
