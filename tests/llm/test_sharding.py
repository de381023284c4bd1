from collections import Counter

from spillway.llm import sharding


def test_law_of_rows_and_groups(documents, odd_rows):
    rows = [*odd_rows, *[(100 + i, f"text {i // 3}", "en", "s") for i in range(300)], *[(1000 + i, "one hot text", "en", "s") for i in range(150)]]
    out = sharding.shard_documents(documents(rows)).collect()
    assert len(out) == len(rows)
    sizes = Counter(r["shard"] for r in out)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    apart = Counter((r["size"], r["text_crc32"]) for r in out)
    homes = {k: len({r["shard"] for r in out if (r["size"], r["text_crc32"]) == k}) for k in apart}
    small = [k for k, n in apart.items() if 1 < n <= len(rows) // 40]
    assert sum(homes[k] == 1 for k in small) >= 0.9 * len(small)
    hot = max(apart, key=apart.get)
    assert homes[hot] <= -(-apart[hot] // (len(rows) // 40)) + 3


def test_same_result_again_and_small_tables(documents):
    rows = [(i, f"t{i % 7}", None, None) for i in range(60)]
    a, b = (sorted(map(tuple, sharding.shard_documents(documents(rows)).drop("grown_shard").collect())) for _ in range(2))
    assert a == b
    assert sharding.shard_documents(documents([])).count() == 0
    few = sharding.shard_documents(documents(rows[:3])).collect()
    assert len({r["shard"] for r in few}) == 3


def test_cut_edges_match_pairs_and_stay_below_hashing(documents):
    rows = [(i, f"text {i % 90 if i % 3 else i}", "en", "s") for i in range(700)]
    sharded = sharding.shard_documents(documents(rows))
    out = sharded.collect()
    r = sharding.cut_edges(sharded).first()
    apart = [(a["shard"] != b["shard"]) for i, a in enumerate(out) for b in out[:i] if (a["size"], a["text_crc32"]) == (b["size"], b["text_crc32"])]
    assert (r["edges"], r["cut"]) == (len(apart), sum(apart))
    assert sum(apart) == 0  # every group fits into a shard, and there is room
    hashed = sharded.withColumn("shard", sharding.F.pmod(sharding.F.xxhash64("doc_id"), sharding.F.lit(40)))
    assert sharding.cut_edges(hashed).first()["cut"] > 0.8 * len(apart)


def test_full_shards_split_what_has_no_room(documents):
    # Groups of 7 over 4 shards of 10 or 9 places: no second group fits into a shard, and every row is linked.
    rows = [(i, f"group {i // 7}", "en", "s") for i in range(39)]
    out = sharding.shard_documents(documents(rows), 4).collect()
    sizes = Counter(r["shard"] for r in out)
    assert sorted(sizes.values()) == [9, 10, 10, 10]
    homes = Counter((r["size"], r["text_crc32"], r["shard"]) for r in out)
    assert sum(n == 7 for n in homes.values()) == 4
