import zlib

import numpy as np
import pytest

from spillway.llm import packing, token_store
from spillway.llm._tokens import Encoder, vocabulary

TEXTS = ["a  b\n\n c' 'street it's don't", "ÀÉ ßµ ²³¼ ª 'S", "  lead", "trail  \n", "x​日本 語", "<|endoftext|> a", "tab\tb\r\nc", "12 345", "?'s!'t", "", " ", "é́", "_a_b _ 9_"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_librarys(name):
    e = Encoder(vocabulary(name), words=5)
    whole = [np.array(x.ids, "<u4").tobytes() for x in e.library.encode_batch(TEXTS, add_special_tokens=False)]
    assert e.ids(TEXTS) == whole
    long = "it's a  test of\nlong texts " * 60_000
    assert e.ids([long])[0] == np.array(e.library.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


def test_shards_round_trip(spark, documents, odd_rows):
    docs = documents(odd_rows)
    manifest = token_store.write_token_shards(docs, vocabulary("byte_bpe_50k.json"))
    rows = token_store.token_digests(token_store.read_token_shards(manifest)).collect()
    lib = Encoder(vocabulary("byte_bpe_50k.json")).library
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for r in order:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert token_store.read_token_shards(token_store.write_token_shards(documents([]), vocabulary("byte_bpe_50k.json"))).count() == 0


def test_lookup_by_bloom_and_index(tmp_path):
    import pyarrow.fs as pafs

    fs = pafs.LocalFileSystem()
    values = {i * 3: np.arange(i % 700, dtype="<u4").tobytes() for i in range(3000)}
    with fs.open_output_stream(str(tmp_path / "s")) as f:
        w = token_store.Writer(f)
        for k, v in values.items():
            w.add(token_store.key_of(k, 0), v)
        w.add(token_store.key_of(10**9, 0), np.array([70000], "<u4").tobytes())
        w.add(token_store.key_of(10**9, 1), b"")
        w.close()
    with fs.open_input_file(str(tmp_path / "s")) as f:
        r = token_store.Reader(f)
        assert len(r.blocks) > 10 and r.n_docs == 3002
        assert all(r.get(k) == [v] for k, v in values.items())
        assert r.get(1) == [] and r.get(-5) == []
        assert r.get(10**9) == [np.array([70000], "<u4").tobytes(), b""]
        assert [k for k, _ in r.scan()] == [*values, 10**9, 10**9]


def test_packing_places_every_piece_once(documents, odd_rows):
    cap = 64
    rows = odd_rows * 4
    pieces = packing.token_pieces(documents(rows), vocabulary("word_bpe_49k.json"), capacity=cap)
    out = packing.packed_digests(pieces, cap).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= cap
    total = sum(r["length"] for r in out)
    assert -(-total // cap) <= len(by) <= -(-total // cap) + 1
    lib = Encoder(vocabulary("word_bpe_49k.json")).library
    want = sum(len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert total == want
    assert packing.packed_digests(packing.token_pieces(documents([]), vocabulary("word_bpe_49k.json"))).count() == 0


def test_plan_uses_each_length_as_counted():
    import random

    r = random.Random(1)
    for _ in range(30):
        cap = r.choice([16, 40, 200])
        counts = {r.randint(1, cap): r.randint(1, 50) for _ in range(r.randint(1, cap))}
        used: dict = {}
        for lengths, k in packing.pack_lengths(dict(counts), cap):
            assert sum(lengths) <= cap and k >= 0
            for x in lengths:
                used[x] = used.get(x, 0) + k
        assert {k: v for k, v in used.items() if v} == counts


def test_rare_words_are_not_kept_and_ids_do_not_depend_on_it():
    from spillway.llm._tokens import Encoder, vocabulary

    path = vocabulary("word_bpe_49k.json")
    few, many = Encoder(path, words=400), Encoder(path)
    for i in range(20):
        texts = [f"the same words w{chr(97 + i)}{chr(97 + j)}q and more" for j in range(20)] * 2
        assert few.ids(texts) == many.ids(texts)
        assert len(few.words) <= 200 and len(few.older) <= 200
    assert "same" in few.words and Encoder(path).limit <= 200_000
