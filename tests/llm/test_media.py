import hashlib
import pathlib
import tarfile
import zlib

from spillway.llm import media


def test_image_round_trip():
    for n in (1, 64, 65, 5000):
        payload, size = media.payload_of("x" * n)
        assert size == n and len(payload) % 64 == 0
        assert media.decode_image(media.encode_image(payload)) == payload


def test_stored_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    rows = media.store(docs)
    out = media.feature_columns(rows).collect()
    assert len(out) == len(odd_rows)
    texts = sorted((r[1] or "" for r in odd_rows))
    want = []
    for t in texts:
        raw = t.encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got = [(r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out]
    assert sorted(got) == sorted(want)
    for a, b in {(r["payload_sha256"], r["media_sha256"] + r["feature"]) for r in out} and [(r, s) for r in out for s in out if r["payload_sha256"] == s["payload_sha256"]]:
        assert (a["media_sha256"], a["feature"], a["media_bytes"]) == (b["media_sha256"], b["feature"], b["media_bytes"])
    heads = media.header_columns(rows).collect()
    assert {(h["width"], h["bits"]) for h in heads} == {(64, 8)}
    shard = rows.first()["shard"].removeprefix("file://")
    with tarfile.open(shard) as tar:
        assert all(len(m.name) == 68 for m in tar.getmembers())
    assert media.feature_columns(media.store(documents([]))).count() == 0


def test_equal_payloads_of_many_tasks_are_stored_once(spark, documents):
    texts = ["same text", "same text\0", "another", "same text"]  # zero bytes at the end are the padding's
    rows = [(i, texts[i % 4], "en", "s") for i in range(80)]
    docs = documents(rows).repartition(8)
    stored = media.store(docs)
    assert stored.count() == 80
    assert stored.select("digest").distinct().count() == 2
    assert stored.select("shard", "offset").distinct().count() == 2
    members = []
    folder = stored.first()["shard"].removeprefix("file://").rsplit("/", 1)[0]
    for shard in pathlib.Path(folder).glob("*.tar"):
        with tarfile.open(shard) as tar:
            members += [m.name for m in tar.getmembers()]
    assert len(members) == len(set(members)) == 2


def test_copies_beyond_the_broadcast_and_without_identifiers(spark, documents, monkeypatch):
    monkeypatch.setattr(media, "BROADCAST_BYTES", 0)
    rows = [(None, "a", "en", "s")] * 5 + [(3, "b", "en", "s")] * 4 + [(7, "b", "en", "s"), (8, None, "en", "s"), (9, "", "en", "s")]
    out = media.feature_columns(media.store(documents(rows).repartition(4))).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in out) == sorted((r[0] or 0, len(r[1] or "")) for r in rows)
    assert len({r["payload_sha256"] for r in out}) == 3
