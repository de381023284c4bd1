import random

import numpy as np
import pytest

from spillway.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = [v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    x = [np.array(v, np.float32).astype(np.float64) if good else None for (_, v, _), good in zip(rows, ok, strict=True)]
    parent, links, close = list(range(len(rows))), [0] * len(rows), 0

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                c = x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j]))
                close += abs(c - 0.93) < 1e-7
                if c >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    assert not close
    return [(k, links[i], least.get(find(i)), k is not None and k == least.get(find(i))) for i, (k, _, _) in enumerate(rows)]


def near(r, v, angle):
    z = r.normal(size=len(v))
    z -= z @ v * v
    return np.cos(angle) * v + np.sin(angle) * z / np.linalg.norm(z)


def blobs(seed, dims=32):
    """Clusters of all widths, so that groups, bounds and blocks are all used; a hot one; random vectors."""
    r, rows = np.random.default_rng(seed), []
    for spread, size in ((0.0, 20), (0.05, 60), (0.12, 80), (0.19, 60), (0.3, 50), (0.38, 40)):
        base = r.normal(size=dims)
        base /= np.linalg.norm(base)
        for k in range(size):
            rows.append((near(r, base, spread * r.uniform(0.5, 1.2)) * r.uniform(0.1, 30), k % 2 if spread == 0.05 else 1))
    rows += [(r.normal(size=dims), k % 3) for k in range(150)]
    order = r.permutation(len(rows))
    return [(int(k), [float(x) for x in rows[i][0]], int(rows[i][1])) for k, i in enumerate(order)]


ODD = [
    (None, [1.0, 2.0, 3.0], 1),
    (7001, [1.0, 2.0, 3.0], 1),
    (7001, [2.0, 4.0, 6.0], 1),
    (7002, [1.0, 2.0, 3.0], None),
    (7003, None, 1),
    (7004, [], 1),
    (7005, [0.0, 0.0, 0.0], 1),
    (7006, [1.0, None, 3.0], 1),
    (7007, [1.0, float("nan"), 3.0], 1),
    (7008, [1.0, float("inf"), 3.0], 1),
    (7009, [1.0, 2.0, 3.0, 0.0], 1),
    (None, [-5.0, 1.0, 0.5], 2),
    (None, [-5.0, 1.0, 0.5], 2),
]


@pytest.mark.parametrize("seed,group,block", [(1, 8, 400), (2, 2, 5), (3, 10**6, 400)])
def test_links_match_brute_force(spark, monkeypatch, seed, group, block):
    monkeypatch.setattr(lattice, "GROUP", group)
    monkeypatch.setattr(lattice, "BLOCK", block)
    rows = blobs(seed) + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({}).selectExpr("*", "'x' AS cls", "9 AS weight", "1 AS n").repartition(3)
    out = sorted(map(tuple, lattice.near_duplicates(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert sum(x[1] for x in out) >= 0.999 * sum(x[1] for x in want)
    assert out == want


def test_recall_at_the_limit(spark):
    r = random.Random(5)
    rng = np.random.default_rng(6)
    for blocks, tables in (lattice.plan(1000), lattice.plan(10**8)):
        n, hits = 2000, 0
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = np.stack([near(rng, v, np.arccos(0.93)) for v in x])
        room = np.full(n, r.getrandbits(60), np.uint64)
        hx, hy = lattice.cells(x, room, tables, blocks, lattice.PROBES), lattice.cells(y, room, tables, blocks, lattice.PROBES)
        hits = ((hx[:, :, :1] == hy) | (hy[:, :, :1] == hx)).any((1, 2)).mean()
        assert hits > 0.99, (blocks, hits)


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * 3
    near_point = lattice.decode(x)
    assert len(lattice.shortest()) == 240
    twice = (2 * near_point).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(1) & (near_point.sum(1) % 2 == 0)).all()
    for step in lattice.shortest():  # no neighbour is nearer, which for a lattice's relevant vectors means none is
        assert (((x - near_point) ** 2).sum(1) <= ((x - near_point - step) ** 2).sum(1) + 1e-9).all()


def test_empty(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lattice.near_duplicates(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect()[0].asDict() == {"vec_id": 1, "n_links": 0, "component_id": 1, "kept": True}
