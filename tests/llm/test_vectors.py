import pathlib

import numpy as np
import pytest

from terracell.llm import near_vectors

COLUMNS = "vec_id long, embedding array<float>, label int, h1 int, path string"


def vectors(seed, n, d, dense=60, copies=12):
    """Noise, near copies of it around the threshold, a dense group and exact copies."""
    r = np.random.default_rng(seed)
    held = [(v, int(r.integers(0, 2))) for v in r.normal(size=(n, d))]
    for _ in range(n // 3):
        v, label = held[r.integers(0, n)]
        e = r.normal(size=d)
        held.append((v + e * np.linalg.norm(v) / np.linalg.norm(e) * r.uniform(0.05, 0.42), label))
    c = r.normal(size=d)
    held += [(c * (1 + 0.1 * k) + r.normal(size=d) * 0.13 * np.linalg.norm(c) / np.sqrt(d), 0) for k in range(dense)]
    held += [(c, 0)] * copies
    return [(i, v.astype(np.float32).tolist(), label) for i, (v, label) in enumerate(held)]


def brute(rows, threshold=0.93):
    root, n = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            a, b = own[a][0], own[b][0]
            n[a], n[b] = n[a] + 1, n[b] + 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((i, n[i], find(i), find(i) == i) for i in root)


@pytest.mark.parametrize("d, options", [(64, {}), (64, {"target": 80, "block": 50}), (12, {"target": 60, "block": 50, "sample": 400})])
def test_equals_brute_force(spark, d, options):
    rows = vectors(d, 500, d)
    held = spark.createDataFrame([(*r, 0, "p") for r in rows], COLUMNS).repartition(6)
    out = near_vectors.near_vectors(held, **options).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0]
    rows = [
        (9, same, 1), (4, [2.0, 4.0], 1), (9, same, 1), (3, same, 2), (2, same, None), (None, same, 1), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (10, [nan, 1.0], 1),
        (11, [inf, 1.0], 1), (12, [1.0, 2.0, 0.0], 1), (13, [1e-30, 2e-30], 1), (14, [-1.0, -2.0], 1),
    ]
    out = near_vectors.near_vectors(spark.createDataFrame([(*r, 0, "p") for r in rows], COLUMNS)).collect()
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=lambda r: (r[0] is None, r[0] or 0))
    alone = lambda i: (i, 0, i, True)
    assert found == [alone(2), alone(3), (4, 3, 4, True), *map(alone, (5, 6, 7, 8)), (9, 3, 4, False), (9, 3, 4, False), *map(alone, (10, 11, 12)), (13, 3, 4, False), alone(14), (None, 0, None, True)]
    assert near_vectors.near_vectors(spark.createDataFrame([], COLUMNS)).count() == 0


def test_centers_of_a_dense_group_become_one():
    r = np.random.default_rng(1)
    c = r.normal(size=32)
    x = c + r.normal(size=(400, 32)) * 0.1
    x = np.vstack((x, r.normal(size=(400, 32))))
    x /= np.linalg.norm(x, axis=1)[:, None]
    centers = near_vectors.fitted(x, 20, 0.93)
    cosines = centers @ centers.T - 2 * np.eye(len(centers))
    assert 2 <= len(centers) <= 20 and cosines.max() < 0.93
    assert len({int((centers @ v).argmax()) for v in x[:400]}) == 1


def test_reach_misses_nothing_in_few_dimensions():
    assert near_vectors.reach_of(0.93, 20) == pytest.approx(np.sqrt(0.14) / 2)
    assert near_vectors.reach_of(0.93, 64) < near_vectors.reach_of(0.93, 32) < near_vectors.reach_of(0.93, 20)


def bytes_under(folder):
    return sum(p.stat().st_size for p in folder.rglob("part-*"))


def test_vectors_without_order_are_not_written_again_and_again(spark):
    r = np.random.default_rng(7)
    rows = [(i, v.astype(np.float32).tolist(), 0, 0, "p") for i, v in enumerate(r.normal(size=(3000, 64)))]
    held, home = spark.createDataFrame(rows, COLUMNS).repartition(4), pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = bytes_under(home)
    assert near_vectors.near_vectors(held, target=150, block=150).filter("n_links = 0 and kept").count() == 3000
    assert bytes_under(home) - before < 4 * 3000 * 64 * 4


def test_cut_groups_in_rounds_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "ROUND", 0.5)
    monkeypatch.setattr(near_vectors, "ROUND_ROWS", 100)
    monkeypatch.setattr(near_vectors, "SIDE", 16)
    monkeypatch.setattr(near_vectors, "SHARE", 5)
    r = np.random.default_rng(3)
    middles, rows = r.normal(size=(8, 12)), vectors(4, 150, 12)
    rows = [(i, (np.array(e) * 0.25 + middles[i % 8] * 3).astype(np.float32).tolist(), label) for i, e, label in rows]
    held = spark.createDataFrame([(*x, 0, "p") for x in rows], COLUMNS).repartition(3)
    seen, cells = [], near_vectors.cells
    monkeypatch.setattr(near_vectors, "cells", lambda *a: seen.append(cells(*a)) or seen[-1])
    out = near_vectors.near_vectors(held, target=40, block=20, sample=400).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in out) == brute(rows)
    assert seen[0]
