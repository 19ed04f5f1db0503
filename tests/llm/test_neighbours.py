from __future__ import annotations

import numpy as np
import pytest

from quireflow.llm import neighbours as N


def exact(ids, vectors, k):
    units = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    cosines = units @ units.T
    out = {}
    for i, a in enumerate(ids):
        order = sorted((-round(cosines[i, j], 12), b) for j, b in enumerate(ids) if j != i)
        out[a] = [b for _, b in order[:k]]
    return out


def clustered(seed, n, size):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, size))
    return (centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, size))).astype(np.float32)


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in zip(ids, vectors, strict=True)], "id long, emb array<float>, vec string")


def found(df, size, k, lists=None):
    out = {}
    for r in N.nearest(df, "id", "emb", size, k, lists=lists).orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.other)
    return out


def test_one_list_is_exact(spark):
    vectors = clustered(1, 180, 16)
    ids = [int(x) for x in np.random.default_rng(2).permutation(1000)[:180]]
    assert found(frame(spark, ids, vectors), 16, 10) == exact(ids, vectors, 10)


def test_recall_with_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "_BLOCK", 32)
    vectors = clustered(3, 1200, 24)
    ids = list(range(1200))
    want, got = exact(ids, vectors, 10), found(frame(spark, ids, vectors), 24, 10, 30)
    assert set(got) == set(ids) and all(len(x) == 10 for x in got.values())
    assert np.mean([len(set(want[i]) & set(got[i])) / 10 for i in ids]) > 0.97


def test_copies_ties_and_unusable_vectors(spark):
    a, b, c = [1, 0, 0], [0.9, 0.1, 0], [0, 0, 1]
    rows = {5: a, 3: a, 9: a, 7: a, 1: b, 4: c, 6: None, 8: [1, 2], 10: [0, 0, 0], 11: [float("nan"), 0, 0], 12: [None, 0, 1], 13: [float("inf"), 0, 0]}
    got = found(frame(spark, rows, rows.values()), 3, 2)
    assert got == {3: [5, 7], 5: [3, 7], 7: [3, 5], 9: [3, 5], 1: [3, 5], 4: [1, 3]}


def test_many_copies(spark):
    rows = [[1.0, 0.0]] * 60 + [[0.0, 1.0], [1.0, 1.0]]
    got = found(frame(spark, range(62), rows), 2, 3)
    assert got[0] == [1, 2, 3] and got[59] == [0, 1, 2] and got[60] == [61, 0, 1] and got[61] == [0, 1, 2]


@pytest.mark.parametrize("rows", [{}, {1: [1.0, 0.0]}, {1: None}])
def test_too_few(spark, rows):
    assert found(frame(spark, rows, rows.values()), 2, 3) == {}


def test_test_drops_only_far_candidates():
    scan = N._Scan(16, 3)
    units = clustered(4, 60, 16).astype(np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    distance = 2 - 2 * units @ units.T
    q, c, s = scan.beyond(units, units, scan.turned(units), scan.turned(units), np.full(60, 0.5))
    kept = set(zip(q.tolist(), c.tolist(), strict=True))
    near = {(i, j) for i in range(60) for j in range(60) if distance[i, j] <= 0.5}
    assert len(near - kept) <= 0.02 * len(near) and len(kept) < 1.2 * len(near) + 60
    assert np.allclose(s, (units @ units.T)[q, c])
