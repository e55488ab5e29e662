"""Clustering with history bounds against plain rounds."""

import hashlib
import random

import numpy as np
import pytest

from pairloom.llm import centroids

COLUMNS = "vec_id long, embedding array<float>, label int, v string, cluster string, d int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "v", "c", 1) for i, v in rows], COLUMNS)


def plain(rows, k, n_rounds, width, seed=2):
    """(id, cluster, distance) of every vector, by all distances in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    seeds = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    at = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(n_rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        at = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)) if j in groups else c for j, c in enumerate(at)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], at


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_same_clusters_as_plain_rounds(spark, spread):
    rng = random.Random(int(spread * 100))
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # many equal ones
    want, at = plain(rows, 12, 5, 6)
    out = centroids.cluster(table(spark, rows), k=12, width=6).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out) == sorted(want)
    assert {r.inertia for r in out} == {sum(w[2] for w in want)}
    for r in out:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)


def test_ties_empty_clusters_and_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.0]), (None, [0.25, 0.0])]
    others = [(5, None), (6, []), (7, [1.0]), (8, [None, 1.0]), (9, [inf, 0.0]), (10, [nan, 0.0]), (11, [3e38, 0.0])]
    want, _ = plain(rows, 5, 5, 2)
    out = centroids.cluster(table(spark, rows + others), k=5, width=2).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=key) == sorted(want, key=key)


def test_nothing_to_cluster(spark):
    assert centroids.cluster(table(spark, []), k=3, width=2).collect() == []


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (500, 8))
    history = [rng.integers(-300, 300, (10, 8))]
    apart = ((v[:, None] - history[0][None]) ** 2).sum(axis=2)
    cluster = apart.argmin(axis=1)
    state = [cluster, np.sqrt(apart.min(axis=1).astype(float)), np.zeros(500, np.int32), centroids._below(np.sqrt(apart.astype(float))), np.zeros((500, 10), np.int8)]
    evaluated = 0
    for step in range(6):
        # centroids go to and fro: the sum of their moves grows, their total displacement does not
        history.append(history[0] + (12 if step % 2 else 0))
        *state, count = centroids.reassigned(v, *state, np.array(history))
        apart = ((v[:, None] - history[-1][None]) ** 2).sum(axis=2)
        assert (state[0] == apart.argmin(axis=1)).all()
        low = state[3] - np.sqrt(((np.array(history) - history[-1]) ** 2).sum(axis=2).astype(float))[state[4], np.arange(10)]
        assert (low <= np.sqrt(apart) + 1e-3).all()
        evaluated += int(count.sum())
    assert evaluated < 0.2 * 6 * 500 * 10


def test_large_components_stay_exact():
    v = np.array([[2**27, -(2**27)] * 32])
    assert centroids.squared(v, -v)[0] == 64 * 2**56
