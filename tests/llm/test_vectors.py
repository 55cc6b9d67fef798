import numpy as np
import pytest
from evenkeel.llm import vectors


def brute(rows, cosine=0.93):
    good = []
    for v, x, label in rows:
        bad = x is None or not len(x) or label is None or any(c is None or not np.isfinite(c) for c in x) or not any(x)
        good.append(None if bad else np.array(x, float) / np.linalg.norm(np.array(x, float)))
    n = len(rows)
    near = [[j for j in range(n) if j != i and good[i] is not None and good[j] is not None and rows[i][2] == rows[j][2] and good[i] @ good[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        first = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(near[i]), first, rows[i][0] == first))
    return sorted(out)


def test_brute_force(spark):
    rng = np.random.default_rng(6)
    rows, k = [], 0
    centres = rng.normal(size=(40, 48))
    for c in centres:
        for _ in range(rng.integers(1, 12)):
            rows.append((k, (c + rng.normal(size=48) * rng.choice([0.0, 0.05, 0.2, 0.26])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
            k += 1
    hot = rng.normal(size=48)
    for _ in range(600):
        rows.append((k, (hot + rng.normal(size=48) * 0.15).astype(np.float32).tolist(), 0))
        k += 1
    rows += [(k + i, hot.astype(np.float32).tolist(), 0) for i in range(30)]
    rows += [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 48, 1), (9004, [float("nan")] * 48, 1), (9005, [1.0] * 47 + [None], 1), (9006, [1.0] * 48, None), (9007, [float("inf")] + [1.0] * 47, 1)]
    rows.append((3, rows[3][1], rows[3][2]))
    frame = spark.createDataFrame([(v, x, lab, "k", 1) for v, x, lab in rows], "vec_id long, embedding array<float>, label int, id string, times int")
    got = {}
    for r in vectors.near_vectors(frame).collect():
        got.setdefault(r.vec_id, []).append(tuple(r))
    want = {}
    for r in brute(rows):
        want.setdefault(r[0], []).append(r)
    assert got.keys() == want.keys()
    found, there = sum(x[1] for g in got.values() for x in g), sum(x[1] for g in want.values() for x in g)
    assert 0.98 * there <= found <= there
    assert np.mean([sorted(got[k]) == sorted(want[k]) for k in want]) > 0.95
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_lengths_that_differ_are_linked_with_nothing(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0), (3, [1.0, 0.001], 0), (4, [1.0, 0.0, 0.001], 0), (5, [2.0], 0), (6, [3.0], 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False), (4, 1, 2, False), (5, 1, 5, True), (6, 1, 5, False)]


@pytest.mark.parametrize("dims,n", [(64, 3000), (384, 200), (768, 100)])
def test_recall_at_the_threshold(dims, n):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y
    for _, values, tables in vectors.PLANS:
        a, b = vectors.hashes(x, values, tables), vectors.hashes(y, values, tables)
        met = np.zeros(len(x), bool)
        for t in range(tables):
            met |= vectors.meets(a[:, t], b[:, t])[0]
        assert met.mean() > 0.9, (values, met.mean())
