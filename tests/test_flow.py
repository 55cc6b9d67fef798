"""Motion scalars against plain loops."""

from itertools import combinations

import numpy as np
import pytest
from evenkeel.operators import flow
from pyspark.sql import functions as F

RULES = flow.Rules(border=1, hood=0.1, step=2, least_points=4, least_area=0.02, guesses=10_000)


def plain(u, v, h, w, rules):
    """The same by loops over pixels and pairs."""
    hood = h - int(round(rules.hood * h))
    valid = [(y, x) for y in range(rules.border, min(h - rules.border, hood)) for x in range(rules.border, w - rules.border)]
    points = [(y, x) for y, x in valid if (y - rules.border) % rules.step == 0 and (x - rules.border) % rules.step == 0 and np.isfinite(u[y, x] + v[y, x])]
    if len(points) < rules.least_points:
        return None
    moved = {p: (p[1] + u[p], p[0] + v[p]) for p in points}
    best = []
    for p, q in combinations(points, 2):
        (x1, y1), (x2, y2) = moved[p], moved[q]
        dx, dy, ex, ey = q[1] - p[1], q[0] - p[0], x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        a, b = (dx * ex + dy * ey) / n, (dx * ey - dy * ex) / n
        tx, ty = x1 - a * p[1] + b * p[0], y1 - b * p[1] - a * p[0]
        near = [r for r in points if np.hypot(a * r[1] - b * r[0] + tx - moved[r][0], b * r[1] + a * r[0] + ty - moved[r][1]) <= rules.tolerance]
        if len(near) > len(best):
            best = near
    rows, right = [], []
    for p in best:
        rows += [[p[1], -p[0], 1, 0], [p[0], p[1], 0, 1]]
        right += list(moved[p])
    a, b, tx, ty = np.linalg.lstsq(np.array(rows, float), np.array(right), rcond=None)[0]
    ru, rv = u.copy(), v.copy()
    for y in range(h):
        for x in range(w):
            ru[y, x] -= a * x - b * y + tx - x
            rv[y, x] -= b * x + a * y + ty - y
    size = np.hypot(ru, rv)
    seen = [p for p in valid if np.isfinite(size[p])]
    limit = max(rules.least_motion, rules.times_median * np.median([size[p] for p in seen]))
    left, areas, corridor = {p for p in seen if size[p] > limit}, [], 0
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        some = []
        while todo:
            y, x = todo.pop()
            some.append(x)
            for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    todo.append(q)
        if len(some) >= rules.least_area * h * w:
            areas.append(len(some) / (h * w))
            corridor += rules.left * w <= np.mean(some) <= rules.right * w
    inner = [p for p in seen if rules.left * w <= p[1] < rules.right * w]
    top = max(seen, key=lambda p: (size[p], -p[0], -p[1]))
    return {
        "flow_valid": 1.0, "flow_ransac_inlier_frac": len(best) / len(points), "flow_global_tx": tx, "flow_global_ty": ty, "flow_global_scale": np.hypot(a, b), "flow_global_rot": np.arctan2(b, a),
        "flow_res_valid_frac": len(seen) / (h * w), "flow_res_mag_mean": np.mean([size[p] for p in seen]), "flow_res_mag_max": size[top], "flow_res_max_x_frac": top[1] / (w - 1), "flow_res_max_y_frac": top[0] / (h - 1),
        "flow_res_corridor_mag_mean": np.mean([size[p] for p in inner]), "flow_res_lat_mean": np.mean([ru[p] for p in seen]), "flow_res_long_mean": np.mean([rv[p] for p in seen]),
        "flow_imo_count": len(areas), "flow_imo_area_frac": sum(areas), "flow_imo_corridor_count": corridor, "flow_imo_max_area_frac": max(areas, default=0), "flow_imo_mean_area_frac": np.mean(areas) if areas else 0,
    }


def fields(n, h, w, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.indices((h, w))
    for k in range(n):
        turn = (1 + 0.05 * rng.normal()) * np.exp(1j * 0.05 * rng.normal())
        z = x + 1j * y
        m = turn * z + complex(*rng.normal(size=2)) - z + rng.normal(size=(h, w, 2)) @ [0.05, 0.05j]
        for _ in range(k % 4):
            r, c = rng.integers(1, h - 3), rng.integers(1, w - 3)
            m[r : r + 3, c : c + 3] += complex(4, 3)
        if k % 5 == 4:
            m[rng.integers(0, h), rng.integers(0, w)] = np.nan
        yield m.real.copy(), m.imag.copy()


def test_against_loops(spark):
    h, w = 10, 12
    made = list(fields(24, h, w))
    df = spark.createDataFrame([(k, u.ravel().tolist(), v.ravel().tolist(), "x") for k, (u, v) in enumerate(made)], "id int, U array<double>, v array<double>, `a.b` string")
    out = flow.flow_scalars(df.repartition(3), "U", "v", h, w, RULES)
    assert out.columns == ["id", "U", "v", "a.b", *flow.SCALARS]
    for r in out.collect():
        for name, value in plain(*made[r.id], h, w, RULES).items():
            assert r[name] == pytest.approx(value, abs=1e-6), (r.id, name)


def test_divergence_and_percentiles():
    field = flow.Field(9, 9, flow.Rules(border=0, hood=0.0, step=1, least_points=4, guesses=200))
    y, x = np.indices((9, 9))
    still = field.scalars(np.zeros(81), np.zeros(81))
    assert still["flow_valid"] == 1 and still["flow_global_scale"] == 1 and still["flow_res_mag_max"] == 0 and still["flow_imo_count"] == 0
    # a bump that grows outwards is what the camera doesn't explain
    near = np.exp(-((x - 4) ** 2 + (y - 4) ** 2) / 2)
    bump = field.scalars(near * (x - 4), near * (y - 4))
    assert bump["flow_div_max"] > 1 and abs(bump["flow_global_tx"]) < 0.2 and bump["flow_res_mag_p95"] <= bump["flow_res_mag_max"]


def test_odd_rows(spark):
    flat = [0.0] * 64
    rows = [(1, None, flat), (2, flat[:5], flat), (3, [None] * 64, flat), (4, flat, [float("inf")] * 60 + flat[:4]), (5, flat, flat)]
    df = spark.createDataFrame(rows, "id int, u array<double>, v array<double>")
    rules = flow.Rules(border=0, hood=0.0, step=1, least_points=10)
    got = {r.id: r for r in flow.flow_scalars(df, "u", "v", 8, 8, rules).collect()}
    assert [got[k].flow_valid for k in range(1, 6)] == [0, 0, 0, 0, 1]
    assert all(got[1][c] == 0 for c in flow.SCALARS)
    assert flow.flow_scalars(df.limit(0), "u", "v", 8, 8, rules).count() == 0
    with pytest.raises(ValueError):
        flow.flow_scalars(df.withColumn("Flow_Valid", F.lit(1)), "u", "v", 8, 8)
