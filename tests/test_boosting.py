"""Boosted trees: held against a plain rebuild, the same for any partitions."""

import numpy as np
import pytest
from evenkeel.operators import boosting as B
from pyspark.sql import functions as F


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] * x[:, 0] > 0, 1, 0))
    x[rng.random(n) < 0.1, 2] = np.nan
    return x, y


def frame(spark, x, y, parts):
    rows = [(*(None if np.isnan(v) else float(v) for v in r), int(k)) for r, k in zip(x, y)]
    return spark.createDataFrame(rows, "a double, `b.c` double, Slot double, y int").repartition(parts)


def rebuilt(x, y, rounds, depth, bins, rate, smooth, least):
    """Scores of every row, by trees grown row set by row set."""
    n, k = len(x), y.max() + 1
    binned = np.zeros(x.shape, int)
    for f in range(x.shape[1]):
        known = np.isfinite(x[:, f])
        bounds = np.unique(np.quantile(x[known, f], [(i + 1) / (bins - 1) for i in range(bins - 2)]))
        binned[known, f] = 1 + (x[known, f][:, None] > bounds[None, :]).sum(axis=1)
    scores = np.tile(np.log(np.bincount(y, minlength=k) / n), (n, 1))

    def grow(rows, g, h, level, out):
        best, most = None, 1e-9
        if level < depth:
            for f in range(x.shape[1]):
                for b in range(bins - 1):
                    left, right = rows[binned[rows, f] <= b], rows[binned[rows, f] > b]
                    if min(len(left), len(right)) >= least:
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + smooth) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + smooth)
                        if gain > most + 1e-12:
                            best, most = (left, right), gain
        if best is None:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + smooth)
        else:
            for part in best:
                grow(part, g, h, level + 1, out)

    for _ in range(rounds):
        e = np.exp(scores)
        p = e / e.sum(axis=1, keepdims=True)
        for c in range(k):
            grow(np.arange(n), np.rint((p[:, c] - (y == c)) * B.UNIT) / B.UNIT, np.rint(np.maximum(p[:, c] * (1 - p[:, c]), 1e-6) * B.UNIT) / B.UNIT, 0, step := np.zeros(n))
            scores[:, c] += step
    return np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)


def test_equals_a_plain_rebuild_for_any_partitions(spark):
    x, y = data()
    settings = {"rounds": 5, "depth": 2, "bins": 8, "rate": 0.3, "smooth": 1.0, "least": 15}
    models = [B.Boosted(["a", "b.c", "Slot"], "y", keep_every=2, **settings).fit(frame(spark, x, y, parts)) for parts in (1, 8)]
    assert models[0] == models[1]
    got = models[0].transform(frame(spark, x, y, 3)).collect()
    want = rebuilt(x, y, **settings)
    key = lambda r: tuple(-9e9 if v is None or v != v else v for v in r)
    by = {key(r): p for r, p in zip(x.tolist(), want)}
    for r in got:
        assert np.allclose(r.probability, by[key((r.a, r["b.c"], r.Slot))], atol=1e-9)
        assert r.prediction == int(np.argmax(r.probability))


def test_learns_and_is_kept(spark, tmp_path):
    x, y = data(3000, 2)
    train, test = frame(spark, x[:2000], y[:2000], 4), frame(spark, x[2000:], y[2000:], 4)
    model = B.Boosted(["a", "b.c", "Slot"], "y", rounds=12).fit(train)
    model.save(f"{tmp_path}/m")
    again = B.BoostedModel.load(spark, f"{tmp_path}/m")
    assert again == model
    right = again.transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.9


def test_odd_rows(spark):
    rows = [(1.0, None, 0), (float("nan"), float("inf"), 1), (None, None, None), (2.0, 3.0, 0)] * 15
    df = spark.createDataFrame(rows, "a double, prediction double, y int")
    model = B.Boosted(["a", "prediction"], "y", rounds=2, least=2).fit(df)
    out = model.transform(df.select("a", "prediction", F.lit(1).alias("_scored")))
    assert out.columns == ["a", "_scored", "probability", "prediction"] and out.count() == 60
    assert model.transform(df.limit(0)).count() == 0
    one = B.Boosted(["a"], "y", rounds=1).fit(df.where("y = 0"))
    assert one.transform(df).agg(F.max("prediction")).first()[0] == 0
    with pytest.raises(ValueError):
        B.Boosted(["a"], "y").fit(df.limit(0))
