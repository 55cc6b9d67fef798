"""Ridge over all folds: held against explicit refits without each row."""

import numpy as np
from evenkeel.operators import ridge as R


def explicit(x, y, alpha):
    """Weights on raw columns and the start, by the normal equations of standardised columns."""
    m, s = x.mean(axis=0), x.std(axis=0)
    s = np.where(s > 0, s, np.inf)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / s
    return w, y.mean() - w @ m


def left_out(x, y, alpha):
    """Mean squared error at each row of a refit without it, on columns standardised by all rows."""
    s = np.where(x.std(axis=0) > 0, x.std(axis=0), np.inf)
    z = (x - x.mean(axis=0)) / s
    out = []
    for i in range(len(y)):
        zi, yi = np.delete(z, i, axis=0), np.delete(y, i)
        # the penalised problem with a free start
        a = np.column_stack([np.ones(len(yi)), zi])
        p = alpha * np.eye(a.shape[1])
        p[0, 0] = 0
        b = np.linalg.lstsq(a.T @ a + p, a.T @ yi, rcond=None)[0]
        out.append((y[i] - b[0] - z[i] @ b[1:]) ** 2)
    return np.mean(out)


def rows(n=90, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(1e6, 3, n), rng.normal(size=n), np.full(n, 7.0), rng.exponential(size=n)])
    y = 2 * (x[:, 0] - 1e6) - x[:, 1] + rng.normal(size=n) * 3
    return x, y, rng.integers(0, 4, n)


def test_all_folds_against_refits(spark):
    x, y, fold = rows()
    df = spark.createDataFrame([(*map(float, r), float(v), int(k)) for r, v, k in zip(x, y, fold)], "a double, `b.c` double, k double, X0 double, y double, fold int")
    models = R.fit_folds(df.repartition(5), ["a", "b.c", "k", "X0"], "y", "fold")
    assert sorted(models) == [0, 1, 2, 3]
    got = R.predict_folds(df, models, "fold").toPandas()
    for k, model in models.items():
        tx, ty = x[fold != k], y[fold != k]
        errors = {a: left_out(tx, ty, a) for a in R.ALPHAS}
        assert all(abs(model.errors[str(a)] - e) < 1e-6 * e for a, e in errors.items())
        assert model.alpha == min(R.ALPHAS, key=errors.get)
        w, start = explicit(tx, ty, model.alpha)
        here = got[got.fold == k]
        want = here[["a", "b.c", "k", "X0"]].to_numpy() @ w + start
        assert np.allclose(here.prediction, want, atol=1e-6)
        assert np.allclose(model.transform(df.where(f"fold = {k}")).toPandas().sort_values("a").prediction, here.sort_values("a").prediction, atol=1e-6)


def test_odd_rows_and_keeping(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 4.1, 0), (None, 3.0, 1), (float("nan"), 3.0, 1), (3.0, None, 1), (4.0, float("inf"), 1), (3.0, 6.2, None)], "a double, prediction double, fold int")
    models = R.fit_folds(df, ["a"], "prediction", "fold")
    assert sorted(models) == [0, 1]
    out = R.predict_folds(df, models, "fold")
    assert out.columns == ["a", "fold", "prediction"] and out.count() == 6 and out.where("prediction is null or isnan(prediction)").count() == 0
    model = R.Ridge(["a"], "prediction").fit(df)
    model.save(f"{tmp_path}/m")
    assert R.RidgeModel.load(spark, f"{tmp_path}/m") == model
    assert R.fit_folds(df.limit(0), ["a"], "prediction", "fold") == {}
    assert R.predict_folds(df, {}, "fold").count() == 0
    # one fold alone has no training rows
    assert R.fit_folds(df.where("fold = 0"), ["a"], "prediction", "fold") == {}
