"""The evaluation loop, arms, kept models and frames on small tables."""

import pytest
from evenkeel.operators import evaluation as V
from evenkeel.operators import frames
from evenkeel.operators import modelling as M
from evenkeel.operators import relational as O
from evenkeel.operators import timeline as L
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"g{i % 4}", float(i), None if i % 7 == 0 else float(i % 5), "ab"[i % 2], 2.0 * i + 1, "xyz"[i % 3] if i else None) for i in range(120)]
    return spark.createDataFrame(data, "grp string, a double, vis_b double, c string, y double, kind string")


FEATURES = M.Features(("a", "vis_b", "absent"), ("c",), "grp")


def test_prepare_and_evaluate(spark, rows):
    ready = M.prepare(rows, FEATURES, "kind")
    assert ready.columns == ["grp", "a", "vis_b", "c", "label"] and ready.count() == 119
    found = M.evaluate(M.prepare(rows, FEATURES, "y"), M.leave_one_out(rows, "grp"), FEATURES.of(rows), "line", "regression")
    assert len(found.folds) == 4 and not found.failed
    assert found.mean["mae"] < 1e-6 and abs(found.mean["r2"] - 1) < 1e-9 and found.mean["n_test"] == 30


def test_a_failing_fold_does_not_end_the_others(spark, rows, monkeypatch):
    class Breaks(V._Line):
        def fit(self, df):
            if not df.where("grp = 'g1'").limit(1).count():
                raise RuntimeError("no")
            return super().fit(df)

    monkeypatch.setitem(V.MODELS, "breaks", lambda features, label: Breaks(features[0], label))
    found = M.evaluate(M.prepare(rows, FEATURES, "y"), M.leave_one_out(rows, "grp"), FEATURES.of(rows), "breaks", "regression")
    assert [k for k, _ in found.failed] == [1] and "RuntimeError" in found.failed[0][1] and len(found.folds) == 3


def test_classes_and_compare(spark, rows):
    found = M.evaluate(M.prepare(rows, FEATURES, "kind"), M.leave_one_out(rows, "grp"), FEATURES.of(rows), "classes", "classification")
    assert len(found.folds) == 4 and not found.failed and set(found.mean) == {"balanced_acc", "macro_f1", "acc", "n_test"}
    arms = {n: M.arm(FEATURES.of(rows), n, "vis_") for n in ("base", "both")}
    out = M.compare(M.prepare(rows, FEATURES, "y"), M.leave_one_out(rows, "grp"), arms, "line", "regression")
    assert out.count() == 12 and out.agg(F.max(F.abs("delta"))).first()[0] < 1e-9


def test_arms():
    f = M.Features(("a", "b", "vis_x", "vis_y"), ("c",), "g")
    assert M.arm(f, "base", "vis_").numeric == ("a", "b")
    assert M.arm(f, "both", "vis_", drop=frozenset({"b"})).numeric == ("a", "vis_x", "vis_y")
    assert M.arm(f, "block", "vis_") == M.Features(("vis_x", "vis_y"), (), "g")
    assert M.arm(f, "block", "flow_") is None
    assert M.arm(f, "near", "vis_", base=("vis_y",), groups={"near": ("vis_x",)}).numeric == ("a", "b", "vis_y", "vis_x")
    with pytest.raises(ValueError):
        M.arm(f, "other", "vis_")


def test_kept_model_and_single_predictions(spark, rows, tmp_path):
    ready = rows.select("a", F.lit(1.0).alias("z"), F.col("y").alias("label"))
    model = V.MODELS["ridge"](["a", "z"], "label").fit(ready)
    M.keep_model(model, ["a", "z"], str(tmp_path))
    got = M.predict(spark, str(tmp_path), rows.select("a", "kind").limit(5))
    assert got.count() == 5 and {"prediction", "kind", "z"} <= set(got.columns)
    one = M.predict_one(rows, {"a": 5.0}, FEATURES.of(rows), "y", ["line", "nosuch"], "regression")
    assert abs(one["models"]["line"]["prediction"] - 11.0) < 1e-6 and not one["models"]["nosuch"]["available"] and one["degenerate"]
    with pytest.raises(KeyError):
        M.predict_one(rows, {"a": -1.0}, FEATURES.of(rows), "y", ["line"], "regression")


def test_model_table(spark):
    link = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "k int, n_match int")
    labels = spark.createDataFrame([(1, "t", "1.5", "x", "2"), (2, "t", "bad", "y", None)], "k int, trigger string, pre_a string, pre_text string, post_y string")
    out, record = M.model_table(link, labels, ["k"], "trigger", text=("pre_text",))
    assert sorted((r.k, r.pre_a, r.post_y) for r in out.collect()) == [(1, 1.5, 2.0), (2, None, None)]
    assert record["features_numeric"] == ["pre_a"] and record["targets"] == ["post_y"]
    with pytest.raises(ValueError):
        M.model_table(link, labels, ["k"], "trigger", text=("pre_text",), deny=frozenset({"pre_a"}))


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.round(rng.exponential(size=20_000) * 50, 1)
    df = spark.createDataFrame([(float(v), None if k % 3 else float(k % 2), None) for k, v in enumerate(x)], "a double, b double, c double")
    got = {(r.column, r.point): r.value for r in O.exact_quantiles(df, ["a", "b", "c"], [0.0, 0.05, 0.5, 0.951, 1.0]).collect()}
    want = {("a", p): np.quantile(x, p) for p in (0.0, 0.05, 0.5, 0.951, 1.0)} | {("b", p): np.quantile([k % 2 for k in range(0, 20_000, 3)], p) for p in (0.0, 0.05, 0.5, 0.951, 1.0)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rare_labels(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 9 + [(None,)], "y string")
    assert sorted(str(r.y) for r in V.collapse_rare(df, "y").collect()) == ["None"] + ["a"] * 10 + ["other"] * 9


def test_decision_times():
    assert L.decision_times(3.5, 0.5) == [round(-6.5 + 0.5 * k, 6) for k in range(14)]
    assert L.decision_times(2.0, 1.0, 1.0, 3.0) == [-3.0, -2.0, -1.0]
    for bad in ((0, 1), (10, 1), (2, 0), (2, 1, -1.0), (2, 1, 3.0, 2.0)):
        with pytest.raises(ValueError):
            L.decision_times(*bad)


def test_carried_lead_over_corridor_boxes(spark):
    kind = "struct<cls: int, conf: double, x1: double, y1: double, x2: double, y2: double>"
    big, small, aside = (2, 0.9, 40.0, 0.0, 70.0, 60.0), (2, 0.8, 30.0, 30.0, 45.0, 45.0), (2, 0.9, 0.0, 0.0, 20.0, 90.0)
    walker = (0, 0.9, 40.0, 0.0, 90.0, 90.0)
    data = [("a", 1, [small, aside, walker]), ("a", 2, [big, small, aside]), ("a", 3, []), ("a", 4, [big, small]), ("b", 1, [big]), ("b", 2, None)]
    df = spark.createDataFrame(data, f"k string, t int, b array<{kind}>").withColumn("c", frames.candidates(F.col("b"), F.lit(100.0)))
    out = frames.carried_leads(df, "k", "t", "c").collect()
    got = {(r.k, r.t): r.lead and r.lead.conf for r in out}
    assert got == {("a", 1): 0.8, ("a", 2): 0.8, ("a", 3): None, ("a", 4): 0.9, ("b", 1): 0.9, ("b", 2): None}
    cols = frames.lead_columns(F.col("lead"), F.lit(100.0), F.lit(100.0))
    rows = frames.carried_leads(df, "k", "t", "c").select("k", "t", *[c.alias(n) for n, c in cols.items()]).where("k = 'b'").orderBy("t").collect()
    assert rows[0].lead and abs(rows[0].area - 0.18) < 1e-12 and abs(rows[0].cx - 0.05) < 1e-12 and not rows[1].lead and rows[1].area is None
