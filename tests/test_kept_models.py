"""Models that are kept with their encoder: raw rows score as they did before."""

import pytest
from evenkeel.operators import modelling as M
from evenkeel.operators.encoding import RowEncoder, RowEncoderModel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"g{i % 4}", float(i), None if i % 7 == 0 else float(i % 5), "ab"[i % 2] if i % 11 else None, f"c{i % 40}", 2.0 * i + 1, "xyz"[i % 3] if i else None, 1) for i in range(120)]
    return spark.createDataFrame(data, "id long, grp string, a double, `b.c` double, x0 string, many string, y double, kind string, X1 int").cache()


FEATURES = M.Features(("a", "b.c"), ("x0", "many"), "grp")


def ready(rows, target):
    return rows.select("id", "grp", "a", "`b.c`", "x0", "many", F.col(target).alias("label"), "X1").where("label is not null")


@pytest.mark.parametrize(("model", "target"), [("line", "y"), ("ridge", "y"), ("logistic", "y"), ("classes", "kind"), ("auto", "kind"), ("boosted", "y")])
def test_scores_raw_rows_as_before(spark, rows, tmp_path, model, target):
    fitted = M.fit(ready(rows, target), FEATURES, model, "classification" if target == "kind" else "regression")
    M.keep_model(fitted, path=f"{tmp_path}/m")
    M.keep_model(fitted, path=f"{tmp_path}/m")
    raw = rows.drop("y", "kind").withColumn("prediction", F.lit("old"))
    before, after = fitted.transform(raw), M.predict(spark, f"{tmp_path}/m", raw)
    assert after.columns == [*rows.drop("y", "kind").columns, "prediction"]
    a, b = ({r.id: r.prediction for r in x.collect()} for x in (before, after))
    assert a == b and len(set(a.values())) > 1
    assert {type(v) for v in a.values()} == ({str} if target == "kind" else {float})


def test_missing_columns_and_new_levels(spark, rows, tmp_path):
    fitted = M.fit(ready(rows, "y"), FEATURES, "ridge", "regression")
    M.keep_model(fitted, path=f"{tmp_path}/m")
    odd = spark.createDataFrame([(5.0, "new", "c1"), (None, None, "never"), (float("inf"), "a", None)], "A double, x0 string, many string")
    got = M.predict(spark, f"{tmp_path}/m", odd)
    assert got.count() == 3 and got.where("prediction is null or isnan(prediction)").count() == 0
    with pytest.raises(ValueError):
        M.predict(spark, f"{tmp_path}/m", spark.createDataFrame([(1,)], "other int"))
    bare = f"{tmp_path}/bare"
    M.keep_model(M.V.MODELS["ridge"](["a"], "y").fit(rows), ["a"], bare)
    with pytest.raises(ValueError):
        M.predict(spark, bare, rows.select("kind"))


def test_encoder_in_a_pipeline(spark, rows, tmp_path):
    encoder = RowEncoder(["a", "b.c"], ["x0", "many"])
    model = Pipeline(stages=[encoder]).fit(rows)
    model.write().overwrite().save(f"{tmp_path}/p")
    again = PipelineModel.load(f"{tmp_path}/p")
    assert isinstance(again.stages[0], RowEncoderModel)
    columns = again.stages[0].columns
    # two numbers, two letters and what stands for none, and one share
    assert len(columns) == 6 and not {c.lower() for c in rows.columns} & set(columns)
    a, b = (sorted(map(tuple, m.transform(rows).select("id", *columns).collect())) for m in (model, again))
    assert a == b
    shares = [r[-1] for r in a]
    assert all(abs(s - 3 / 120) < 1e-12 for s in shares)
    with pytest.raises(ValueError):
        again.transform(rows.withColumn(columns[0].upper(), F.lit(1)))


def test_failing_models_say_why(spark, rows):
    one = M.predict_one(rows.drop("X1"), {"a": 5.0}, FEATURES, "y", ["line", "ridge", "nosuch"], "regression")
    assert abs(one["models"]["line"]["prediction"] - 11.0) < 1e-6 and one["models"]["ridge"]["available"]
    assert "unknown model" in one["models"]["nosuch"]["error"]
