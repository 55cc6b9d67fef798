"""As-of and interpolation by slices of time give what they give over whole keys."""

import random

import pytest
from evenkeel.operators import timeline
from pyspark.sql import functions as F


@pytest.mark.parametrize("width", [1, 7, 40, 10_000])
def test_slices_change_nothing(spark, width):
    rng = random.Random(width)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(-50, 200), rng.choice([None, 1.0, 2.5, 9.0])) for i in range(150)] + [(900, "late", 150, 3.0), (901, "void", 3, None)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v double")
    points = spark.createDataFrame([(k, i, 9 * i - 60) for k in ("a", "b", None, "late", "void", "none") for i in range(30)], "k string, i long, g long")
    for back in (False, True):
        one, other = (sorted(map(str, timeline.as_of(df, points, "k", "t", F.col("v"), "id", back, w).collect())) for w in (None, width))
        assert one == other and len(one) == 180
    for clamp in (False, True):
        one, other = (sorted(map(str, timeline.interpolate(df, points, "k", "t", F.col("v"), "id", clamp, w).collect())) for w in (None, width))
        assert one == other and len(one) == 180


def test_one_key_is_spread_over_tasks(spark):
    """What is gathered of one key goes by slice, and no task has it all."""
    df = spark.range(20_000).select(F.col("id"), F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    points = spark.range(200).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.col("id") * 100 + 50).alias("g"))
    out = timeline.as_of(df, points, "k", "t", F.col("v"), "id", width=500)
    assert out.where("value <> g").count() == 0 and out.count() == 200
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_slice" in plan
