"""One key with very many rows: work that grows with its rows and not with their square, the whole grid in any case."""

import pytest
from evenkeel.operators import timeline
from evenkeel.plans.catalogue import QUERIES
from pyspark.sql import functions as F


def hot(spark):
    """A key's rows, 20 of each third tick, all in a few slices, and ticks before, between and after them."""
    df = spark.range(60_000).select(F.lit("hot").alias("k"), (F.col("id") % 3000 * 3).alias("t"), F.col("id").cast("double").alias("v"), "id")
    return df, spark.range(100).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.col("id") * 100 - 100).alias("g"))


def frames(df):
    return df._jdf.queryExecution().analyzed().toString().lower()


def first(g):
    """The lowest id at the first tick from g on that has rows, the highest at the last one up to g."""
    return -(-max(g, 0) // 3)


def last(g):
    return 57_000 + min(g, 8997) // 3


def test_as_of_has_no_frame_up_to_the_end(spark):
    df, points = hot(spark)
    out = timeline.as_of(df, points, "k", "t", F.col("v"), "id", backfill=True, width=4000)
    assert "unboundedfollowing" not in frames(out)
    assert sorted((r.i, r.value) for r in out.collect()) == [(i, last(g) if g >= 0 else first(g)) for i, g in enumerate(range(-100, 9900, 100))]


def test_interpolation_has_no_frame_up_to_the_end(spark):
    df, points = hot(spark)
    out = timeline.interpolate(df, points, "k", "t", F.col("v"), "id", width=4000)
    assert "unboundedfollowing" not in frames(out)
    got = {r.i: r.value for r in out.collect()}
    assert len(got) == 100 and got[0] is None
    for i, g in enumerate(range(-100, 9900, 100)):
        if g >= 0:
            a, b, at = last(g), first(g), g - g // 3 * 3
            assert got[i] == pytest.approx(a if not at else a + (b - a) * (at / 3), abs=1e-6) if g <= 8997 else got[i] is None


def empty(spark, tmp_path):
    at = str(tmp_path / "events.parquet")
    spark.sql("select 1L as event_id, timestamp_ntz'2024-01-02 00:00:00' as ts, 1L as user_id, 'view' as event_type, 1.0D as value, '' as props").where("false").write.parquet(at)
    return str(tmp_path)


@pytest.mark.parametrize("name", ["q_asof_hot_key", "q_interp_hot_key"])
def test_grid_without_events(spark, tmp_path, name):
    """SQL has every tick, with null."""
    assert sorted(map(tuple, QUERIES[name](spark, empty(spark, tmp_path)).collect())) == [(i, None) for i in range(120)]
