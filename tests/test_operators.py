"""Small fixtures for the traps of each operator."""

import math

import pytest
from evenkeel.functions import scalars as S
from evenkeel.operators import evaluation as V
from evenkeel.operators import relational as O
from evenkeel.operators import timeline as L
from pyspark.sql import functions as F


def values(df, c):
    return [r[c] for r in df.collect()]


def test_flags_and_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ["True", "1", "1.0", "yes", " TRUE ", "no", None, "x"]], "x string")
    assert values(df.select(S.to_flag(F.col("x")).alias("f")), "f") == [1, 1, 1, 1, 1, 0, 0, 0]
    df = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("abc",), (None,)], "x string")
    assert values(df.select(S.to_number(F.col("x")).alias("n")), "n") == [1.5, None, None, None, None]


def test_margins(spark):
    df = spark.createDataFrame([(10.0, -0.5, 0.5), (10.0, -0.51, 0.51), (5.0, -2.0, 9.0), (5.01, -2.0, 9.0), (None, -2.0, 9.0)], "d double, r double, v double")
    c = S.closing_speed(F.col("r"))
    rows = df.select(S.time_to_collision(F.col("d"), c).alias("ttc"), S.time_headway(F.col("d"), F.col("v")).alias("thw"), S.required_deceleration(F.col("d"), c).alias("drac"), S.clipped(S.time_to_collision(F.col("d"), c) * 100, 0.0, 100.0).alias("cap")).collect()
    assert [r.ttc is None for r in rows] == [True, False, True, False, True]
    assert [r.thw is None for r in rows] == [True, False, False, False, True]
    assert [r.drac is None for r in rows] == [True, False, True, False, True]
    assert rows[1].cap == 100 and rows[0].cap is None


def test_closed_windows_and_scaffold(spark):
    df = spark.createDataFrame([(1, 0), (1, 10), (1, 20), (1, 21)], "k int, u long")
    got = {(r.j, r.u) for r in L.sliding(df, "u", 10, 10, 1, 3).collect()}
    assert got == {(1, 0), (1, 10), (2, 10), (2, 20), (3, 20), (3, 21)}
    assert L.scaffold(df.select("k").distinct(), 1, 3).count() == 3


def test_alignment_edges(spark):
    df = spark.createDataFrame([(1, 15, 1.0, 1), (1, 25, 3.0, 2), (2, 12, 5.0, 3)], "k int, u long, v double, id long")
    grid = L.grid(df.select("k").distinct(), 4, 10)
    get = lambda out: {(r.k, r.i): r.value for r in out.collect()}
    ffill = get(L.as_of(df, grid, "k", "u", F.col("v"), "id"))
    back = get(L.as_of(df, grid, "k", "u", F.col("v"), "id", backfill=True))
    line, clamp = get(L.interpolate(df, grid, "k", "u", F.col("v"), "id")), get(L.interpolate(df, grid, "k", "u", F.col("v"), "id", clamp=True))
    assert ffill[1, 0] is None and ffill[1, 2] == 1 and back[1, 0] == 1 and ffill[1, 3] == 3
    assert line[1, 2] == 2 and line[1, 0] is None and line[1, 3] is None and line[2, 2] is None
    assert clamp[1, 0] == 1 and clamp[1, 3] == 3 and clamp[2, 2] == 5


def test_runs(spark):
    rows = [("a", 1, 1), ("a", 2, 1), ("a", 3, 0), ("a", 4, 1), ("b", 1, 1), ("c", 1, 0)]
    df = spark.createDataFrame(rows, "k string, t long, f int")
    got = {r.k: r.longest for r in L.longest_run(df, ["k"], "t", "t", F.col("f") == 1).collect()}
    assert got == {"a": 1, "b": 0, "c": 0}


def fit(xs):
    """Quadratic least squares in a window of 7 or 5, evaluated at each point."""
    import numpy as np

    n = len(xs)
    w = 7 if n >= 7 else 5
    out = []
    for i in range(n):
        st = max(0, min(i - w // 2, n - w))
        out.append(float(np.polyval(np.polyfit(np.arange(w), xs[st : st + w], 2), i - st)))
    return out


@pytest.mark.parametrize("n", [4, 5, 6, 7, 8, 20])
def test_smoothing(spark, n):
    xs = [math.sin(3 * i) * 5 + i for i in range(n)]
    got = spark.createDataFrame([(xs,)], "a array<double>").select(L.smoothed(F.col("a")).alias("s"), L.step_rates(F.col("a"), 0.5).alias("r")).first()
    want = xs if n < 5 else fit(xs)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got.s, want))
    assert got.r is None if n < 5 else len(got.r) == n - 1


def test_onset_needs_a_quiet_start(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([9.0, 1.0, 1.0, 1.0, 8.0, 9.0, 1.0])], "k int, t long, v double")
    got = {r.t: r.onset for r in L.onsets(df, "k", "t", "t", "v", 4, 1.8, 1.0).collect()}
    assert [t for t, x in sorted(got.items()) if x] == [4]


def test_one_to_one_refuses_repeats(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, p string"), spark.createDataFrame([(1, "y"), (1, "z")], "k int, q string")
    with pytest.raises(ValueError):
        O.join_one_to_one(a, b, ["k"])
    with pytest.raises(ValueError):
        O.join_complete(spark.createDataFrame([(2, "x")], "k int, p string"), b, ["k"])


def test_rank_correlation_guards(spark):
    rows = [("few", 1.0, 2.0)] * 4 + [("flat", 1.0, float(i)) for i in range(6)] + [("up", float(i), float(i * i)) for i in range(6)]
    got = {r.k: r.rho for r in O.rank_correlation(spark.createDataFrame(rows, "k string, a double, b double"), ["k"], "a", "b").collect()}
    assert got["few"] is None and got["flat"] is None and abs(got["up"] - 1) < 1e-12


def test_group_split_is_disjoint_and_near_targets():
    sizes = [(f"g{i}", 1 + i % 3) for i in range(300)] + [("big", 90)]
    out = V.greedy_split(sizes, {"train": 0.6, "val": 0.2, "test": 0.2})
    total = sum(n for _, n in sizes)
    for part, share in (("train", 0.6), ("val", 0.2), ("test", 0.2)):
        assert abs(sum(n for g, n in sizes if out[g] == part) / total - share) < 0.01


def test_encode(spark):
    train = spark.createDataFrame([(1.0, f"c{i}", None) for i in range(31)] + [(float("inf"), "c0", None), (3.0, None, None)], "x double, c string, e double")
    test = spark.createDataFrame([(None, "new", None), (2.0, "c0", 1.0)], "x double, c string, e double")
    _, out = V.encode(train, test, ["x", "e"], ["c"])
    rows = sorted((r.c, r.x0, r.x1, round(r.x2, 6)) for r in out.collect())
    assert rows == [("c0", 2.0, 1.0, round(2 / 33, 6)), ("new", 1.0, 0.0, 0.0)]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("a", "c")], "t string, p string")
    m = V.class_metrics(df, "t", "p").first()
    assert abs(m.balanced_acc - (1 / 3 + 1) / 2) < 1e-12 and abs(m.acc - 0.5) < 1e-12 and m.n_test == 4
    assert abs(m.macro_f1 - (2 / 4 + 2 / 3 + 0) / 3) < 1e-12
