"""Failing keys don't end the others; medians whose frame goes by each key's pace."""

import random
import statistics

import pytest
from evenkeel.operators import isolation, timeline
from pyspark.sql import functions as F


def test_failing_keys_have_reasons(spark):
    rows = [(k, i, float(i)) for k in range(30) for i in range(k % 4 + 1)] + [(None, 1, None)]
    df = spark.createDataFrame(rows, "k int, `a.b` int, v double")

    def block(t):
        if t.num_rows == 2:
            raise KeyError("two rows")
        if t.num_rows == 3:
            return {"total": "not a number"}
        if t.num_rows == 4:
            return [{"total": 1.0, "what": "first"}, {"what": "second"}]
        return [] if t.column("k")[0].as_py() == 0 else {"total": sum(x or 0 for x in t.column("v").to_pylist()), "what": str(t.column("a.b")[0].as_py())}

    out = isolation.by_key(df, ["K"], block, "total double, what string")
    assert out.columns == ["K", "total", "what", "error"]
    got = {}
    for r in out.collect():
        got.setdefault(r.K, []).append(r)
    for k in range(1, 30):
        n = k % 4 + 1
        errors = [r.error for r in got[k]]
        assert (n == 1 and errors == [None]) or (n == 2 and errors == ["KeyError: 'two rows'"]) or (n == 3 and errors[0].startswith("Arrow")) or (n == 4 and errors == [None, None])
    assert 0 not in got and got[None][0].total == 0
    well, failed, first = isolation.failures(out, 3)
    assert (well, failed) == (22, 15) and [r[0] for r in first] == [1, 2, 5]
    assert isolation.by_key(df.limit(0), ["k"], block, "total double, what string").count() == 0
    with pytest.raises(ValueError):
        isolation.by_key(df, ["k"], block, "Error string")


def test_medians_by_each_keys_pace(spark):
    rng = random.Random(1)
    rows = []
    for k, pace in (("a", 1), ("b", 4), (None, 10), ("same", 0)):
        for i in range(60):
            rows.append((len(rows), k, i * pace + (rng.randrange(2) if pace else 0), rng.choice([None, float("nan"), 1.0, 2.0, 5.5, -3.0, 8.0])))
    df = spark.createDataFrame(rows, "id int, k string, t int, `v.x` double").withColumn("Median", F.lit(1))
    out = timeline.rolling_medians_by_rate(df.repartition(5), "k", "t", "id", "v.x", 12)
    assert out.columns == ["id", "k", "t", "v.x", "median"]
    got = {r.id: r["median"] for r in out.collect()}
    for key in ("a", "b", None, "same"):
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        step = statistics.median(b[2] - a[2] for a, b in zip(mine, mine[1:]))
        look = max(1, round(12 / step)) if step > 0 else 1
        for i, r in enumerate(mine):
            known = [x[3] for x in mine[max(0, i - look) : i + 1] if x[3] is not None and x[3] == x[3]]
            assert got[r[0]] == (statistics.median(known) if known else None), (key, i)
