"""States in event time: the batch answer whatever order rows come in; episodes against a plain loop."""

import datetime as dt
import random

import pytest
from evenkeel import streaming
from evenkeel.operators import timeline
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def rows_of(n, seed, keys="ab"):
    rng = random.Random(seed)
    return [(i, rng.choice(keys), START + dt.timedelta(seconds=10 * i + rng.choice([0, 0, 5])), None if rng.random() < 0.2 else float(rng.choice([1, 1, 2, 9])), rng.random() < 0.5) for i in range(n)]


SCHEMA = "id long, k string, ts timestamp, v double, f boolean"


def arrivals(spark, path, rows, files, within=6):
    """Files in turn; rows change places only with neighbours, so within a minute or so."""
    rng = random.Random(3)
    rows = sorted(rows, key=lambda r: r[0] + rng.random() * within)
    size = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * size : (n + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/t.parquet")
    return streaming.read_table(spark, str(path), "t", 1)


def passed(rows, late):
    last = max(r[2] for r in rows)
    return [r for r in rows if r[2] < last - dt.timedelta(seconds=late)]


def test_onsets_and_carried_by_event_time(spark, tmp_path):
    rows = rows_of(150, 1)
    stream = arrivals(spark, tmp_path, rows, 5)
    table = spark.createDataFrame(rows, SCHEMA)
    want = {r.id: r.onset for r in timeline.onsets(table, "k", "ts", "id", "v", 4, 1.8, 1.0).collect()}
    out = streaming.onsets_in_order(stream, "k", "ts", "v", 4, 1.8, 1.0, late="3 minutes", tie="id")
    got = {r.id: r.onset for r in streaming.drained(out, "append").collect()}
    assert got == {r[0]: want[r[0]] for r in passed(rows, 180)} and None in got.values() and True in got.values()
    out = streaming.carried_in_order(stream, "k", "ts", "v", late="3 minutes", tie="id")
    got = {r.id: r.last for r in streaming.drained(out, "append").collect()}
    last, carried = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        last[r[1]] = last.get(r[1]) if r[3] is None else r[3]
        carried[r[0]] = last[r[1]]
    assert got == {r[0]: carried[r[0]] for r in passed(rows, 180)}


def test_late_rows_and_idle_keys(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    for n, rows in enumerate([[(1, "a", at(0), 5.0, True)], [(2, "a", at(100), None, True)], [(3, "a", at(1), 7.0, True), (4, "a", at(5000), None, True)], [(5, "b", at(20000), None, True), (6, "b", None, 1.0, True), (7, "a", at(50), 9.0, True)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    stream = streaming.read_table(spark, str(tmp_path), "t", 1)
    got = {r.id: r.last for r in streaming.drained(streaming.carried_in_order(stream, "k", "ts", "v", late="10 seconds"), "append").collect()}
    # 3 comes before 2 is taken; 7 is too late
    assert got == {1: 5.0, 3: 7.0, 2: 7.0, 4: 7.0}
    got = {r.id: r.last for r in streaming.drained(streaming.carried_in_order(stream, "k", "ts", "v", late="10 seconds", idle="10 minutes"), "append").collect()}
    assert got == {1: 5.0, 3: 7.0, 2: 7.0, 4: None}


def plain_episodes(rows, gap, least_on, least_off):
    out = {}
    for k in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        runs = []
        for i, r in enumerate(mine):
            if r[4] and (i == 0 or not mine[i - 1][4]):
                if runs and runs[-1][1] is not None and r[2] - runs[-1][1] < gap:
                    runs[-1][1] = None
                else:
                    runs.append([r[2], None])
            if not r[4] and i and mine[i - 1][4]:
                runs[-1][1] = r[2]
        for j, (a, b) in enumerate(runs):
            end = mine[-1][2] if b is None else b
            off = (runs[j + 1][0] if j + 1 < len(runs) else mine[-1][2]) - end
            out.setdefault(k, []).append((a, end, end - a, off, b is not None and end - a >= least_on and off >= least_off))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_episodes(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), rng.randrange(0, 120), None, rng.choice([True, True, False, None])) for i in range(120)] + [(500, "one", 3, None, True), (501, "off", 3, None, False)]
    df = spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in rows], "id long, k string, t int, f boolean")
    got = {}
    for r in timeline.episodes(df, "k", "t", "id", F.col("f"), 5, 4, 3).orderBy("k", "start", "end").collect():
        got.setdefault(r.k, []).append((r.start, r.end, r.on_span, r.off_span, r.switch))
    want = {k: sorted(v) for k, v in plain_episodes(rows, 5, 4, 3).items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert timeline.episodes(df.limit(0), "k", "t", "id", F.col("f"), 5, 4, 3).count() == 0


def test_episodes_of_a_stream(spark, tmp_path):
    rows = rows_of(150, 7)
    out = streaming.episodes_in_order(arrivals(spark, tmp_path, rows, 4), "k", "ts", "f", 25.0, late="3 minutes", tie="id")
    got = {r.id: r.episode for r in streaming.drained(out, "append").collect()}
    found = plain_episodes(rows, dt.timedelta(seconds=25), dt.timedelta(0), dt.timedelta(0))
    for r in passed(rows, 180):
        if not r[4]:
            assert got[r[0]] is None
        else:
            assert found[r[1]][got[r[0]] - 1][0] <= r[2] <= found[r[1]][got[r[0]] - 1][1]
    assert len(got) == len(passed(rows, 180))
