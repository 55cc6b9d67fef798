import pytest
from evenkeel.operators import evaluation as V
from evenkeel.operators import modelling as M
from evenkeel.settings import Settings


def test_from_environment(spark):
    got = Settings.from_environment({"EVENKEEL_SEED": "7", "EVENKEEL_WINDOW_S": "2", "EVENKEEL_FRACTIONS": "train=0.8, test=0.2", "OTHER": "x"})
    assert got == Settings(seed=7, window_s=2.0, fractions=(("train", 0.8), ("test", 0.2)))
    assert got.record(spark)["shuffle_partitions"] == 4
    with pytest.raises(ValueError):
        Settings.from_environment({"EVENKEEL_FOLDS": "many"})


def test_seed_decides_ties_only():
    sizes = [(f"g{i}", 5) for i in range(40)] + [("big", 50)]
    parts = {"train": 0.6, "val": 0.2, "test": 0.2}
    a, b, again = (V.greedy_split(sizes, parts, seed) for seed in (1, 2, 1))
    assert a == again and a != b and a["big"] == b["big"] == "train"
    count = lambda x: sorted((p, list(x.values()).count(p)) for p in parts)
    assert count(a) == count(b) == count(V.greedy_split(sizes, parts))


def test_status(spark):
    assignment = spark.createDataFrame([("a", "train", 5), ("b", "test", 2), ("c", "train", 1)], "g string, split string, n_rows long")
    got = M.status(assignment)
    assert got["splits"] == {"train": {"groups": 2, "rows": 6}, "test": {"groups": 1, "rows": 2}}
    assert {"line", "ridge", "logistic"} <= set(got["models"])
