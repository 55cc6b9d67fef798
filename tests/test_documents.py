import json

import numpy as np
from evenkeel.operators import documents as D


def test_telemetry_document(spark):
    rng = np.random.default_rng(2)
    t = 100 + np.sort(rng.uniform(0, 20, 150)).round(4)
    t[0] = 100.0
    v, on = rng.uniform(5, 30, 150).round(3), (rng.random(150) < 0.5).astype(float)
    car = [("a", float(x), float(s), float(o)) for x, s, o in zip(t, v, on)] + [("b", float(i), 1.0, 0.0) for i in range(4)]
    radar = [("a", 103.0, 50.0, -5.0, 1.0), ("a", 110.0, 20.0, -0.1, 1.0), ("a", 115.0, 10.0, -4.0, 0.0)]
    topics = {
        "carState": spark.createDataFrame(car, "clip_id string, time_s double, vEgo double, cruiseState_enabled double"),
        "radarState": spark.createDataFrame(radar, "clip_id string, time_s double, leadOne_dRel double, leadOne_vRel double, leadOne_status double"),
    }
    index = spark.createDataFrame([("a", "qlog", 10.0)], "clip_id string, log_kind string, log_hz double")
    rows = D.telemetry(topics, index, ["clip_id"], {"carState": ["cruiseState_enabled"], "radarState": ["leadOne_status"]}).collect()
    assert [r.clip_id for r in rows] == ["a"]
    doc = json.loads(rows[0].document)
    grid = 100 + np.arange(401) / 20
    want = np.interp(grid, t, v, left=np.nan, right=np.nan)
    got = np.array([np.nan if x is None else x for x in doc["series"]["vEgo"]])
    assert np.allclose(got, want, atol=6e-5, equal_nan=True)
    at = np.clip(np.searchsorted(t, grid + 1e-9, side="right") - 1, 0, 149)
    assert doc["series"]["cruiseState_enabled"] == on[at].tolist() == doc["series"]["adas_engaged"]
    assert abs(doc["adas_engaged_pct"] - 100 * on[at].mean()) < 1e-9
    d, r = np.interp(grid, [103, 110, 115], [50, 20, 10]), np.interp(grid, [103, 110, 115], [-5, -0.1, -4])
    k = 90  # 104.5 s: a leader, closing
    assert abs(doc["series"]["ttc"][k] - d[k] / -r[k]) < 2e-3 and abs(doc["series"]["closing_mps"][k] + r[k]) < 2e-3
    assert doc["series"]["ttc"][20] is None and doc["series"]["ttc"][320] is None and doc["series"]["thw"][k] is not None
    assert doc["t"][0] == -10 and doc["t"][200] == 0 and doc["n_samples"] == 401 and doc["event_index"] == 200 and doc["log_kind"] == "qlog"
    assert set(doc["native_hz"]) == {"carState"} or set(doc["native_hz"]) == {"carState", "radarState"}
    assert any("Hz" in w for w in doc["warnings"])
