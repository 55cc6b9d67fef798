import json

from evenkeel import streaming
from evenkeel.sources import readers, writers
from pyspark.sql import functions as F


def test_recordings(spark, tmp_path):
    for clip, meta in (("1", '{"log_hz": 10.0, "log_kind": "qlog"}'), ("2", "not json")):
        at = tmp_path / "Model X" / "d1" / "r1" / clip
        at.mkdir(parents=True)
        (at / "meta.json").write_text(meta)
        (at / "carState.csv").write_text("time_s,vEgo,standstill,cruiseState.speed\n2,3.5,True,x\n1,nan,0,9\n,7,1,1\n")
    index = {r.clip_id_pub: r for r in readers.clip_index(spark, str(tmp_path)).collect()}
    assert index[1].log_hz == 10 and index[1].car_model == "Model X" and index[2].log_hz is None
    rows = readers.topic(spark, str(tmp_path), "carState").where("clip_id_pub = 1").orderBy("time_s").collect()
    assert [(r.time_s, r.vEgo, r.standstill, r.cruiseState_speed, r.aEgo, r.gasPressed) for r in rows] == [(1.0, None, 0.0, 9.0, None, None), (2.0, 3.5, 1.0, None, None, None)]


def test_topic_files_are_csv(spark, tmp_path):
    at = tmp_path / "M" / "d" / "r" / "7"
    at.mkdir(parents=True)
    (at / "carState.csv").write_text('"note","time_s", vEgo ,"cruiseState.speed"\n"a,b",1,2.5,"9"\n"say ""x"", y",2,"3.5",\n"",3,,4\n')
    for aside in (tmp_path, at / "deeper"):
        aside.mkdir(exist_ok=True)
        (aside / "carState.csv").write_text("time_s,vEgo\n9,9\n")
    rows = readers.topic(spark, str(tmp_path), "carState").orderBy("time_s").collect()
    assert [(r.clip_id_pub, r.time_s, r.vEgo, r.cruiseState_speed) for r in rows] == [(7, 1.0, 2.5, 9.0), (7, 2.0, 3.5, None), (7, 3.0, None, 4.0)]
    lines = spark.createDataFrame([('a, "b,c" ,"d ""e""",',), ("x,y",), ("",), ('"',)], "line string")
    assert [r[0] for r in lines.select(readers.split_fields(F.col("line"))).collect()] == [["a", "b,c", 'd "e"', ""], ["x", "y"], [""], ['"']]


def test_an_empty_root(spark, tmp_path):
    assert readers.clip_index(spark, str(tmp_path)).count() == 0
    assert readers.topic(spark, str(tmp_path), "carState").count() == 0


def test_retained_frames(spark):
    df = spark.range(0, 401).select(F.col("id").alias("frame_idx"), F.lit(20.0).alias("fps"))
    rows = readers.retained_frames(df, "fps", 5.0).collect()
    assert len(rows) == 101 and min(r.t_rel for r in rows) == -10


def test_upsert_and_resume(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.upsert_parquet(old, path, ["k"])
    writers.upsert_parquet(spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    writers.resume_parquet(spark.createDataFrame([(3, "x"), (4, "d")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]


def test_json_has_no_nan(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], {"a": float("-inf")})], "x double, a array<double>, m map<string, double>")
    assert json.loads(writers.json_rows(df).first().value) == {"x": None, "a": [1.0, None], "m": {"a": None}}


def test_stream_into_table_resumes(spark, tmp_path):
    source, path, check = str(tmp_path / "events.parquet"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.range(5).withColumnRenamed("id", "k").write.parquet(source)
    streaming.to_table(streaming.read_table(spark, str(tmp_path), "events"), path, check, ["k"])
    spark.range(3, 8).withColumnRenamed("id", "k").write.mode("append").parquet(source)
    streaming.to_table(streaming.read_table(spark, str(tmp_path), "events"), path, check, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == list(range(8))


def test_topic_files_differ(spark, tmp_path):
    files = {
        "1": "time_s,vEgo,standstill\n2,3.5,True\n",
        "2": 'vEgo, "time_s" ,gasPressed,other\n7.5,1,yes,z\n,3\n\n8.5,2',
        "3": "\ufefftime_s,aEgo\r\n0.5,-1\r\n",
        "4": "nothing here",
        "5": "",
    }
    for clip, text in files.items():
        at = tmp_path / "m" / "d" / "r" / clip
        at.mkdir(parents=True)
        (at / "carState.csv").write_text(text, newline="")
    got = sorted((r.clip_id_pub, r.time_s, r.vEgo, r.aEgo, r.standstill, r.gasPressed) for r in readers.topic(spark, str(tmp_path), "carState").collect())
    assert got == [(1, 2.0, 3.5, None, 1.0, None), (2, 1.0, 7.5, None, None, 1.0), (2, 2.0, 8.5, None, None, 0.0), (2, 3.0, None, None, None, 0.0), (3, 0.5, None, -1.0, None, None)]
    report = {r.clip_id_pub: (r.n_rows, r.readable) for r in readers.topic_report(spark, str(tmp_path), "carState").collect()}
    assert report == {1: (1, True), 2: (3, True), 3: (1, True), 4: (0, False)}  # Spark lists no file without a byte
    none = readers.topic(spark, str(tmp_path), "radarState")
    assert none.count() == 0 and "leadOne_dRel" in none.columns


def test_replacing_a_table_that_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    writers.replace_parquet(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_json_report(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), (1.0, float("inf")))], "x double, s struct<a: double, b: float>").withColumn("d", F.to_date(F.lit("2024-01-02")))
    writers.json_report(df, str(tmp_path / "r.json"))
    text = (tmp_path / "r.json").read_text()
    assert json.loads(text) == {"x": None, "s": {"a": 1.0, "b": None}, "d": "2024-01-02"} and "\n  " in text


def test_states_go_from_batch_to_batch(spark, tmp_path):
    source = str(tmp_path / "events.parquet")
    rows = [("a", 1, 9.0), ("a", 2, 1.0), ("a", 3, None), ("b", 1, None)]
    kinds = "k string, t long, v double"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(source)
    spark.createDataFrame([("a", 4, None), ("b", 2, 5.0)], kinds).coalesce(1).write.mode("append").parquet(source)
    out = streaming.carried(streaming.read_table(spark, str(tmp_path), "events", 1), "k", "t", "v")
    got = {(r.k, r.t): r.last for r in streaming.drained(out, "append").collect()}
    assert got == {("a", 1): 9.0, ("a", 2): 1.0, ("a", 3): 1.0, ("b", 1): None, ("a", 4): 1.0, ("b", 2): 5.0}


def test_onsets_of_a_stream_are_those_of_the_table(spark, tmp_path):
    from evenkeel.operators import timeline

    values = [9.0, 1.0, 1.0, 1.0, 8.0, 9.0, 1.0, 2.0, 9.0, 9.0]
    table = spark.createDataFrame([(k, i, v) for k in (1, 2) for i, v in enumerate(values[k:])], "k int, t long, v double")
    want = {(r.k, r.t): r.onset for r in timeline.onsets(table, "k", "t", "t", "v", 4, 1.8, 1.0).collect()}
    for half in ("t < 5", "t >= 5"):
        table.where(half).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    out = streaming.onsets(streaming.read_table(spark, str(tmp_path), "events", 1), "k", "t", "v", 4, 1.8, 1.0)
    assert {(r.k, r.t): r.onset for r in streaming.drained(out, "append").collect()} == want
