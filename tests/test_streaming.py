import datetime as dt

from tidewords.streaming import runs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def _events(spark, hours, user=1):
    return spark.createDataFrame([(i, T0 + dt.timedelta(hours=h), user, 1.0) for i, h in enumerate(hours)], SCHEMA)


def test_sessions_in_batch(spark):
    got = [(r.start_ts.hour, r.n) for r in runs.sessions(_events(spark, [0, 6, 12.5, 23])).orderBy("start_ts").collect()]
    assert got == [(0, 2), (12, 1), (23, 1)]  # exactly the pause apart is together
    assert runs.sessions(_events(spark, []).limit(0)).count() == 0


def test_sessions_in_a_stream_equal_the_batch(spark, tmp_path):
    hours = [0, 1, 2, 20, 21, 60, 61, 200]
    _events(spark, hours).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = runs.sessions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), late="1 hour")
    q = stream.writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    got = {(r.start_ts, r.n) for r in spark.table("sess").collect()}
    want = {(r.start_ts, r.n) for r in runs.sessions(_events(spark, hours)).collect()}
    assert got == {x for x in want if x[0] < T0 + dt.timedelta(hours=200)}


LINES = "source_id string, start_s double, end_s double"


def test_speech_runs_in_batch_and_stream(spark, tmp_path):
    nan = float("nan")
    rows = [("a", 0.0, 5.0), ("a", 1.0, 2.0), ("a", 7.0, 8.0), ("a", 10.001, 11.0), ("a", None, 3.0), ("a", nan, 3.0), ("a", 9.0, 8.0), (None, 0.0, 1.0), ("b", 4.0, 4.0), ("b", 4.0, 4.0), ("c", 5_000.0, 5_001.0), ("c", 90_000.0, 90_001.0)]
    want = {("a", 0, 8_000), ("a", 10_001, 11_000), ("b", 4_000, 4_000), ("c", 5_000_000, 5_001_000), ("c", 90_000_000, 90_001_000)}
    df = spark.createDataFrame(rows, LINES)
    assert {tuple(r) for r in runs.speech_runs(df).collect()} == want
    assert runs.speech_runs(df.limit(0)).count() == 0
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = runs.speech_runs(spark.readStream.schema(LINES).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("speech").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("speech").collect()} == {x for x in want if x[1] < 80_000_000}  # the last is open still
    p = runs.progress(q)
    assert p["rows"] == len(rows) and p["done"] == 1.0 and p["batches"] >= 1


def _build(df):
    good = df.where("source_id <> 'bad'").select("source_id").distinct()
    clips = good.selectExpr("source_id", "concat(source_id, '_0001') as id", "concat('wavs/', source_id, '_0001.wav') as audio_path")
    return clips, good.selectExpr("concat(source_id, '_seg0002') as clip", "'duration' as filter")


def test_builds_are_resumed(spark, tmp_path):
    out, cfg = str(tmp_path / "out"), {"least_s": 1.0, "token": "secret"}
    src = lambda *names: spark.createDataFrame([(n,) for n in names], "source_id string")
    assert runs.state(spark, out, cfg).count() == 0
    first = {r.source_id: (r.ok, r.error, r.clips, r.dropped) for r in runs.build_resumed(src("a", "bad"), _build, out, cfg).collect()}
    assert first == {"a": (True, None, 1, 1), "bad": (False, "no clips", 0, 0)}
    again = runs.build_resumed(src("a", "bad", "c", "c"), _build, out, cfg | {"token": "other"})
    assert sorted(r.source_id for r in again.collect()) == ["bad", "c"]
    assert sorted(r.id for r in runs.built(spark, out, cfg).collect()) == ["a_0001", "c_0001"]
    files = spark.createDataFrame([("wavs/c_0001.wav",)], "path string")  # the audio of a is gone
    assert sorted(r.source_id for r in runs.build_resumed(src("a", "c"), _build, out, cfg, files=files).collect()) == ["a"]
    assert sorted(r.id for r in runs.built(spark, out, cfg).collect()) == ["a_0001", "c_0001"]
    assert sorted(r.source_id for r in runs.build_resumed(src("a"), _build, out, cfg | {"least_s": 2.0}).collect()) == ["a"]  # another config


def test_increments_can_be_repeated(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "source_id string").write.parquet(str(tmp_path / "in"))
    start = lambda cfg: runs.build_increments(spark.readStream.schema("source_id string").parquet(str(tmp_path / "in")), _build, str(tmp_path / "out"), str(tmp_path / "ck"), cfg)
    for cfg in ({"x": 1}, {"x": 1}, {"x": 2}):
        start(cfg).awaitTermination(60)
    for cfg in ({"x": 1}, {"x": 2}):
        assert sorted(r.source_id for r in runs.built(spark, str(tmp_path / "out"), cfg).collect()) == ["a", "b"]
