import datetime as dt

from ledgermill.operators.usage import token_budget
from ledgermill.streaming import jobs

START = dt.datetime(2024, 1, 1)


def calls(spark, rows):
    data = [(i, m, START + dt.timedelta(seconds=s), n) for i, (m, s, n) in enumerate(rows)]
    return spark.createDataFrame(data, "call_id long, model string, ts timestamp, tokens long")


def test_budget_segments_agree_with_one_window(spark):
    rows = [("a", s * 13 % 977 + (s % 3) / 3, 100 + s % 50) for s in range(400)] + [("b", 3600 - 30, 7000), ("b", 3600 + 30, 7000), ("b", 3600 + 90.5, 7000)]
    frame = calls(spark, rows)
    want = {}
    for i, (m, s, n) in enumerate(rows):
        near = [t for k, x, t in rows if k == m and -1e-9 <= s - x <= 60 + 1e-9]
        want[i] = (sum(near), sum(near) > 7200 and len(near) > 1)
    for segments in (1, 3, 17):
        got = {r["call_id"]: (r["used_tokens"], r["over_budget"]) for r in token_budget(frame, segments=segments).collect()}
        assert got == want


def test_rate_stream_equals_its_batch_twin(spark, tmp_path):
    frame = calls(spark, [("a", s * 7, 3000) for s in range(60)])
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    jobs.start_token_rate(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = jobs.token_rate(frame)
    got = jobs.latest_rates(spark.read.parquet(str(tmp_path / "out"))).select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() > 0


def test_late_calls_count_and_no_state_grows(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(30 * 86400), rng.randrange(1, 6000)) for _ in range(300)]
    frame, out, state = calls(spark, rows), str(tmp_path / "out"), str(tmp_path / "state")
    for n in range(6):  # files in no order of time
        frame.filter(f"call_id % 6 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def read(state):
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        started = jobs.start_token_rate(stream, out, state)
        started.awaitTermination()
        assert all(not p.stateOperators for p in started.recentProgress)
        return jobs.latest_rates(spark.read.parquet(out))

    batch = jobs.token_rate(frame)
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, read(state).select(*batch.columns).collect())) == want
    # the same checkpoint adds nothing, another one counts anew
    assert sorted(map(tuple, read(state).select(*batch.columns).collect())) == want
    assert sorted(map(tuple, read(state + "2").select(*batch.columns).collect())) == want


def test_ingest_twice(spark, tmp_path):
    schema = "doc_id long, text string, arrived_at timestamp"
    def arrive(name, rows):
        spark.createDataFrame([(i, t, START) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert arrive("one", [(1, "a"), (2, "a"), (3, "b")]) == ["a", "b"]
    assert arrive("two", [(4, "b"), (5, "c")]) == ["a", "b", "c"]


def test_ingest_in_any_order_and_from_new_checkpoints(spark, tmp_path):
    schema = "doc_id long, text string"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for ids in ([200000, 200001], [300000], [1, 2, 3], [4, 200000]):
        spark.createDataFrame([(i, f"text {i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(folder)

    def ingest(state):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.start_ingest(stream, out, str(tmp_path / state)).awaitTermination()
        return sorted(r["doc_id"] for r in spark.read.parquet(out).collect())

    every = [1, 2, 3, 4, 200000, 200001, 300000]
    assert ingest("first") == every
    spark.createDataFrame([(900000, "text 900000")], schema).coalesce(1).write.mode("append").parquet(folder)
    assert ingest("second") == [*every, 900000]
    assert ingest("first") == [*every, 900000]


def test_session_counts(spark, tmp_path):
    schema = "session_id string, id long"
    for n in (3, 2):
        spark.createDataFrame([("s", i) for i in range(n)] + [(f"t{n}", 9)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.start_session_counts(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["session_id"]: r["n_entries"] for r in jobs.latest_counts(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"s": 5, "t3": 1, "t2": 1}
