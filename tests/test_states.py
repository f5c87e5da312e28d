import datetime

from conftest import rows
from pagemill.streaming import states

T = datetime.datetime(2025, 1, 1)


def at(n):
    return T + datetime.timedelta(minutes=n)


def test_transitions(spark):
    events = [("j", at(0), "queued"), ("j", at(1), "resolving"), ("j", at(2), "ready"), ("k", at(0), "ready"), ("k", at(1), "queued"), ("k", at(2), None)]
    df = spark.createDataFrame(events, "job_id string, ts timestamp, state string")
    got = [(r.job_id, r.state, r.before, r.legal) for r in states.transitions(df).orderBy("job_id", "ts").collect()]
    assert got == [("j", "queued", None, True), ("j", "resolving", "queued", True), ("j", "ready", "resolving", False), ("k", "ready", None, True), ("k", "queued", "ready", False)]
    assert states.edge_table(spark).count() == sum(map(len, states.TRANSITIONS.values()))


def test_follow(spark):
    events = [(1, at(0), 1, "view", 1.0), (1, at(1), 2, "click", 2.0), (1, at(2), 3, "view", 3.0), (1, at(3), 4, "login", 0.0), (1, at(4), 5, "view", 4.0), (2, at(0), 6, "logout", 0.0), (None, at(0), 7, "view", 1.0)]
    df = spark.createDataFrame(events, "user_id long, ts timestamp, event_id long, event_type string, value double")
    assert rows(states.follow_state(df)) == [(1, 5, "4.00", True, 3), (2, 1, None, True, 0)]
    assert rows(states.hourly_limit(df, 2))[0][2:] == (5, 3)


def test_streams_give_the_batch_result(spark, tmp_path):
    events = [("j", at(0), "queued"), ("j", at(1), "resolving"), ("j", at(2), "ready"), ("k", at(0), "failed"), ("k", at(1), "queued")]
    schema = "job_id string, ts timestamp, state string"
    source = tmp_path / "in"
    spark.createDataFrame(events[:2], schema).coalesce(1).write.parquet(str(source))
    out = states.stream_transitions(spark.readStream.schema(schema).parquet(str(source)))
    q = out.writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        spark.createDataFrame(events[2:], schema).coalesce(1).write.mode("append").parquet(str(source))
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("steps").collect()), key=repr)
    finally:
        q.stop()
    assert got == sorted([("j", "queued", None, True), ("j", "resolving", "queued", True), ("j", "ready", "resolving", False), ("k", "failed", None, True), ("k", "queued", "failed", False)], key=repr)


def test_states_of_jobs_that_never_end_are_given_up(spark, tmp_path):
    schema = "job_id string, ts timestamp, state string"
    source = tmp_path / "in"
    add = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(source))
    add(("j", at(0), "queued"), (None, at(0), "queued"))
    q = states.stream_transitions(spark.readStream.schema(schema).parquet(str(source)), keep_days=1).writeStream.format("memory").queryName("given_up").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for rows_ in ([("k", at(60 * 72), "queued")], [("k", at(60 * 73), "resolving")], [("j", at(60 * 74), "resolving")]):
            q.processAllAvailable()
            add(*rows_)
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("given_up").collect()), key=repr)
    finally:
        q.stop()
    # the first state of j was given up after a day, so its next event is a first one
    assert got == sorted([("j", "queued", None, True), ("k", "queued", None, True), ("k", "resolving", "queued", True), ("j", "resolving", None, True)], key=repr)


def test_window_counts(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    source = tmp_path / "in"
    spark.createDataFrame([(at(0), "view", 1.0), (at(5), "view", 2.0), (at(70), "click", 1.0)], schema).coalesce(1).write.parquet(str(source))
    q = states.stream_counts(spark.readStream.schema(schema).parquet(str(source))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(r.start, r.event_type): (r.events, r.value) for r in spark.table("counts").collect()}
    finally:
        q.stop()
    assert got == {(T, "view"): (2, 3.0), (at(60), "click"): (1, 1.0)}
