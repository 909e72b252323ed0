import datetime as dt
from decimal import Decimal

import pytest

from driftscope.folders import numbered
from driftscope.operators import capture
from driftscope.sources.capture import EVENT_SCHEMA, load_events, stream_events
from driftscope.streaming.capture import changes_to_files, classified_stream, newest, rollup_stream, running_counts, to_files

START = dt.datetime(2025, 1, 1)


def event(i, second, statement="exec p @a=1", name="rpc_completed"):
    text = (statement, None) if name == "rpc_completed" else (None, statement)
    return (i, START + dt.timedelta(seconds=second), 1, 1, name, "p", *text, Decimal(i), 1)


FILES = [
    [event(1, 0), event(2, 30, "SELECT 1;", "sql_batch_completed"), event(3, 70), event(4, 71, "exec sp_reset_connection")],
    [event(5, 200), event(6, 201, "declare @x int exec p")],
    [event(7, 210)],
    [event(8, 10), event(9, 400)],   # event 8 is late: earlier batches moved the watermark past its minute
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("capture"))
    for number, rows in enumerate(FILES):
        frame = spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(path)
    return path


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_classified_stream_equals_batch(spark, folder, tmp_path):
    stream = classified_stream(stream_events(spark, folder, maxFilesPerTrigger="1"))
    finish(to_files(stream.select("event_id", "kind", "replay_text"), f"{tmp_path}/out", f"{tmp_path}/check"))
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    batch = capture.rewrite(capture.classify(capture.replayable(load_events(spark, folder))))
    assert sorted(got) == sorted(batch.select("event_id", "kind", "replay_text").collect())
    assert len(got) == 8


def test_running_counts_equal_batch(spark, folder, tmp_path):
    counts = running_counts(stream_events(spark, folder, maxFilesPerTrigger="1"))
    finish(changes_to_files(counts, f"{tmp_path}/out", f"{tmp_path}/check"))
    got = newest(spark, f"{tmp_path}/out", "file_name", "kind").collect()
    batch = capture.classify(capture.replayable(load_events(spark, folder))).groupBy("file_name", "kind").count()
    assert sorted(got) == sorted(batch.collect())


def test_rollup_equals_batch_with_late_events(spark, folder, tmp_path):
    stream = rollup_stream(classified_stream(stream_events(spark, folder, maxFilesPerTrigger="1")), "object_name")
    finish(changes_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/check"))
    rows = newest(spark, f"{tmp_path}/out", "object_name", "start_time", "end_time").collect()
    batch = capture.interval_rollup(capture.replayable(load_events(spark, folder)), "object_name")
    assert sorted(rows) == sorted(batch.select("object_name", "start_time", "end_time", "count_executions",
                                               "avg_duration").collect())
    assert sum(r.count_executions for r in rows) == 8


def test_rollup_with_a_bound_drops_late_events(spark, folder, tmp_path):
    events = classified_stream(stream_events(spark, folder, maxFilesPerTrigger="1"))
    finish(to_files(rollup_stream(events, "object_name", delay="60 seconds"), f"{tmp_path}/out", f"{tmp_path}/check"))
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("start_time").collect()
    # the last interval is open until the watermark passes it
    assert [(r.start_time.minute, r.count_executions) for r in rows] == [(0, 2), (1, 1), (3, 3)]


def test_snapshots_bound_what_is_read(spark, tmp_path):
    path, out, batches, every = f"{tmp_path}/many", f"{tmp_path}/out", 22, 5
    for number in range(batches):
        rows = [event(100 * number + i, 60 * number + i) for i in range(1 + number % 3)]
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    counts = running_counts(stream_events(spark, path, maxFilesPerTrigger="1"), "object_name", "kind")
    finish(changes_to_files(counts, out, f"{tmp_path}/check", key=("object_name", "kind"), every=every))
    assert len(numbered(spark, out, "batch")) >= batches
    assert numbered(spark, f"{out}-snapshots", "batch", finished=True) == [4, 9, 14, 19]
    state = newest(spark, out, "object_name", "kind")
    folders = {name.rsplit("/", 2)[1] for name in state.inputFiles()}
    assert folders == {f"batch={n}" for n in numbered(spark, out, "batch") if n >= 19}
    batch = running_counts(load_events(spark, path), "object_name", "kind")
    assert sorted(state.collect()) == sorted(batch.collect())


def test_unfinished_snapshot_is_not_read(spark, tmp_path):
    out = f"{tmp_path}/out"
    for number, value in enumerate([1, 2, 3]):
        spark.createDataFrame([("a", value), (None, value)], "k string, v int").write.parquet(f"{out}/batch={number}")
    spark.createDataFrame([("a", 9, 1)], "k string, v int, batch bigint").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}-snapshots/batch=2")
    assert {tuple(r) for r in newest(spark, out, "k").collect()} == {("a", 3), (None, 3)}
