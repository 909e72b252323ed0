import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from driftscope.operators import capture
from driftscope.params import ParameterError

SCHEMA = ("event_id bigint, ts timestamp, database_id int, file_name string, file_created timestamp, event_name string, "
          "object_name string, statement string, batch_text string, duration decimal(18,2), succeeded int")
START = dt.datetime(2025, 1, 1)


def events(spark, rows):
    """rows: dicts with some of the columns."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    full = [{"event_id": i, "ts": START + dt.timedelta(seconds=i), "file_name": "a", "file_created": START,
             "database_id": 1, "succeeded": 1, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], SCHEMA)


def rpc(statement, name="p", **more):
    return {"event_name": "rpc_completed", "statement": statement, "object_name": name, **more}


def batch(text, **more):
    return {"event_name": "sql_batch_completed", "batch_text": text, **more}


@pytest.mark.parametrize("statement, name, kind", [
    ("exec dbo.p @a=1", "p", "SP"),
    ("exec sp_executesql N'x'", "SP_ExecuteSQL", "ADHOC"),
    ("declare @o int EXEC p", "p", "ADHOC"),
    ("exec p 'some exec'", "p", "ADHOC"),
    ("  exec p", "p", "SP"),
    (None, "p", "SP"),
])
def test_kind(spark, statement, name, kind):
    assert capture.classify(events(spark, [rpc(statement, name)])).first().kind == kind


def test_batches_are_adhoc(spark):
    row = capture.classify(events(spark, [batch("exec p")])).first()
    assert (row.kind, row.sql_text) == ("ADHOC", "exec p")


@pytest.mark.parametrize("statement, replay", [
    ("exec dbo.p @a=1,@b=x,@c=N'it',@d='q'", "exec dbo.p @a=1, @b=N'x', @c=N'it', @d='q'"),
    ("exec p;", "exec p "),
    ("exec p @a = -1 , @b = 1.5,@c=NULL", "exec p @a=N'-1', @b=N'1.5', @c=N'NULL'"),
    # commas and equals signs inside strings also cut
    ("exec p @a='x,y',@b='k=v'", "exec p @a='x"),
    ("exec p 1,2", "exec p "),
    ("exec", None),
    ("exec  p @a=1", "exec  exec  p @a=1"),
    ("exec p\t@a=1", "exec p\t@a=1 "),
])
def test_rewritten_calls(spark, statement, replay):
    got = capture.rewrite(capture.classify(events(spark, [rpc(statement)]))).first().replay_text
    assert got == replay


def test_batch_loses_semicolons(spark):
    assert capture.rewrite(capture.classify(events(spark, [batch("SELECT 1;;")]))).first().replay_text == "SELECT 1"


def test_resets(spark):
    frame = events(spark, [rpc("EXEC sp_reset_connection"), batch("exec SP_RESET_CONNECTION"), rpc("exec p"),
                           rpc("exec sp_reset_connection ;"), rpc(None), {"event_name": "attention"}])
    left = capture.replayable(frame)
    assert [r.event_id for r in left.orderBy("event_id").collect()] == [2, 3, 4]
    # the name rule works on the call, after counting
    assert sorted(r.event_id for r in capture.rewrite(capture.classify(left)).collect()) == [2, 4]
    # and then for everything that counts what is run again
    classified = capture.classify(left.withColumns({"file_created": F.col("ts"), "succeeded": F.lit(1), "duration": F.lit(1)}))
    assert sorted(r.event_id for r in capture.sequence(classified).collect()) == [2, 4]
    assert capture.sequence(classified).first().total_count == 2
    assert capture.outcomes(classified).first().successful_sp == 2
    assert sum(r.count_executions for r in capture.interval_rollup(classified, "kind").collect()) == 2
    counts = capture.counts_by_file(frame).first()
    assert (counts.rpc_count, counts.batch_count, counts.total_count, counts.seen_count) == (3, 0, 3, 5)


def test_replay_types(spark):
    frame = events(spark, [rpc("exec p"), batch("x"), {"event_name": "RPC_COMPLETED", "statement": "exec q"}])
    ids = {t: sorted(r.event_id for r in capture.replayable(frame, t).collect()) for t in (1, 2, 3)}
    assert ids == {1: [0, 2], 2: [1], 3: [0, 1, 2]}
    with pytest.raises(ParameterError):
        capture.replayable(frame, 4)


def test_restrict_capture(spark):
    frame = events(spark, [rpc("a", database_id=5), batch("b", database_id=5), batch("c", database_id=6)])
    ids = {t: sorted(r.event_id for r in capture.restrict_capture(frame, 5, t).collect()) for t in capture.COLLECT_TYPES}
    assert ids == {"sp": [0], "adhoc": [1], "sp-and-adhoc": [0, 1]}
    with pytest.raises(ParameterError):
        capture.restrict_capture(frame, 5, "both")


def test_parameters(spark):
    frame = capture.classify(events(spark, [rpc("exec p; @a=1,plain,@b = N'x' "), batch("exec q @c=1")]))
    rows = capture.call_parameters(frame, "event_id").orderBy("position").collect()
    # what follows the name starts right after it, semicolon included
    assert [tuple(r) for r in rows] == [(0, "p", 0, "; @a", "1"), (0, "p", 1, "@b", "N'x'")]


def test_files_without_events(spark):
    frame = events(spark, [rpc("exec p"), {"event_name": "attention", "file_name": "b"},
                           rpc("exec sp_reset_connection", file_name="c"), {"event_name": "attention", "file_name": "a"}])
    assert [r.file_name for r in capture.files_without_events(frame).collect()] == ["b"]
    capture.require_events(frame)
    with pytest.raises(capture.NoReplayableEvents):
        capture.require_events(frame.where("file_name = 'b'"))


@pytest.mark.parametrize("width", [2, 7, 1 << 20])
def test_sequence(spark, width):
    rng = random.Random(3)
    # one file holds most events, and files are not in name order
    files = {"a": 5, "b": 1, "c": 9}
    rows = [rpc("exec p", event_id=i, file_name=f, file_created=START + dt.timedelta(hours=files[f]))
            for i, f in zip(rng.sample(range(1000), 120), rng.choices("abc", [8, 1, 1], k=120))]
    want = sorted(rows, key=lambda r: (r["file_created"], r["event_id"]))
    got = capture.sequence(events(spark, rows), width=width).orderBy("exec_no").collect()
    assert [(r.event_id, r.exec_no, r.percent, r.total_count) for r in got] == [
        (r["event_id"], n + 1, (n + 1) * 100 // 120, 120) for n, r in enumerate(want)]


def test_outcomes(spark):
    frame = capture.classify(events(spark, [rpc("exec p"), rpc("exec p", succeeded=0), batch("x", succeeded=0),
                                            batch("y", file_name="b")]))
    assert tuple(capture.outcomes(frame).first()) == (1, 1, 1, 1)
    assert {tuple(r) for r in capture.outcomes(frame, "file_name").collect()} == {("a", 1, 1, 0, 1), ("b", 0, 0, 1, 0)}


@pytest.mark.parametrize("seconds, words", [
    (0, ""), (1, "1 second"), (59, "59 seconds"), (60, "1 minute"), (3600, "1 hour"),
    (3661, "1 hour, 1 minute, 1 second"), (7325, "2 hours, 2 minutes, 5 seconds"), (90000, "25 hours"),
])
def test_duration_words(spark, seconds, words):
    frame = events(spark, [rpc("x", ts=START), rpc("y", ts=START + dt.timedelta(seconds=seconds, milliseconds=900))])
    row = capture.run_duration(frame).first()
    assert (row.seconds, row.duration_text) == (seconds, words)


def test_interval_rollup(spark):
    frame = events(spark, [rpc("x", ts=START + dt.timedelta(seconds=s), duration=Decimal(d)) for s, d in ((0, 1), (59, 2), (60, 4))])
    rows = capture.interval_rollup(frame, "object_name").orderBy("start_time").collect()
    assert [(r.count_executions, float(r.avg_duration), r.start_time) for r in rows] == [
        (2, 1.5, START), (1, 4.0, START + dt.timedelta(minutes=1))]


def test_rewriting_against_plain_python(spark):
    """Random calls against a second, row-by-row reading of the rules."""
    rng = random.Random(11)
    pieces = ["@a", "=", ",", " ", "1", "N'q'", "'", "x", "-2", ";", "  "]
    calls = ["exec p " + "".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(150)]

    def expected(call):
        name = call.split(" ")[1].rstrip(";")
        rest = call[call.index(name) + len(name):].strip()
        kept = []
        for part in rest.split(","):
            halves = [h.strip() for h in part.split("=")]
            if len(halves) == 2:
                plain = re.match(r"(?i)N?'", halves[1]) or re.fullmatch(r"\d+", halves[1])
                kept.append(f"{halves[0]}={halves[1]}" if plain else f"{halves[0]}=N'{halves[1]}'")
        return f"exec {name} " + ", ".join(kept)

    frame = capture.classify(events(spark, [rpc(c) for c in calls])).where(F.col("kind") == "SP")
    got = capture.rewrite(frame).orderBy("event_id").select("sql_text", "replay_text").collect()
    assert len(got) == 150 and all(r.replay_text == expected(r.sql_text) for r in got)
