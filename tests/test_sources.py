import dataclasses
import datetime as dt
import json

import pytest

from driftscope import Comparison, CompareParams, Sides, load_run, resolve_sides, union_runs
from driftscope.operators.checks import row_counts
from driftscope.plans.persist import save_files, save_table
from driftscope.plans.steps import Steps
from driftscope.session import work_dir
from driftscope.sources.capture import load_events
from driftscope.sources.runs import TABLES, as_run, reader_options, run_tables
from driftscope.sources.sides import UNKNOWN, order_pairs
from tests.test_compare import HIGH, LOW, SIDES


def test_resolve_sides(spark):
    databases = spark.createDataFrame([("old", 120), ("new", 170), ("same", 120)], "name string, compatibility_level int")
    assert resolve_sides(databases, "new", "old") == Sides("old", "new", 120, 170)
    assert resolve_sides(databases, "old", "new") == Sides("old", "new", 120, 170)
    # on a tie A stays the baseline
    assert resolve_sides(databases, "same", "old").low_db == "same"
    assert resolve_sides(databases, "old", "same").low_db == "old"
    assert resolve_sides(databases, "old", "new").high_label == "CL170"
    with pytest.raises(ValueError, match="nowhere"):
        resolve_sides(databases, "old", "nowhere")
    pairs = spark.createDataFrame([("old", "x"), ("new", "old")], "db_a string, db_b string")
    assert {(r.db_a, r.low_db, r.status) for r in order_pairs(databases, pairs).collect()} == {
        ("old", None, UNKNOWN), ("new", "old", "OK")}


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "table"])
def test_load_run(spark, runs, tmp_path, format):
    paths = {}
    for side, lines in (("L", LOW), ("H", HIGH)):
        for name, frame in run_tables(runs.side(side, lines)).items():
            frame = frame.drop("side")
            if format == "table":
                paths[side, name] = f"{side}_{name}"
                frame.createOrReplaceTempView(paths[side, name])
            elif format == "json":
                # JSON has no binary, so the hash travels as a number
                paths[side, name] = f"{tmp_path}/{side}/{name}"
                if name == "query":
                    frame = frame.selectExpr("* EXCEPT (query_hash)", "query_id * 7 AS query_hash")
                frame.write.json(paths[side, name])
            else:
                paths[side, name] = f"{tmp_path}/{side}/{name}"
                frame.write.format(format).save(paths[side, name])
    loaded = union_runs(*(load_run(spark, {t: paths[s, t] for t in TABLES}, s, format=format) for s in "LH"))
    rows = Comparison(loaded, CompareParams(min_exec=10), SIDES).regressions.collect()
    assert sorted((r.query_id_range_h, str(r.regression_ratio)) for r in rows) == [("1-1", "1.875000"), ("2-2", "2.000000")]


def test_run_needs_all_tables_and_a_side(runs):
    tables = run_tables(runs.side("L", LOW))
    with pytest.raises(ValueError, match="side"):
        as_run(tables, "A")
    del tables["plan"]
    with pytest.raises(ValueError, match="plan"):
        as_run(tables, "L")


def test_load_events_keeps_file_and_time(spark, tmp_path):
    for name, ids in (("b.json", [1, 2]), ("a.json", [3])):
        lines = [json.dumps({"event_id": i, "ts": "2025-01-01T00:00:00", "event_name": "rpc_completed", "statement": "exec p"})
                 for i in ids]
        (tmp_path / name).write_text("\n".join(lines))
    events = load_events(spark, str(tmp_path), "json")
    assert sorted((r.event_id, r.file_name) for r in events.collect()) == [(1, "b.json"), (2, "b.json"), (3, "a.json")]
    assert events.first().file_created > dt.datetime(2020, 1, 1)


def test_save_files_replaces_or_appends(spark, runs, tmp_path):
    rows = Comparison(runs.both(LOW, HIGH), CompareParams(min_exec=10, top_n=1), SIDES).result_rows()
    path = f"{tmp_path}/kept"
    for _ in range(2):
        save_files(rows, path)
    kept = spark.read.parquet(path)
    # all regressions are kept, whatever a report shows
    assert kept.count() == 2 and len(kept.columns) == 26
    assert kept.schema["RegressionRatio"].dataType.simpleString() == "decimal(19,6)"
    history = f"{tmp_path}/history"
    ids = {save_files(rows, history, history=True) for _ in range(2)}
    assert {r.RunId for r in spark.read.parquet(history).collect()} == ids and len(ids) == 2


def test_save_table(spark, runs):
    rows = Comparison(runs.both(LOW, HIGH), CompareParams(min_exec=10), SIDES).result_rows()
    path = work_dir(spark, "warehouse")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS analysis LOCATION '{path}'")
    save_table(rows, "analysis.regressions")
    save_table(rows, "analysis.regressions")
    assert spark.table("analysis.regressions").count() == 2
    with pytest.raises(ValueError):
        save_table(rows, "regressions")
    spark.sql("DROP DATABASE analysis CASCADE")


def test_steps(spark, runs):
    steps = Steps(spark)
    with Comparison(runs.both(LOW, HIGH), CompareParams(min_exec=10), SIDES, store=None) as c:
        overview = c.timed(steps).overview().count()
    rows = {r.step_name: r for r in steps.metrics().collect()}
    assert overview == 2 and len(rows) == 9
    assert rows["plan statistics"].rows_affected == 11 and rows["regressed groups"].rows_affected == 2
    assert rows["resolve sides"].rows_affected is None and all(r.ms >= 0 for r in rows.values())
    steps.release()


def test_row_counts(spark):
    counted = row_counts({"b": spark.range(3), "a": spark.range(0)}).collect()
    assert [tuple(r) for r in counted] == [("a", 0, 1), ("b", 3, 0)]


def test_work_dir_is_below_the_shared_folder(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before:
        assert work_dir(spark, "x").startswith(before)
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_options_of_single_tables():
    split = {"partitionColumn": "plan_id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8"}
    own = {"runtime_stats": split}
    got = reader_options("runtime_stats", "dbo.stats", "jdbc", {"url": "jdbc:x"}, own)
    assert got == {"url": "jdbc:x", "dbtable": "dbo.stats", **split}
    assert reader_options("plan", "dbo.plan", "jdbc", {"url": "jdbc:x"}, own) == {"url": "jdbc:x", "dbtable": "dbo.plan"}
    with pytest.raises(ValueError, match="partitionColumn"):
        reader_options("runtime_stats", "dbo.stats", "jdbc", {"url": "jdbc:x"}, {})


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, master, folder=None):
            self.values = {"spark.master": master, "spark.checkpoint.dir": folder}

        def get(self, key, default=None):
            return self.values.get(key) or default

    class Session:
        def __init__(self, *args):
            self.conf = Conf(*args)

    assert work_dir(Session("local[4]"), "x").rpartition("/")[2].startswith("x-")
    assert work_dir(Session("spark://host", "hdfs://shared"), "x").startswith("hdfs://shared/x-")
    for master in ("spark://host", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            work_dir(Session(master), "x")


def test_side_without_statistics_is_checked_too(runs):
    from driftscope.operators.checks import collection_check
    run = union_runs(runs.side("L", [(1, 1, 1, 0, 20, 1)]), runs.side("H", [(1, 1, 1, 0, 20, 1)]))
    only_low = dataclasses.replace(run, runtime_stats=run.runtime_stats.where("side = 'L'"))
    rows = {r.side: tuple(r)[1:] for r in collection_check(only_low).collect()}
    assert rows == {"L": (20, None, 1, 0), "H": (None, None, 0, 0)}


def test_history_of_repeated_runs(spark, runs, tmp_path):
    rows = Comparison(runs.both(LOW, HIGH), CompareParams(min_exec=10), SIDES).result_rows()
    path = work_dir(spark, "warehouse")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept LOCATION '{path}'")
    for name in "aba":
        save_table(rows, "kept.history", history=True, run={"inputs": name, "min_exec": 10})
        save_files(rows, f"{tmp_path}/history", history=True, run={"inputs": name, "min_exec": 10})
    for kept in (spark.table("kept.history"), spark.read.parquet(f"{tmp_path}/history")):
        assert sorted(r["count"] for r in kept.groupBy("RunId").count().collect()) == [2, 2]
    save_table(rows, "kept.replaced")
    with pytest.raises(ValueError, match="no history"):
        save_table(rows, "kept.replaced", history=True, run={"inputs": "a"})
