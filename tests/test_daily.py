import contextlib
import datetime as dt
import io
import re

import pytest

from driftscope.operators.daily import DailyTotals
from driftscope.operators.preagg import interval_bounds, plan_stats, plan_totals, time_window
from driftscope.params import CompareParams
from driftscope.session import work_dir
from driftscope.sources.runs import load_run, run_tables, union_runs

DAY, START = 24 * 60, dt.datetime(2025, 1, 1)
LINES = [(plan, plan % 3 + 1, plan % 2, minute, plan + minute % 7, 10 + plan)
         for plan in range(1, 7) for minute in (0, 5, 600, DAY, DAY + 90, 2 * DAY + 30, 4 * DAY, 4 * DAY + 1439)]


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture(scope="module")
def run(runs):
    return runs.both(LINES, LINES[3:])


@pytest.fixture(scope="module")
def store(spark, run):
    days = DailyTotals(spark, work_dir(spark, "days"))
    for day in range(5):
        days.add(run, (START + dt.timedelta(days=day)).date())
    return days


def at(minute):
    return START + dt.timedelta(minutes=minute)


@pytest.mark.parametrize("window", [
    (None, None), (at(0), at(2 * DAY)), (at(5), None), (None, at(DAY + 60)), (at(5), at(4 * DAY + 5)),
    (at(3), at(700)), (at(DAY - 10), at(DAY + 10)), (at(9 * DAY), None), (at(DAY + 1), at(2 * DAY))])
def test_any_window_is_merged_from_days(run, store, window):
    p = CompareParams(start=window[0], end=window[1])
    assert rows(store.plan_stats(run, p)) == rows(plan_stats(run, p))


def test_filters_and_repeats(spark, run, store):
    before = rows(store.rows(run))
    store.add(run, START.date(), (START + dt.timedelta(days=1)).date())
    assert rows(store.rows(run)) == before
    p = CompareParams(primary_replica_only=True, include_adhoc=False)
    assert rows(store.plan_stats(run, p)) == rows(plan_stats(run, p))


def test_intervals_too_large_to_send(run):
    p = CompareParams(start=at(5), end=at(4 * DAY))
    assert rows(plan_stats(run, p, interval_rows=0)) == rows(plan_stats(run, p))
    interval = time_window(run.interval, p)
    assert rows(plan_totals(run.runtime_stats, interval, "replica_group_id", interval_rows=0)) == rows(
        plan_totals(run.runtime_stats, interval, "replica_group_id"))


def plan_text(frame):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        frame.explain("formatted")
    return out.getvalue()


def test_only_files_of_the_window_are_read(spark, run, tmp_path):
    """Bounds of the interval ids reach the scan, and leave files of other days unread."""
    paths = {}
    for side in "LH":
        for name, frame in run_tables(run).items():
            own = frame.where(f"side = '{side}'").drop("side")
            paths[side, name] = f"{tmp_path}/{side}-{name}"
            if name == "runtime_stats":
                own = own.repartitionByRange(5, "runtime_stats_interval_id").sortWithinPartitions("runtime_stats_interval_id")
            own.write.parquet(paths[side, name])
    loaded = union_runs(*[load_run(spark, {n: p for (s, n), p in paths.items() if s == side}, side) for side in "LH"])
    p = CompareParams(start=at(2 * DAY), end=at(3 * DAY))
    found = plan_stats(loaded, p)
    pushed = re.findall(r"PushedFilters: \[(.*)\]", plan_text(found))
    assert sum("GreaterThanOrEqual(runtime_stats_interval_id" in x for x in pushed) >= 2
    assert rows(found) == rows(plan_stats(run, p))
    assert interval_bounds(time_window(loaded.interval, p)) and not interval_bounds(
        time_window(loaded.interval, CompareParams(start=at(90 * DAY))))
    # a day that is added scans the statistics of that day
    day = DailyTotals(spark, work_dir(spark, "one")).partials(loaded, START.date(), START.date())
    assert "LessThanOrEqual(runtime_stats_interval_id,600)" in plan_text(day)
    # rows that leave the scan, by Spark's own count
    day.collect()
    read = []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        if "avg_cpu_time" in node.toString() and node.getClass().getSimpleName() == "FileSourceScanExec":
            read.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(day._jdf.queryExecution().executedPlan())
    assert len(read) == 2 and 0 < sum(read) < len(LINES)
