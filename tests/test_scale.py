"""Plans, queries and texts have no bound: they are merged, whatever the sizes of their files say."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from contract.inputs import SIDES, derived_run
from contract.queries import QUERIES, comparison, params
from driftscope.operators import preagg
from driftscope.operators.checks import collection_check
from driftscope.operators.daily import DailyTotals
from driftscope.operators.drilldown import multi_plan_detail
from driftscope.operators.preagg import plan_stats
from driftscope.operators.shape import pair_members, plan_indicators
from driftscope.plans.comparison import Comparison
from driftscope.plans.steps import Steps

SF = "/root/testdata/sf0.001"
UNBOUND = {"plan_id", "query_id", "query_text_id"}


def broadcast(rows) -> set[tuple[str, str]]:
    """Last key and type of the joins that send a side to all tasks."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"BroadcastHashJoin \[[^\]]*?(\w+)#\d+L?\], \[[^\]]*\], (\w+)", plan))


def test_group_statistics_merge_plans_queries_and_texts(spark):
    run = derived_run(spark, SF)
    found = broadcast(Comparison(run, params(group_by="NormalizedText"), SIDES, store=None).groups)
    assert ("runtime_stats_interval_id", "Inner") in found
    assert not UNBOUND & {key for key, _ in found}


@pytest.mark.parametrize("name", [
    "group_agg_hash", "group_agg_text", "group_agg_normalized", "group_agg_select_only", "group_agg_merged",
    "plan_preagg", "plan_preagg_window", "compare_cpu", "compare_hash", "compare_normalized", "compare_split",
    "regressed_groups", "multi_plan_only", "multi_plan_dominant", "dominant_pairs", "regression_summary",
    "regression_overview_text"])
def test_queries_send_no_unbound_table_to_every_task(spark, name):
    found = broadcast(QUERIES[name](spark, SF))
    assert ("runtime_stats_interval_id", "Inner") in found
    assert not UNBOUND & {key for key, _ in found}


def test_result_rows_send_no_unbound_table_to_every_task(spark):
    for metric in ("LogicalReads", "CPU"):
        found = broadcast(comparison(spark, SF, metric=metric).result_rows())
        assert ("runtime_stats_interval_id", "Inner") in found
        assert not UNBOUND & {key for key, _ in found}


def test_timed_steps_send_no_unbound_table_to_every_task(spark):
    steps = Steps(spark)
    c = comparison(spark, SF, None).timed(steps)
    found = broadcast(c.groups)
    steps.release()
    assert ("runtime_stats_interval_id", "Inner") in found
    assert not UNBOUND & {key for key, _ in found}


def test_collection_check_merges_plans_and_queries(spark):
    assert not UNBOUND & {key for key, _ in broadcast(collection_check(derived_run(spark, SF)))}


def test_digests_of_plans_are_merged(spark):
    c = comparison(spark, SF)
    found = broadcast(multi_plan_detail(c.multi_plan_rows, c.run.plan, c.params))
    assert not UNBOUND & {key for key, _ in found}


def test_plan_xml_is_merged_with_few_or_many_members(spark):
    c = comparison(spark, SF, min_exec=None, min_ratio=None)
    members = pair_members(c.multi_plan_pairs)
    few = plan_indicators(members, c.run.plan, c.params)
    many = plan_indicators(members, c.run.plan, c.params, member_rows=0)
    assert {kind for key, kind in broadcast(few) if key == "plan_id"} == {"LeftSemi"}
    assert not UNBOUND & {key for key, _ in broadcast(many)}
    assert few.count() > 0
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


def dealt_first(rows) -> bool:
    """Are statistics dealt by a hash before they are added up for the first time?"""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    first = plan.rindex("partial_sum")
    return "REBALANCE_PARTITIONS_BY_COL" in plan[first:]


def test_statistics_of_many_plans_are_dealt_before_they_are_added_up(spark):
    run = derived_run(spark, SF)
    few, many = plan_stats(run, params()), plan_stats(run, params(), plan_rows=0)
    assert not dealt_first(few) and dealt_first(many)
    assert dealt_first(plan_stats(run, params(), interval_rows=0))
    assert few.count() > 0
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


def test_queries_and_days_deal_statistics_of_many_plans(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(preagg.many_plans, "__defaults__", (0,))
    monkeypatch.setattr(preagg.plan_stats, "__defaults__", (preagg.INTERVAL_ROWS, 0))
    run = derived_run(spark, SF)
    assert dealt_first(QUERIES["compare_cpu"](spark, SF))
    assert dealt_first(QUERIES["plan_preagg_window"](spark, SF))
    day = run.interval.agg({"start_time": "min"}).first()[0].date()
    assert dealt_first(DailyTotals(spark, str(tmp_path)).partials(run, day, day))


def test_a_plan_with_many_rows_is_added_up_by_several_tasks(spark):
    """Its share is split by AQE, so it costs no more than others."""
    run = derived_run(spark, SF)
    hot = run.runtime_stats.withColumn("plan_id", F.expr("if(plan_id % 3 = 0, 0L, plan_id)"))
    changed = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k"}
    before = {key: spark.conf.get(key) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        totals = preagg.plan_totals(hot.repartition(16), run.interval, spread=True)
        found = totals.collect()
        plan = totals._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "skewed" in plan
    assert sorted(found) == sorted(preagg.plan_totals(hot, run.interval).collect())
