import datetime as dt
import hashlib
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from driftscope import Comparison, CompareParams, Sides
from driftscope.operators.checks import collection_check
from driftscope.operators.compare import full_outer, with_flag_list
from driftscope.operators.dominant import dominant_pairs, dominant_plans
from tests.conftest import MINUTE

SIDES = Sides("A", "B", 120, 170)
NOTE = "WEIGHTED_TOTAL;PLAN_FIRST_PREAGG;"


def compare(run, **params):
    return Comparison(run, CompareParams(**{"min_exec": 10, **params}), SIDES)


def by_query(rows):
    return {r.query_id_range_h or r.query_id_range_l: r for r in rows}


# plan, query, object, minute, executions, reads
LOW = [
    (11, 1, 1, 0, 10, 10), (11, 1, 1, 1, 30, 20), (12, 1, 1, 0, 5, 100),   # query 1: two plans
    (21, 2, 0, 0, 50, 4),                                                  # query 2: ad hoc, twice as dear in H
    (31, 3, None, 0, 50, 0),                                               # query 3: nothing read in L
    (41, 4, 2, 0, 50, 5),                                                  # query 4: only in L
    (61, 6, 2, 0, 3, 1),                                                   # query 6: few executions
]
HIGH = [
    (11, 1, 1, 0, 40, 50),
    (21, 2, 0, 0, 50, 8),
    (31, 3, None, 0, 50, 9),
    (51, 5, 2, 0, 50, 5),                                                  # query 5: only in H
    (61, 6, 2, 0, 30, 9),
]


@pytest.fixture(scope="module")
def compared(runs):
    return by_query(compare(runs.both(LOW, HIGH)).compared.collect())


def test_weighted_totals_and_averages(compared):
    row = compared["1-1"]
    # 10*10 + 30*20 + 5*100 over 45 executions
    assert (row.exec_count_l, row.total_metric_l, row.avg_metric_l) == (45, D(1200), D("26.666667"))
    assert (row.exec_count_h, row.avg_metric_h) == (40, D(50))
    assert row.regression_ratio == D("1.875000")
    assert row.delta_avg_metric == D("23.333333")
    assert row.impact_score == D("23.333333") * 40
    assert (row.plan_count_l, row.plan_count_h, row.obj_name, row.query_type) == (2, 1, "dbo.p_one", "SP")
    assert row.confidence_flags == "MULTI_PLAN;" + NOTE * 2


def test_missing_sides_stay_visible(compared):
    low, high = compared["4-4"], compared["5-5"]
    assert low.confidence_flags == "MISSING_ONE_SIDE;LOW_EXEC;" + NOTE
    assert high.confidence_flags == "MISSING_ONE_SIDE;LOW_EXEC;" + NOTE
    assert low.regression_ratio is None and high.regression_ratio is None
    # L is there, so its loss has an impact of nothing; without L there is none
    assert low.impact_score == 0 and high.impact_score is None
    assert low.query_hash_h is None and high.query_id_range_l is None


def test_zero_baseline_has_no_ratio(compared):
    row = compared["3-3"]
    assert row.regression_ratio is None and row.impact_score is None
    assert row.delta_avg_metric == 9 and row.query_type == "Adhoc" and row.obj_name is None


def test_low_executions(compared):
    assert compared["6-6"].confidence_flags == "LOW_EXEC;" + NOTE * 2


def test_regression_filter(runs):
    run = runs.both(LOW, HIGH)

    def found(**params):
        return sorted(r.query_id_range_h for r in compare(run, **params).regressions.collect())

    assert found() == ["1-1", "2-2"]
    assert found(min_exec=None) == ["1-1", "2-2", "6-6"]
    assert found(min_ratio=2) == ["2-2"]
    assert found(min_ratio="2.0001") == []
    assert found(only_multi_plan=True) == ["1-1"]
    assert found(include_sp=False) == ["2-2"]
    assert found(include_adhoc=False) == ["1-1"]
    assert found(metric="CPU") == []


def test_same_run_twice_has_no_regressions(runs):
    assert compare(runs.both(LOW, LOW), min_exec=None, min_ratio=None).regressions.count() == 0


def test_window_is_half_open(runs):
    run = runs.both(LOW, HIGH)
    first = compare(run, start=MINUTE, end=MINUTE + dt.timedelta(minutes=1)).plan_stats
    assert {(r.side, r.plan_id): r.sum_exec for r in first.collect()}["L", 11] == 10
    second = compare(run, start=MINUTE + dt.timedelta(minutes=1)).plan_stats.collect()
    assert [(r.side, r.plan_id, r.sum_exec) for r in second] == [("L", 11, 30)]
    assert second[0].interval_end_max == MINUTE + dt.timedelta(minutes=2)


def test_splitting_intervals_changes_nothing(runs):
    split = [(p, q, o, m + 10 * half, n // 2 + (n % 2) * half, reads)
             for p, q, o, m, n, reads in LOW for half in (0, 1)]
    columns = ["plan_id", "sum_exec", "total_reads", "avg_reads", "total_dur", "avg_cpu"]
    whole, parts = (
        sorted(map(tuple, compare(runs.both(lines, HIGH)).plan_stats.where("side = 'L'").select(*columns).collect()))
        for lines in (LOW, split))
    assert whole == parts


@pytest.mark.parametrize("average", ["decimal(18,2)", "double", "decimal(38,12)"])
def test_average_types_agree(runs, average):
    rows = compare(runs.both(LOW, HIGH, average=average)).plan_stats.where("side = 'L' AND plan_id = 11").collect()
    assert [(r.total_reads, r.avg_reads) for r in rows] == [(D(700), D("17.5"))]


def test_no_executions_give_zero_average(runs):
    row = compare(runs.both([(1, 1, 1, 0, 0, 7)], HIGH)).plan_stats.where("side = 'L'").first()
    assert (row.total_reads, row.avg_reads) == (0, 0)


def test_end_fallback_is_flagged_per_side(runs):
    from driftscope.sources.runs import union_runs
    run = union_runs(runs.side("L", LOW, end_time=False), runs.side("H", HIGH))
    c = compare(run)
    assert by_query(c.compared.collect())["2-2"].confidence_flags == (
        "WEIGHTED_TOTAL;PLAN_FIRST_PREAGG;INTERVAL_END_FALLBACK;" + NOTE)
    ends = {r.side: r.interval_end_max for r in c.plan_stats.where("plan_id = 21").collect()}
    assert ends == {"L": MINUTE, "H": MINUTE + dt.timedelta(minutes=1)}


def test_object_without_row_has_no_name(runs):
    run = runs.both([(1, 1, 9, 0, 20, 1)], [(1, 1, 9, 0, 20, 5)])
    rows = compare(run).regressions.collect()
    assert [(r.query_type, r.obj_name) for r in rows] == [("SP", None)]


def test_missing_hash_never_matches(runs):
    run = runs.both([(1, 1, 0, 0, 20, 1)], [(1, 1, 0, 0, 20, 5)], hashes={1: None})
    rows = compare(run).compared.collect()
    assert len(rows) == 2 and all(r.group_key is None and "MISSING_ONE_SIDE" in r.confidence_flags for r in rows)


def test_one_text_with_several_hashes(runs):
    low = [(1, 1, 0, 0, 20, 1), (2, 2, 0, 0, 20, 3)]
    high = [(1, 1, 0, 0, 20, 5), (2, 2, 0, 0, 20, 7)]
    texts = {1: "SELECT\tx", 2: "select x"}
    run = runs.both(low, high, texts=texts)
    assert compare(run, group_by="QueryText").compared.count() == 2
    # kept apart, a baseline hash meets the same candidate hash only
    split = compare(run, group_by="NormalizedText", split_by_hash=True).compared.collect()
    assert sorted((r.avg_metric_l, r.avg_metric_h) for r in split) == [(1, 5), (3, 7)]
    merged = compare(run, group_by="NormalizedText").compared.collect()
    assert [(r.exec_count_l, r.avg_metric_l, r.avg_metric_h, r.query_id_range_l) for r in merged] == [(40, 2, 6, "1-2")]
    assert bytes(merged[0].group_key) == hashlib.sha256("select x".encode("utf-16-le")).digest()


def test_long_texts_differ_beyond_the_sample(runs):
    run = runs.both([(1, 1, 0, 0, 20, 1), (2, 2, 0, 0, 20, 1)], [(1, 1, 0, 0, 20, 5), (2, 2, 0, 0, 20, 5)],
                    texts={1: "S" * 4500 + "1", 2: "S" * 4500 + "2"}, hashes={1: b"h", 2: b"h"})
    assert compare(run, group_by="QueryText").compared.count() == 2
    assert {len(r.query_text_sample) for r in compare(run, group_by="QueryText").compared.collect()} == {4501}
    cut = compare(run, group_by="QueryText", key_chars=4000, sample_chars=4000).compared.collect()
    assert len(cut) == 1 and len(cut[0].query_text_sample) == 4000


def test_many_hashes_of_one_text_are_one_row(runs):
    many = range(1, 1001)
    run = runs.both([(i, i, 0, 0, 20, 1) for i in many], [(i, i, 0, 0, 20, 5) for i in many],
                    texts={i: "SELECT 1" for i in many})
    rows = compare(run, group_by="QueryText").compared.collect()
    assert [(r.exec_count_l, r.exec_count_h, r.plan_count_l) for r in rows] == [(20000, 20000, 1000)]


def test_overview_keeps_all_regressions(runs):
    many = range(1, 131)
    run = runs.both([(i, i, 0, 0, 200, 1) for i in many], [(i, i, 0, 0, 200, 5) for i in many])
    assert compare(run).overview().count() == 130


def test_statistics_beyond_the_broadcast_bound(runs):
    from driftscope.operators.preagg import plan_stats
    run, p = runs.both(LOW, HIGH), CompareParams(min_exec=10)
    both = [sorted(plan_stats(run, p, bound).collect()) for bound in (1 << 30, -1)]
    assert both[0] == both[1] and len(both[0]) > 2


def test_statement_type_filter(runs):
    run = runs.both(LOW, HIGH, texts={1: "UPDATE t", 2: "(@p int)SELECT 1"})
    assert [r.query_id_range_h for r in compare(run, statement_type="update").regressions.collect()] == ["1-1"]


def test_dominant_plan_breaks_ties_by_average_then_plan(runs):
    low = [(1, 1, 1, 0, 20, 5), (2, 1, 1, 0, 20, 6), (3, 1, 1, 0, 20, 6), (4, 1, 1, 0, 9, 99)]
    c = compare(runs.both(low, [(7, 1, 1, 0, 40, 50)]))
    pair = c.pairs.first()
    assert (pair.plan_id_l, pair.plan_id_h, pair.query_id_l, pair.exec_count_l) == (3, 7, 1, 20)
    # from plans as from groups, long as paired
    assert dominant_pairs(c.plans).first() == pair
    assert {(r.side, r.plan_id) for r in dominant_plans(c.plans, c.regressed_groups).collect()} == {("L", 3), ("H", 7)}


def test_overview_order_and_limit(runs):
    low = [(q, q, 0, 0, 20, 1) for q in range(1, 6)]
    high = [(q, q, 0, 0, 20, 2 if q < 5 else 9) for q in range(1, 6)]
    run = runs.both(low, high)
    every = [r["QueryIdRange_L-H"] for r in compare(run, top_n=None).overview().collect()]
    assert every[0] == "5-5 - 5-5" and len(every) == 5
    # ties have one order, so a limit always cuts the same
    assert [r["QueryIdRange_L-H"] for r in compare(run, top_n=3).overview().collect()] == every[:3]
    row = compare(run, top_n=1).overview().first()
    assert (row["AvgMetric_L-H"], row["ExecCount_L-H"], str(row.ImpactScore)) == ("1.00 - 9.00", "20 - 20", "160.00")
    assert row["QueryHashHex_L-H"] == "0x6861736830303035 - 0x6861736830303035"


def test_summary_adds_up(runs):
    c = compare(runs.both(LOW, HIGH))
    row = c.summary().first()
    detail = c.regressions.agg(F.sum("impact_score"), F.max("impact_score")).first()
    assert (row.RegressionCount, row.MultiPlanCount, row.LowerDb, row.HigherCL) == (2, 1, "A", "170")
    assert (row.SumImpactScore, row.MaxImpactScore) == tuple(round(v, 2) for v in detail)
    assert row["TotalExecCount_L-H_SP"] == "45 - 40" and row["TotalExecCount_L-H_All"] == "95 - 90"
    assert str(row.AvgRegressionRatio) == "1.94"


def test_summary_of_nothing(runs):
    row = compare(runs.both(LOW, LOW)).summary().first()
    assert (row.RegressionCount, row.SumImpactScore, row["TotalExecCount_L-H_All"]) == (0, None, " - ")


def test_reports_of_nothing_are_empty(runs):
    c = compare(runs.both(LOW, LOW))
    assert c.overview().count() == c.drilldown().count() == c.shape_report().count() == 0


def test_flag_list(compared, runs):
    c = compare(runs.both(LOW, HIGH))
    row = with_flag_list(c.compared).where("query_id_range_h = '6-6'").first()
    assert row.confidence_flag_list[0] == "LOW_EXEC"


def test_full_outer_is_a_full_outer_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "w")], "k int, r string")
    order = lambda frame: sorted(map(str, frame.select("k", "l", "r").collect()))
    assert order(full_outer(left, right, ["k"])) == order(left.join(right, "k", "full_outer"))


def test_collection_check(runs):
    low = [(1, 1, 1, 0, 10, 1), (2, 2, 1, 0, 30, 1), (3, 3, 2, 0, 7, 1), (4, 4, 0, 0, 5, 1), (5, 5, None, 0, 6, 1),
           (6, 6, 1, 0, 99, 1)]
    run = runs.both(low, [(4, 4, 0, 0, 5, 1)], internal={6})
    rows = {r.side: tuple(r)[1:] for r in collection_check(run).collect()}
    assert rows == {"L": (37, 11, 2, 2), "H": (None, 5, 0, 1)}


def test_stored_frames_are_released(runs):
    with compare(runs.both(LOW, HIGH)) as c:
        c.overview().collect()
        groups = c.groups
        assert groups.storageLevel.useMemory
    assert not groups.storageLevel.useMemory
    with pytest.raises(ValueError):
        Comparison(c.run, c.params, SIDES, store="everything")
