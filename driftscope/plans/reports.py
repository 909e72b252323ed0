"""The result sets with their published column names and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftscope.functions.planxml import INDICATORS
from driftscope.functions.report import RATIO, SHOWN_RATIO, TOTAL, hex_digits, pair_text, shown
from driftscope.operators.compare import IS_MULTI_PLAN
from driftscope.operators.groups import GROUP, hash_bytes
from driftscope.params import CompareParams
from driftscope.sources.sides import Sides

# makes the order of equal impacts repeatable
_TIE_BREAK = ["group_key", "query_type", "obj_key", "query_id_range_l", "query_id_range_h"]

_GROUP_COLUMNS = [
    "query_type AS QueryType",
    "obj_name AS ObjName",
    f"{hex_digits('group_key')} AS GroupKeyHashHex",
]
_SCORES = [
    f"{shown('impact_score')} AS ImpactScore",
    f"{shown('regression_ratio', SHOWN_RATIO)} AS RegressionRatio",
]


def by_impact() -> list[Column]:
    return [F.desc("impact_score"), *[F.asc(c) for c in _TIE_BREAK]]


def _pair(name: str, column: str, rounded: bool = False) -> str:
    low, high = f"{column}_l", f"{column}_h"
    if rounded:
        low, high = shown(low), shown(high)
    return f"{pair_text(low, high)} AS `{name}_L-H`"


def overview(regressions: DataFrame, pairs: DataFrame, p: CompareParams) -> DataFrame:
    """Result set 1: regressed groups, the largest impact first.

    Both sides of a regressed group exist, so its pair exists too and an inner
    join loses nothing; it lets Spark broadcast the few top rows instead of
    shuffling all pairs.
    """
    top = regressions.orderBy(*by_impact())
    if p.top_n is not None:
        top = top.limit(p.top_n)
    plans = pairs.selectExpr(*GROUP, "plan_id_l", "plan_id_h", "query_id_l AS dominant_query_id_l",
                             "query_id_h AS dominant_query_id_h")
    hashes = [hex_digits(hash_bytes(regressions, f"query_hash_{t}")) for t in "lh"]
    return top.join(plans, GROUP).orderBy(*by_impact()).selectExpr(
        *_GROUP_COLUMNS,
        _pair("QueryIdRange", "query_id_range"),
        f"{pair_text(*hashes)} AS `QueryHashHex_L-H`",
        _pair("DominantPlanId", "plan_id"),
        _pair("DominantQueryId", "dominant_query_id"),
        _pair("PlanCount", "plan_count"),
        _pair("ExecCount", "exec_count"),
        _pair("TotalMetric", "total_metric", rounded=True),
        _pair("AvgMetric", "avg_metric", rounded=True),
        _pair("TotalDuration", "total_duration", rounded=True),
        _pair("AvgDuration", "avg_duration", rounded=True),
        f"{shown('regression_ratio', SHOWN_RATIO)} AS RegressionRatio",
        f"{shown('delta_avg_metric')} AS DeltaAvgMetric",
        f"{shown('impact_score')} AS ImpactScore",
        "confidence_flags AS ConfidenceFlags",
        "query_text_sample AS QueryTextSample",
    )


def _total_pair(name: str, query_type: str | None = None) -> str:
    def side(tag: str) -> str:
        value = f"exec_count_{tag}"
        if query_type:
            value = f"if(query_type = '{query_type}', {value}, 0)"
        return f"coalesce(cast(sum({value}) AS string), '')"

    return f"concat({side('l')}, ' - ', {side('h')}) AS `{name}`"


def summary(regressions: DataFrame, p: CompareParams, sides: Sides) -> DataFrame:
    """Result set 2: one row on all regressions."""
    return regressions.agg(*map(F.expr, (
        "count(1) AS RegressionCount",
        f"sum(if({IS_MULTI_PLAN}, 1, 0)) AS MultiPlanCount",
        f"{shown('sum(impact_score)')} AS SumImpactScore",
        f"{shown('max(impact_score)')} AS MaxImpactScore",
        f"{shown('round(avg(regression_ratio), 6)', SHOWN_RATIO)} AS AvgRegressionRatio",
        _total_pair("TotalExecCount_L-H_SP", "SP"),
        _total_pair("TotalExecCount_L-H_Adhoc", "Adhoc"),
        _total_pair("TotalExecCount_L-H_All"),
    ))).select(
        F.lit(sides.low_db).alias("LowerDb"),
        F.lit(sides.high_db).alias("HigherDb"),
        F.lit(str(sides.low_level)).alias("LowerCL"),
        F.lit(str(sides.high_level)).alias("HigherCL"),
        F.lit(p.metric).alias("Metric"),
        F.lit(p.group_by).alias("GroupBy"),
        "*",
    )


def _by_side(low: str, high: str) -> Column:
    return F.when(F.col("side") == "L", F.lit(low)).otherwise(F.lit(high))


def drilldown(detail: DataFrame, sides: Sides) -> DataFrame:
    """Result set 3: every plan of the regressed multi-plan groups."""
    named = detail.withColumns({
        "SourceDb": _by_side(sides.low_db, sides.high_db),
        "SourceCL": _by_side(str(sides.low_level), str(sides.high_level)),
    })
    return named.selectExpr(
        "SourceDb", "SourceCL", "side AS Side",
        *_GROUP_COLUMNS,
        "plan_id AS PlanId",
        "query_id AS QueryId",
        "sum_exec AS ExecCount",
        f"{shown('total_metric')} AS TotalMetric",
        f"{shown('avg_metric')} AS AvgMetric",
        f"{shown('total_dur')} AS TotalDuration",
        f"{shown('avg_dur')} AS AvgDuration",
        "interval_start_min AS IntervalStartMin",
        "interval_end_max AS IntervalEndMax",
        f"{hex_digits('plan_xml_hash')} AS PlanXmlHashHex",
        "rank_by_avg AS RankByAvgMetric",
        "rank_by_exec AS RankByExecCount",
    ).orderBy("GroupKeyHashHex", "Side", "RankByAvgMetric", "RankByExecCount", "PlanId")


def shape_report(differences: DataFrame, sides: Sides) -> DataFrame:
    """Result set 4: indicator pairs and difference flags of multi-plan groups."""
    digests = pair_text(hex_digits("plan_xml_hash_l"), hex_digits("plan_xml_hash_h"))
    return differences.orderBy(*by_impact()).selectExpr(
        *_GROUP_COLUMNS,
        *_SCORES,
        _pair("ExecCount", "exec_count"),
        _pair("AvgMetric", "avg_metric", rounded=True),
        _pair("DominantPlanId", "plan_id"),
        f"{digests} AS `PlanXmlHashHex_L-H`",
        *[_pair(i.shown, i.name) for i in INDICATORS if i.shown],
        "diff_flags AS DiffFlags",
        "query_text_sample AS QueryTextSample",
        f"query_plan_l AS `PlanXml_{sides.low_label}`",
        f"query_plan_h AS `PlanXml_{sides.high_label}`",
    )


def result_rows(regressions: DataFrame, pairs: DataFrame, p: CompareParams, sides: Sides) -> DataFrame:
    """The unformatted rows kept for later, all regressions and not only the top."""
    plans = pairs.selectExpr(
        *GROUP, "plan_id_l AS DominantPlanId_L", "plan_id_h AS DominantPlanId_H",
        "query_id_l AS DominantQueryId_L", "query_id_h AS DominantQueryId_H")
    typed = [("PlanCount", "plan_count", "int"), ("ExecCount", "exec_count", "bigint"),
             ("TotalMetric", "total_metric", TOTAL), ("AvgMetric", "avg_metric", TOTAL)]
    return regressions.join(plans, GROUP, "left").select(
        F.current_timestamp().alias("CollectedAt"),
        F.lit(sides.low_db).alias("LowerDb"),
        F.lit(sides.high_db).alias("HigherDb"),
        F.lit(str(sides.low_level)).alias("LowerCL"),
        F.lit(str(sides.high_level)).alias("HigherCL"),
        F.lit(p.metric).alias("Metric"),
        F.lit(p.group_by).alias("GroupBy"),
        *map(F.expr, (
            "query_type AS QueryType", "obj_name AS ObjName", "group_key AS GroupKeyHash",
            "DominantPlanId_L", "DominantPlanId_H", "DominantQueryId_L", "DominantQueryId_H",
            *[f"cast({column}_{tag} AS {kind}) AS {name}_{tag.upper()}"
              for name, column, kind in typed for tag in "lh"],
            f"cast(regression_ratio AS {RATIO}) AS RegressionRatio",
            f"cast(impact_score AS {TOTAL}) AS ImpactScore",
            "confidence_flags AS ConfidenceFlags",
            "query_text_sample AS QueryTextSample",
        )),
    )
