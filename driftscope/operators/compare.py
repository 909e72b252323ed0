"""Baseline against candidate, and what counts as a regression."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftscope.functions.report import RATIO, TOTAL, flag_list, flag_text
from driftscope.operators.groups import GROUP, hash_bytes
from driftscope.params import CompareParams

# The confidence flags.
MISSING_ONE_SIDE = "MISSING_ONE_SIDE"
LOW_EXEC = "LOW_EXEC"
MULTI_PLAN = "MULTI_PLAN"
SIDE_NOTES = ("WEIGHTED_TOTAL", "PLAN_FIRST_PREAGG")
END_FALLBACK = "INTERVAL_END_FALLBACK"

IS_MULTI_PLAN = "plan_count_l > 1 OR plan_count_h > 1"

_CARRIED = [
    "obj_name", "query_hash", "query_id_min", "query_id_max", "plan_count", "exec_count",
    "total_metric", "avg_metric", "total_duration", "avg_duration", "query_text_sample",
]


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on plain equality, as a left join plus the unmatched right.

    The result is the same; but AQE can split a skewed key in a left or anti
    join and cannot in a full outer one, which also holds all rows of a key in
    memory.
    """
    matched = left.join(right, keys, "left")
    only_right = right.join(left.select(*keys), keys, "left_anti")
    return matched.unionByName(only_right, allowMissingColumns=True)


def compare(groups: DataFrame, p: CompareParams, end_fallback: Iterable[str] = ()) -> DataFrame:
    """One row per group of both sides, and one per group without a match.

    ``groups`` is read once per side and once more for the unmatched ones, so
    it should be persisted or stored (:class:`driftscope.Comparison` does).
    """
    keys = [*GROUP, "meet_hash"] if p.split_by_hash else GROUP
    if p.split_by_hash:
        groups = groups.withColumn("meet_hash", F.coalesce(F.expr(hash_bytes(groups)), F.lit(b"")))
    low, high = (
        groups.where(f"side = '{side}'").selectExpr(
            *keys, *[f"{c} AS {c}_{tag}" for c in _CARRIED], f"true AS present_{tag}")
        for tag, side in (("l", "L"), ("h", "H"))
    )
    return _measures(full_outer(low, high, keys), p, frozenset(end_fallback))


def _measures(joined: DataFrame, p: CompareParams, end_fallback: frozenset[str]) -> DataFrame:
    totals = ("total_metric", "avg_metric", "total_duration", "avg_duration")
    filled = joined.selectExpr(
        *GROUP,
        "coalesce(obj_name_h, obj_name_l) AS obj_name",
        "query_hash_l", "query_hash_h",
        *[f"concat(cast(query_id_min_{t} AS string), '-', cast(query_id_max_{t} AS string)) AS query_id_range_{t}"
          for t in "lh"],
        *[f"cast(coalesce(plan_count_{t}, 0) AS int) AS plan_count_{t}" for t in "lh"],
        *[f"cast(coalesce(exec_count_{t}, 0) AS bigint) AS exec_count_{t}" for t in "lh"],
        *[f"coalesce({m}_{t}, cast(0 AS {TOTAL})) AS {m}_{t}" for m in totals for t in "lh"],
        # the raw averages stay nullable: a missing or zero side has no ratio
        "avg_metric_h AS high", f"nullif(avg_metric_l, cast(0 AS {TOTAL})) AS base",
        "present_l", "present_h",
        "coalesce(query_text_sample_h, query_text_sample_l) AS query_text_sample",
    )
    kept = [c for c in filled.columns if c not in ("high", "base", "present_l", "present_h")]
    return filled.selectExpr(
        *kept,
        f"cast(high / base AS {RATIO}) AS regression_ratio",
        f"cast(avg_metric_h - avg_metric_l AS {TOTAL}) AS delta_avg_metric",
        f"if(base IS NOT NULL, cast((avg_metric_h - avg_metric_l) * exec_count_h AS {TOTAL}), NULL) AS impact_score",
        f"{_confidence(p, end_fallback)} AS confidence_flags",
    )


def _confidence(p: CompareParams, end_fallback: frozenset[str]) -> str:
    flags = [("exec_count_l = 0 OR exec_count_h = 0", MISSING_ONE_SIDE)]
    if p.min_exec is not None:
        flags.append((f"exec_count_l < {p.min_exec} OR exec_count_h < {p.min_exec}", LOW_EXEC))
    flags.append((IS_MULTI_PLAN, MULTI_PLAN))
    for tag, side in (("l", "L"), ("h", "H")):
        notes = SIDE_NOTES + ((END_FALLBACK,) if side in end_fallback else ())
        flags.extend((f"present_{tag} IS NOT NULL", note) for note in notes)
    return flag_text(flags)


def regressed(compared: DataFrame, p: CompareParams) -> DataFrame:
    """Rows that became dearer, with enough executions and a large enough ratio."""
    conditions = ["regression_ratio IS NOT NULL", "avg_metric_h > avg_metric_l"]
    if p.min_exec is not None:
        conditions += [f"exec_count_l >= {p.min_exec}", f"exec_count_h >= {p.min_exec}"]
    if p.min_ratio is not None:
        conditions.append(f"regression_ratio >= cast('{p.min_ratio}' AS decimal(9,4))")
    if p.only_multi_plan:
        conditions.append(f"({IS_MULTI_PLAN})")
    return compared.where(" AND ".join(conditions))


def group_names(rows: DataFrame) -> DataFrame:
    """The distinct groups among comparison rows."""
    return rows.select(*GROUP).distinct()


def with_flag_list(rows: DataFrame) -> DataFrame:
    """Confidence flags as an array beside the text."""
    return rows.selectExpr("*", f"{flag_list('confidence_flags')} AS confidence_flag_list")
