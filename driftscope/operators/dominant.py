"""The most executed plan of each group, and the two sides' plans as a pair.

``candidate`` structs order by executions, average, plan id; the plan id is
unique, so the maximum is one plan.  As an aggregate it combines before the
shuffle, which a ranking window would not do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftscope.operators.groups import GROUP


def _unpacked(tag: str = "", source: str = "best") -> list[str]:
    suffix = f"_{tag}" if tag else ""
    fields = {"plan_id": "plan_id", "query_id": "query_id", "exec_count": "sum_exec", "avg_metric": "avg_metric"}
    return [f"{source}.{field} AS {name}{suffix}" for name, field in fields.items()]


def keep_groups(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Rows of the given groups only (semi-join)."""
    return rows if keys is None else rows.join(keys.select(*GROUP), GROUP, "left_semi")


def dominant_plans(rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """One plan per side and group.  ``rows``: plans or groups with ``candidate``."""
    best = keep_groups(rows, keys).groupBy("side", *GROUP).agg(F.expr("max(candidate) AS best"))
    return best.selectExpr("side", *GROUP, *_unpacked())


def dominant_pairs(rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Baseline and candidate plan of each group side by side.

    A group has at most one dominant plan per side, so the full outer pairing
    is a conditional aggregate over both sides: one shuffle and no join.
    """
    best = keep_groups(rows, keys).groupBy(*GROUP).agg(
        F.expr("max(if(side = 'L', candidate, NULL)) AS best_l"),
        F.expr("max(if(side = 'H', candidate, NULL)) AS best_h"),
    )
    return best.selectExpr(*GROUP, *_unpacked("l", "best_l"), *_unpacked("h", "best_h"))


def multi_plan_dominant(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs among multi-plan groups, where one key keeps one plan per side.

    Type and name do not separate plans here: of two objects that share a key
    the one with the more executed plan wins on each side.
    """
    ranked = keep_groups(rows, keys).selectExpr(
        "side", "group_key", "struct(candidate, query_type, obj_key) AS entry")
    winner = ranked.groupBy("side", "group_key").agg(F.expr("max(entry) AS entry")).selectExpr(
        "side", "group_key", "entry.query_type", "entry.obj_key", "entry.candidate")
    return dominant_pairs(winner)
