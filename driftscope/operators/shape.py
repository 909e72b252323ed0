"""Plan shape: indicators of dominant plans and how the sides differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftscope.functions.planxml import (
    INDICATORS, SHAPE_FLAG, indicator_columns, tolerant_indicators, well_formed,
)
from driftscope.functions.report import flag_text
from driftscope.functions.text import text_digest
from driftscope.operators.groups import GROUP
from driftscope.params import CompareParams

# ids of at most this many plans, of about a hundred bytes each in memory, are sent to every task
MEMBER_ROWS = 1 << 18


def pair_members(pairs: DataFrame) -> DataFrame:
    """The plans named by pairs, one row per side and plan."""
    return pairs.selectExpr(
        *GROUP, "inline(array(struct('L' AS side, plan_id_l AS plan_id), struct('H' AS side, plan_id_h AS plan_id)))"
    ).where("plan_id IS NOT NULL")


def plan_indicators(members: DataFrame, plan: DataFrame, p: CompareParams, engine: str = "xpath",
                    member_rows: int = MEMBER_ROWS) -> DataFrame:
    """Fetch the XML of the given plans and read it.

    Plans that are not asked for are dropped by the join before any XML is
    parsed.  The members are counted; if they are ``member_rows`` at most, their
    ids are broadcast, and other plans go where they are read.  XML itself is
    merged with the members, never sent to all tasks.  No XML, or malformed XML,
    gives NULLs.
    """
    if engine not in ("xpath", "pandas"):
        raise ValueError(f"engine must be xpath or pandas, not {engine!r}")
    key = ["side", "plan_id"]
    plan = plan.select(*key, "query_plan")
    if members.count() <= member_rows:
        plan = plan.join(F.broadcast(members.select(*key)), key, "left_semi")
    fetched = members.join(plan.hint("merge"), key)
    base = [*members.columns, "query_plan", text_digest(F.col("query_plan"), p.charset).alias("plan_xml_hash")]
    if engine == "xpath":
        readable = fetched.select(*base).selectExpr("*", f"{well_formed('query_plan')} AS _xml")
        return readable.selectExpr("* EXCEPT (_xml)", *indicator_columns("_xml"))
    return fetched.select(*base, tolerant_indicators(F.col("query_plan")).alias("i")).select(
        *members.columns, "query_plan", "plan_xml_hash", "i.*"
    )


def difference_flags() -> str:
    """Flags for every indicator that differs between ``…_l`` and ``…_h``."""
    return flag_text([
        ("NOT (plan_xml_hash_l <=> plan_xml_hash_h)", SHAPE_FLAG),
        *[(f"coalesce({i.name}_l, {i.missing}) != coalesce({i.name}_h, {i.missing})", i.flag) for i in INDICATORS],
    ])


def shape_diff(regressions: DataFrame, pairs: DataFrame, indicators: DataFrame) -> DataFrame:
    """Regressed groups with the indicators of both dominant plans and the flags.

    Groups without a pair are left out; a plan without a row in the plan table
    counts as unknown.  ``indicators`` has one row per side and group; both
    sides come side by side in one aggregate, so the plan table is read once.
    """
    facts = ["query_plan", "plan_xml_hash", *[i.name for i in INDICATORS]]
    by_group = indicators.groupBy(*GROUP).agg(*[
        F.expr(f"max(if(side = '{side}', struct({', '.join(facts)}), NULL)) AS facts_{tag}")
        for tag, side in (("l", "L"), ("h", "H"))
    ]).selectExpr(*GROUP, *[f"facts_{tag}.{c} AS {c}_{tag}" for tag in "lh" for c in facts])
    joined = regressions.join(pairs.select(*GROUP, "plan_id_l", "plan_id_h"), GROUP).join(by_group, GROUP, "left")
    return joined.selectExpr("*", f"{difference_flags()} AS diff_flags")
