"""All plans of multi-plan groups, ranked within their side and key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftscope.functions.text import text_digest
from driftscope.operators.dominant import keep_groups
from driftscope.operators.numbering import value_ranks
from driftscope.params import CompareParams

RANKED_IN = ["side", "group_key"]


def multi_plan_rows(identified: DataFrame, keys: DataFrame) -> DataFrame:
    """The plans of the given groups, without their texts."""
    return keep_groups(
        identified.select(
            "side", "query_type", "obj_name", "obj_key", "group_key", "plan_id", "query_id",
            "sum_exec", "total_metric", "avg_metric", "total_dur", "avg_dur",
            "interval_start_min", "interval_end_max",
        ),
        keys,
    )


def multi_plan_detail(rows: DataFrame, plan: DataFrame, p: CompareParams) -> DataFrame:
    """Add the digest of each plan's XML and its ranks by average and executions.

    Distinct values are ranked in bounded windows and joined back, which spreads
    a key with very many plans over many tasks.  XML is hashed where it is read;
    only digests are shuffled, and merged, since there are as many as plans.
    """
    digests = plan.select("side", "plan_id", text_digest(F.col("query_plan"), p.charset).alias("plan_xml_hash"))
    hashed = rows.join(digests.hint("merge"), ["side", "plan_id"])
    by_avg = value_ranks(rows, RANKED_IN, "avg_metric", "rank_by_avg", scale=6)
    by_exec = value_ranks(rows, RANKED_IN, "sum_exec", "rank_by_exec")
    return hashed.join(by_avg, [*RANKED_IN, "avg_metric"]).join(by_exec, [*RANKED_IN, "sum_exec"])
