"""Checks after collecting a run: is the data there, is the clone empty?"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftscope.operators.preagg import primary_replica, user_queries
from driftscope.sources.runs import SIDES, Run


def collection_check(run: Run) -> DataFrame:
    """Procedure calls, ad-hoc executions and their numbers, per side.

    A procedure has been called as often as its most executed statement.
    Statistics shrink to one row per plan, then per query, then per object;
    all four figures come out of the same pass.  A side without statistics has
    a row too: no sums and counts of 0.  Plans and queries are merged, never sent
    to all tasks, however small their files are.
    """
    per_plan = primary_replica(run.runtime_stats).groupBy("side", "plan_id").agg(
        F.sum(F.col("count_executions").cast("bigint")).alias("executions")
    )
    queries = user_queries(run.query).where(F.coalesce(F.col("object_id"), F.lit(0)) >= 0)
    per_query = (
        per_plan.join(run.plan.select("side", "plan_id", "query_id").hint("merge"), ["side", "plan_id"])
        .join(queries.select("side", "query_id", "object_id").hint("merge"), ["side", "query_id"])
        .groupBy("side", "query_id")
        .agg(F.max("object_id").alias("object_id"), F.sum("executions").alias("executions"))
    )
    procedure = F.col("object_id") > 0
    per_object = per_query.groupBy("side", F.when(procedure, F.col("object_id")).alias("object_id")).agg(
        F.max("executions").alias("most"), F.sum("executions").alias("all"), F.count(F.lit(1)).alias("queries")
    )
    is_object = F.col("object_id").isNotNull()
    sides = run.plan.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SIDES))).alias("side"))
    found = per_object.groupBy("side").agg(
        F.sum(F.when(is_object, F.col("most"))).alias("total_sp_execution_count"),
        F.sum(F.when(~is_object, F.col("all"))).alias("total_adhoc_execution_count"),
        F.count_if(is_object).alias("total_sp_count"),
        F.sum(F.when(~is_object, F.col("queries"))).alias("total_adhoc_query_count"),
    )
    return sides.join(found, "side", "left").fillna(0, ["total_sp_count", "total_adhoc_query_count"])


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of every table, by name, and whether there are none."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted).withColumn(
        "is_empty", F.when(F.col("row_count") == 0, 1).otherwise(0)
    ).orderBy("table_name")
