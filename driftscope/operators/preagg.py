"""One row per plan: the first and largest reduction of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftscope.functions.report import TOTAL, weighted_average
from driftscope.params import CompareParams
from driftscope.sources.runs import Run

WIDE = "decimal(38,12)"
# intervals of at most this many rows, of some hundred bytes each in memory, are sent to every task
INTERVAL_ROWS = 1 << 18
# totals of at most this many plans, of some 250 bytes each, are held by every task that reads statistics
PLAN_ROWS = 1 << 20


def time_window(interval: DataFrame, p: CompareParams) -> DataFrame:
    """Intervals starting at or after ``start`` and before ``end``."""
    if p.start is not None:
        interval = interval.where(F.col("start_time") >= F.lit(p.start))
    if p.end is not None:
        interval = interval.where(F.col("start_time") < F.lit(p.end))
    return interval


def included_queries(query: DataFrame, p: CompareParams) -> DataFrame:
    """Stored-procedure queries have a positive object id, ad-hoc ones 0 or none."""
    wanted = []
    if p.include_sp:
        wanted.append("object_id > 0")
    if p.include_adhoc:
        wanted.append("coalesce(object_id, 0) = 0")
    return query.where(" OR ".join(wanted) or "false")


def user_queries(query: DataFrame) -> DataFrame:
    """Queries the host does not run for itself."""
    return query.where("coalesce(is_internal_query, 0) = 0")


def primary_replica(runtime_stats: DataFrame) -> DataFrame:
    return runtime_stats.where("replica_group_id = 1")


def _weighted(df: DataFrame, average: str) -> str:
    """Sum of average × executions with at most six decimal places.

    A short decimal average times a count is exact as it stands.  Only longer
    or floating averages need the wide type, whose product Spark rounds to six
    places; it costs several times as much per row.
    """
    dtype = df.schema[average].dataType
    count = "cast(count_executions AS bigint)"
    if isinstance(dtype, T.DecimalType) and dtype.precision <= 18 and dtype.scale <= 6:
        return f"cast(sum({average} * {count}) AS {TOTAL})"
    return f"cast(sum(cast({average} AS {WIDE}) * cast({count} AS {WIDE})) AS {TOTAL})"


def _totals(df: DataFrame, weigh: bool) -> list[str]:
    """Executions and weighted totals; ``weigh`` multiplies averages first, otherwise totals are added up."""
    if weigh:
        return ["sum(cast(count_executions AS bigint)) AS sum_exec", *[
            f"{_weighted(df, column)} AS total_{m}"
            for m, column in (("reads", "avg_logical_io_reads"), ("cpu", "avg_cpu_time"), ("dur", "avg_duration"))]]
    return ["cast(sum(sum_exec) AS bigint) AS sum_exec",
            *[f"cast(sum(total_{m}) AS {TOTAL}) AS total_{m}" for m in ("reads", "cpu", "dur")]]


def interval_bounds(interval: DataFrame) -> list[tuple[str, int, int]]:
    """Lowest and highest id of the intervals of each side."""
    bounds = interval.groupBy("side").agg(F.min("runtime_stats_interval_id").alias("low"),
                                          F.max("runtime_stats_interval_id").alias("high"))
    return [tuple(r) for r in bounds.collect()]


def within(stats: DataFrame, bounds: list[tuple[str, int, int]]) -> DataFrame:
    """Statistics of intervals within the bounds, a range that reaches the scan and skips files and row groups.

    It holds more than the window if ids and times are not in the same order;
    the join with the intervals decides.
    """
    wanted = F.lit(False)
    for side, low, high in bounds:
        wanted = wanted | ((F.col("side") == side) & F.col("runtime_stats_interval_id").between(low, high))
    return stats.where(wanted)


def many_plans(run: Run, plan_rows: int = PLAN_ROWS) -> bool:
    return run.plan.select("side", "plan_id").count() > plan_rows


def dealt(stats: DataFrame) -> DataFrame:
    """Statistics dealt by plan, in shares of the session's advisory size.

    Shares are told by a hash and not by the plan itself, so that those of plans
    with very many rows may be split by AQE; the totals of the parts still meet.
    """
    shares = stats.withColumn("share", F.expr("xxhash64(side, plan_id)"))
    return shares.hint("rebalance", F.col("share")).drop("share")


def plan_totals(stats: DataFrame, interval: DataFrame, *more: str, pruned: bool = False,
                interval_rows: int = INTERVAL_ROWS, spread: bool = False) -> DataFrame:
    """Executions, weighted totals and time bounds per plan and, if wanted, ``more`` columns of either table.

    The statistics are the one big table.  They meet only ids and bounds of the
    intervals.  Those are counted, and broadcast if they are ``interval_rows`` at
    most; the statistics are then aggregated where they are read, before any
    shuffle.  Beyond that, statistics are added up per plan and interval
    first, so that what is shuffled for the join is no more than that.  With
    ``pruned`` the bounds of the interval ids are looked up and pushed to the
    statistics' scan.

    A task that adds up where it reads holds a total for each plan in its split,
    which with scattered rows may be nearly one per row.  With ``spread``, and
    for totals per plan and interval, statistics are dealt by plan before.
    """
    if pruned:
        stats = within(stats, interval_bounds(interval))
    interval = interval.select("side", "runtime_stats_interval_id", "start_time", "end_time",
                               *[c for c in more if c in interval.columns])
    at_once = interval.count() <= interval_rows
    if spread or not at_once:
        stats = dealt(stats)
    if at_once:
        interval = F.broadcast(interval)
    else:
        own = [c for c in more if c in stats.columns]
        stats = stats.groupBy("side", "plan_id", "runtime_stats_interval_id", *own).agg(*map(F.expr, _totals(stats, True)))
    timed = stats.join(interval, ["side", "runtime_stats_interval_id"])
    return timed.groupBy("side", "plan_id", *more).agg(*map(F.expr, (
        *_totals(timed, at_once),
        "min(start_time) AS interval_start_min",
        "max(end_time) AS interval_end_max",
    )))


def merged_totals(totals: DataFrame) -> DataFrame:
    """Partial totals of plans as one row per plan."""
    return totals.groupBy("side", "plan_id").agg(*map(F.expr, (
        *_totals(totals, False),
        "min(interval_start_min) AS interval_start_min",
        "max(interval_end_max) AS interval_end_max",
    )))


def of_queries(totals: DataFrame, run: Run, p: CompareParams) -> DataFrame:
    """Plan totals with their query and averages, for the queries that are compared.

    Plans and queries have no bound and their sizes in files say little about
    their rows, so they are merged, never sent to all tasks.
    """
    queries = included_queries(run.query, p)
    if p.primary_replica_only:
        queries = user_queries(queries)
    plans = run.plan.select("side", "plan_id", "query_id")
    queries = queries.select("side", "query_id", "query_text_id", "object_id", "query_hash")
    return totals.join(plans.hint("merge"), ["side", "plan_id"]).join(queries.hint("merge"), ["side", "query_id"]).selectExpr(
        "side", "plan_id", "query_id", "query_text_id", "object_id", "query_hash",
        "sum_exec", "total_reads", "total_cpu", "total_dur",
        *[f"{weighted_average(f'total_{m}', 'sum_exec')} AS avg_{m}" for m in ("reads", "cpu", "dur")],
        "interval_start_min", "interval_end_max",
    )


def plan_stats(run: Run, p: CompareParams, interval_rows: int = INTERVAL_ROWS, plan_rows: int = PLAN_ROWS) -> DataFrame:
    """Executions, weighted totals and averages, and time bounds per plan.

    Plan and query rows join at plan grain, after the totals.
    """
    stats = primary_replica(run.runtime_stats) if p.primary_replica_only else run.runtime_stats
    totals = plan_totals(stats, time_window(run.interval, p), pruned=p.start is not None or p.end is not None,
                         interval_rows=interval_rows, spread=many_plans(run, plan_rows))
    return of_queries(totals, run, p)
