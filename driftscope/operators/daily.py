"""Plan totals by day, kept in a table: a new day is read alone, and any time window is merged from days.

The table has one row per side, plan, replica group and day, in one folder per
day.  Sums, minima and maxima of days merge to those of any set of days, so a
comparison over months reads as many rows as there are plans and days instead of
all statistics.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftscope.functions.report import TOTAL
from driftscope.operators.preagg import many_plans, merged_totals, of_queries, plan_totals, primary_replica, time_window
from driftscope.params import CompareParams
from driftscope.sources.runs import Run

KEY = ("side", "plan_id", "replica_group_id")


def _midnight(day: dt.date) -> dt.datetime:
    return dt.datetime(day.year, day.month, day.day)


class DailyTotals:
    """The table below ``path``.

    Which days have been added is the caller's business, day by day or many at
    once.  An interval belongs to the day it starts on.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def partials(self, run: Run, first: dt.date, last: dt.date) -> DataFrame:
        """Totals of the days from ``first`` to ``last``, from the statistics of their intervals only."""
        days = CompareParams(start=_midnight(first), end=_midnight(last + dt.timedelta(days=1)))
        interval = time_window(run.interval, days).withColumn("day", F.to_date("start_time"))
        return plan_totals(run.runtime_stats, interval, "replica_group_id", "day", pruned=True,
                           spread=many_plans(run))

    def add(self, run: Run, first: dt.date, last: dt.date | None = None) -> None:
        """Take in days, replacing what was there of them, so a repeated call changes nothing.

        A day whose statistics have all gone keeps its former rows.
        """
        rows = self.partials(run, first, last or first)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def rows(self, run: Run) -> DataFrame:
        """The stored rows; the ids' types are those of the run."""
        kind = {f.name: f.dataType for f in run.runtime_stats.schema}
        time = {f.name: f.dataType for f in run.interval.schema}
        total = T._parse_datatype_string(TOTAL)
        schema = T.StructType([T.StructField(k, kind[k]) for k in KEY]
                              + [T.StructField("sum_exec", T.LongType())]
                              + [T.StructField(f"total_{m}", total) for m in ("reads", "cpu", "dur")]
                              + [T.StructField("interval_start_min", time["start_time"]),
                                 T.StructField("interval_end_max", time["end_time"]), T.StructField("day", T.DateType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def plan_stats(self, run: Run, p: CompareParams) -> DataFrame:
        """The same rows as ``preagg.plan_stats``, from whole days of the table.

        Parts of days at the ends of the window come from the statistics.
        """
        # the first whole day, and the day after the last one
        low = p.start.date() if p.start else None
        if low and p.start != _midnight(low):
            low += dt.timedelta(days=1)
        high = p.end.date() if p.end else None
        if low and high and low >= high:
            parts = [self._edge(run, p, p.start, p.end)]
        else:
            days = self.rows(run)
            days = days if low is None else days.where(F.col("day") >= F.lit(low))
            days = days if high is None else days.where(F.col("day") < F.lit(high))
            days = primary_replica(days) if p.primary_replica_only else days
            parts = [days.drop("replica_group_id", "day")]
            if low and p.start < _midnight(low):
                parts.append(self._edge(run, p, p.start, _midnight(low)))
            if high and p.end > _midnight(high):
                parts.append(self._edge(run, p, _midnight(high), p.end))
        totals = parts[0]
        for part in parts[1:]:
            totals = totals.unionByName(part)
        return of_queries(merged_totals(totals), run, p)

    @staticmethod
    def _edge(run: Run, p: CompareParams, start: dt.datetime, end: dt.datetime) -> DataFrame:
        stats = primary_replica(run.runtime_stats) if p.primary_replica_only else run.runtime_stats
        return plan_totals(stats, time_window(run.interval, replace(p, start=start, end=end)), pruned=True,
                           spread=many_plans(run))
