"""Timings and row counts of the steps of a comparison."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "step_no int, step_name string, ms bigint, rows_affected bigint, start_at timestamp, end_at timestamp"


class Steps:
    """Runs steps one by one, keeping each result for the next.

    A lazy plan has no steps to time, so this is for diagnosis: every step is
    computed and stored (memory, then disk; lost blocks are recomputed), while
    an Observation counts its rows in the same pass.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._rows: list[tuple] = []
        self._kept: list[DataFrame] = []

    def run(self, name: str, result: DataFrame) -> DataFrame:
        start = dt.datetime.now()
        seen = Observation(f"step-{len(self._rows) + 1}")
        kept = result.persist()
        kept.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        self._kept.append(kept)
        self._record(name, start, seen.get["rows"])
        return kept

    def note(self, name: str, start: dt.datetime) -> None:
        """A step that makes no rows, such as resolving the sides."""
        self._record(name, start, None)

    def _record(self, name: str, start: dt.datetime, rows: int | None) -> None:
        end = dt.datetime.now()
        ms = int((end - start).total_seconds() * 1000)
        self._rows.append((len(self._rows) + 1, name, ms, rows, start, end))

    def metrics(self) -> DataFrame:
        return self._spark.createDataFrame(self._rows, SCHEMA)

    def release(self) -> None:
        for kept in self._kept:
            kept.unpersist()
        self._kept.clear()
