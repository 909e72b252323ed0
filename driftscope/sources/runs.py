"""Run statistics of the two sides.

A *side* is L (baseline) or H (candidate).  Every table of a :class:`Run`
carries a ``side`` column, so later steps handle both sides in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES = ("L", "H")
TABLES = ("runtime_stats", "interval", "plan", "query", "query_text", "objects", "schemas")


@dataclass(frozen=True)
class Run:
    """The seven run-statistics tables, for one side or for both."""

    runtime_stats: DataFrame
    interval: DataFrame
    plan: DataFrame
    query: DataFrame
    query_text: DataFrame
    objects: DataFrame
    schemas: DataFrame
    # sides whose interval table has no end_time, so that starts stand in for ends
    end_fallback: frozenset[str] = frozenset()

    def union(self, other: Run) -> Run:
        """Both sides as one run."""
        tables = {t: getattr(self, t).unionByName(getattr(other, t)) for t in TABLES}
        return Run(**tables, end_fallback=self.end_fallback | other.end_fallback)


def as_run(tables: Mapping[str, DataFrame], side: str) -> Run:
    """Tag the tables of one side; settle whether intervals have an end."""
    if side not in SIDES:
        raise ValueError(f"side must be L or H, not {side!r}")
    missing = [t for t in TABLES if t not in tables]
    if missing:
        raise ValueError(f"missing run tables: {', '.join(missing)}")
    tagged = {t: tables[t].withColumn("side", F.lit(side)) for t in TABLES}
    has_end = "end_time" in tables["interval"].columns
    tagged["interval"] = tagged["interval"].select(
        "side",
        "runtime_stats_interval_id",
        "start_time",
        F.col("end_time" if has_end else "start_time").alias("end_time"),
    )
    return Run(**tagged, end_fallback=frozenset() if has_end else frozenset(side))


# what splits a JDBC table into reads that run side by side
JDBC_PARTITIONING = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def reader_options(table: str, source: str, format: str, options: Mapping[str, str],
                   table_options: Mapping[str, Mapping[str, str]]) -> dict[str, str]:
    """The options one table is read with: those of all tables, then its own.

    Over JDBC the statistics must say how they are split, because one
    connection would read the largest table alone.
    """
    own = {**options, **table_options.get(table, {})}
    if format == "jdbc":
        missing = [o for o in JDBC_PARTITIONING if o not in own]
        if table == "runtime_stats" and missing:
            raise ValueError(f"runtime_stats over JDBC needs {', '.join(missing)} in table_options")
        own["dbtable"] = source
    return own


def load_run(spark: SparkSession, paths: Mapping[str, str], side: str, format: str = "parquet",
             table_options: Mapping[str, Mapping[str, str]] | None = None, **options: str) -> Run:
    """Read one side.

    ``paths`` maps the table names in :data:`TABLES` to folders or files, to
    table names for ``format="table"``, or to ``dbtable`` values for
    ``format="jdbc"`` (``options`` then holds url and driver).
    ``table_options`` has options of single tables, such as how to split them.
    """
    def read(table: str) -> DataFrame:
        if format == "table":
            return spark.read.table(paths[table])
        reader = spark.read.format(format).options(
            **reader_options(table, paths[table], format, options, table_options or {}))
        return reader.load() if format == "jdbc" else reader.load(paths[table])

    return as_run({t: read(t) for t in TABLES if t in paths}, side)


def union_runs(low: Run, high: Run) -> Run:
    """Append the candidate's tables to the baseline's."""
    return low.union(high)


def run_tables(run: Run) -> dict[str, DataFrame]:
    return {f.name: getattr(run, f.name) for f in fields(run) if f.name in TABLES}
