from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from driftscope.session import local_session
from driftscope.sources.runs import as_run, union_runs


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


MINUTE = dt.datetime(2025, 1, 1)


class RunMaker:
    """A run from a few plan lines: one statistics row per line."""

    def __init__(self, spark):
        self.spark = spark

    def side(self, side, lines, texts=None, objects=((1, "p_one", 1), (2, "p_two", 1)), end_time=True, hashes=None,
             internal=(), average="decimal(18,2)", xml=None):
        """lines: (plan, query, object_id, minute, executions, reads)."""
        hashes, texts, xml = hashes or {}, texts or {}, xml or {}
        stats = [(plan, minute, 1, n, Decimal(str(reads)), Decimal("1.50"), Decimal("2.25"))
                 for plan, _, _, minute, n, reads in lines]
        plans = sorted({(plan, query, xml.get(plan)) for plan, query, *_ in lines}, key=str)
        queries = sorted({(q, q, o, hashes.get(q, f"hash{q:04d}".encode()), int(q in internal))
                          for _, q, o, *_ in lines}, key=str)
        minutes = sorted({line[3] for line in lines})
        start = [(m, MINUTE + dt.timedelta(minutes=m), MINUTE + dt.timedelta(minutes=m + 1)) for m in minutes]
        frame = self.spark.createDataFrame
        interval = frame(start, "runtime_stats_interval_id bigint, start_time timestamp, end_time timestamp")
        return as_run({
            "runtime_stats": frame(stats, "plan_id bigint, runtime_stats_interval_id bigint, replica_group_id int, "
                                   "count_executions bigint, avg_logical_io_reads decimal(18,2), "
                                   "avg_cpu_time decimal(18,2), avg_duration decimal(18,2)").selectExpr(
                                       "* EXCEPT (avg_logical_io_reads)",
                                       f"cast(avg_logical_io_reads AS {average}) AS avg_logical_io_reads"),
            "interval": interval if end_time else interval.drop("end_time"),
            "plan": frame(plans, "plan_id bigint, query_id bigint, query_plan string"),
            "query": frame(queries, "query_id bigint, query_text_id bigint, object_id int, query_hash binary, "
                                    "is_internal_query int"),
            "query_text": frame([(q, texts.get(q, f"SELECT {q}")) for q, *_ in queries],
                                "query_text_id bigint, query_sql_text string"),
            "objects": frame(list(objects), "object_id int, name string, schema_id int"),
            "schemas": frame([(1, "dbo")], "schema_id int, name string"),
        }, side)

    def both(self, low, high, **options):
        return union_runs(self.side("L", low, **options), self.side("H", high, **options))


@pytest.fixture(scope="session")
def runs(spark):
    return RunMaker(spark)
