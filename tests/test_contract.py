"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract
from contract.oracle import ORACLE_SQL
from contract.oracle_core import XML_FACTS
from contract.queries import QUERIES, comparison
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no given tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem, rows = compare(spark, duck, name, contract.queries()[name], ORACLE_SQL[name], SF_DIR)
    assert not problem
    assert rows > 0


LARGE_TABLE_SETTINGS = {
    # what large inputs bring about: no broadcasts, many shuffle partitions, skewed ones split
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
}


@pytest.fixture
def large_table_plans(spark):
    before = {key: spark.conf.get(key, None) for key in LARGE_TABLE_SETTINGS}
    for key, value in LARGE_TABLE_SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", ["compare_normalized", "plan_shape_diff", "multi_plan_drilldown", "delete_cascade",
                                  "guarded_insert_two", "replay_sequence"])
def test_query_with_plans_for_large_tables(spark, duck, large_table_plans, name):
    problem, _ = compare(spark, duck, name, contract.queries()[name], contract.oracle_sql()[name], SF_DIR)
    assert not problem


def test_statistics_are_aggregated_before_any_shuffle(spark):
    """Between the scan of the big table and its partial sums there is no exchange; only asked columns are read."""
    plan = comparison(spark, SF_DIR, None).plan_stats.select("plan_id", "sum_exec")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    lines = physical.splitlines()
    top = next(i for i, line in enumerate(lines) if "functions=[partial_sum(count_executions" in line)
    bottom = next(i for i, line in enumerate(lines) if "FileScan" in line and "l_quantity" in line)
    between = [line for line in lines[top:bottom] if "Exchange" in line]
    assert top < bottom and all("BroadcastExchange" in line for line in between)
    scan = lines[bottom]
    assert "l_extendedprice" not in scan and "l_tax" not in scan


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE_SQL) <= set(contract.oracle_sql())


def test_every_indicator_occurs(duck):
    """And differs between sides: each flag is raised for some plan of the derived run."""
    from contract.oracle import FLAGS
    from contract.oracle_core import RUN_INPUTS, xml_fact
    facts = ", ".join(f"{xml_fact(k, p, 'query_plan')} AS {n}" for n, k, p in XML_FACTS)
    some = ", ".join(f"max({n})" for n, _, _ in XML_FACTS)
    got = duck.execute(f"WITH {RUN_INPUTS}, f AS (SELECT {facts} FROM pln) SELECT {some} FROM f").fetchone()
    assert all(got)
    pairs = ", ".join(f"count(*) FILTER (WHERE l.{n} IS DISTINCT FROM h.{n})" for n, _, _ in XML_FACTS)
    differ = duck.execute(f"WITH {RUN_INPUTS}, f AS (SELECT side, plan_id, {facts} FROM pln) SELECT {pairs} "
                          "FROM f l JOIN f h USING (plan_id) WHERE l.side = 'L' AND h.side = 'H'").fetchone()
    assert all(differ) and len(differ) == len(FLAGS)


def test_entry(spark):
    assert contract.entry(spark).count() >= 11
