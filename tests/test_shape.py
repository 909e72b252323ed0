import hashlib

import pytest
from pyspark.sql import functions as F

from driftscope import Comparison, CompareParams
from driftscope.functions.planxml import INDICATORS
from driftscope.operators.shape import plan_indicators
from tests.test_compare import SIDES

HEAD = '<ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan">'


def plan(*nodes):
    return HEAD + "".join(nodes) + "</ShowPlanXML>"


def op(physical, logical=None, more="", inside=""):
    return f'<RelOp PhysicalOp="{physical}" LogicalOp="{logical or physical}"{more}>{inside}</RelOp>'


EVERYTHING = plan(
    "<MissingIndexes/>",
    op("Hash Match", "Inner Join", inside=op("Index Seek", inside=op("Index Seek") + op("Key Lookup"))),
    op("Hash Match", "Aggregate", ' EstimatedExecutionMode="Batch"'),
    op("Merge Join"), op("Nested Loops"), op("Parallelism"), op("Adaptive Join"), op("Index Scan"), op("Table Scan"),
    op("RID Lookup"), op("Sort"), op("Sort"), op("Stream Aggregate"), op("Table Spool"), op("Index Spool"),
    op("Filter"), op("Compute Scalar"),
    '<IndexScan Storage="ColumnStore"/>',
    '<MemoryGrantInfo RequestedMemory="10" GrantedMemory="20" UsedMemory="x"/><MemoryGrantInfo GrantedMemory="99"/>',
    "<Warnings><SpillToTempDb/><MemoryGrantWarning/><PlanAffectingConvert/><NoJoinPredicate/><MissingStatistics/></Warnings>",
)
EXPECTED = {
    "index_seek_count": 2, "index_scan_count": 1, "table_scan_count": 1, "key_lookup_count": 1, "rid_lookup_count": 1,
    "sort_count": 2, "hash_agg_count": 1, "stream_agg_count": 1, "spool_count": 2, "filter_count": 1,
    "compute_scalar_count": 1, "requested_memory_kb": 10, "granted_memory_kb": 20, "used_memory_kb": None,
}


def read(spark, plans, engine):
    frame = spark.createDataFrame([("L", i, p) for i, p in enumerate(plans)], "side string, plan_id bigint, query_plan string")
    found = plan_indicators(frame.select("side", "plan_id"), frame, CompareParams(), engine)
    return [r.asDict() for r in found.orderBy("plan_id").collect()]


@pytest.mark.parametrize("engine", ["xpath", "pandas"])
def test_indicators(spark, engine):
    full, empty, missing = read(spark, [EVERYTHING, plan(), None], engine)
    assert {i.name: full[i.name] for i in INDICATORS} == {i.name: EXPECTED.get(i.name, 1) for i in INDICATORS}
    assert all(empty[i.name] == (None if i.kind == "value" else 0) for i in INDICATORS)
    assert all(missing[i.name] is None for i in INDICATORS) and missing["plan_xml_hash"] is None
    assert bytes(full["plan_xml_hash"]) == hashlib.sha256(EVERYTHING.encode("utf-16-le")).digest()


def test_hash_aggregate_counts_as_hash_join(spark):
    row = read(spark, [plan(op("Hash Match", "Aggregate"))], "xpath")[0]
    assert (row["has_hash_join"], row["hash_agg_count"]) == (1, 1)


def test_malformed_xml(spark):
    for engine in ("pandas", "xpath"):
        bad, good = read(spark, ["<ShowPlanXML><RelOp", plan(op("Sort"))], engine)
        assert bad["sort_count"] is None and bad["has_spill"] is None and good["sort_count"] == 1


def test_unknown_engine(spark):
    with pytest.raises(ValueError):
        read(spark, [None], "regex")


LOW = [(1, 1, 1, 0, 20, 1), (2, 1, 1, 0, 5, 1), (3, 2, 0, 0, 20, 1), (4, 2, 0, 0, 5, 1)]
HIGH = [(1, 1, 1, 0, 20, 9), (3, 2, 0, 0, 20, 9)]


def shape(runs, low_xml, high_xml):
    from driftscope.sources.runs import union_runs
    run = union_runs(runs.side("L", LOW, xml=low_xml), runs.side("H", HIGH, xml=high_xml))
    return Comparison(run, CompareParams(min_exec=10), SIDES)


def test_difference_flags(runs):
    c = shape(runs, {1: plan(op("Index Seek")), 3: None}, {1: plan(op("Index Scan"), op("Hash Match")), 3: None})
    rows = {r.QueryType: r for r in c.shape_report().collect()}
    changed = rows["SP"]
    assert changed.DiffFlags == ("PLAN_SHAPE_CHANGED;INDEX_SEEK_COUNT_CHANGED;INDEX_SCAN_COUNT_CHANGED;JOIN_HASH_CHANGED;")
    assert (changed["IndexSeekCount_L-H"], changed["GrantedMemoryKB_L-H"]) == ("1 - 0", "? - ?")
    assert changed["PlanXml_CL120"] == plan(op("Index Seek"))
    # two unknown plans do not differ
    assert rows["Adhoc"].DiffFlags == "" and rows["Adhoc"]["PlanXmlHashHex_L-H"] == "? - ?"


def test_one_unknown_plan_differs(runs):
    c = shape(runs, {1: plan(), 3: plan()}, {3: plan()})
    rows = {r.QueryType: r for r in c.shape_report().collect()}
    flags = rows["SP"].DiffFlags
    # missing counts are -1, missing bits are 0
    assert flags.startswith("PLAN_SHAPE_CHANGED;INDEX_SEEK_COUNT_CHANGED;") and "JOIN_HASH_CHANGED" not in flags
    assert rows["Adhoc"].DiffFlags == ""


def test_objects_sharing_a_key_keep_one_pair(runs):
    """Two objects, one query hash: the more executed plan wins the key on each side."""
    low = [(1, 1, 1, 0, 20, 1), (2, 1, 1, 0, 20, 1), (3, 2, 2, 0, 90, 1), (4, 2, 2, 0, 20, 1)]
    high = [(1, 1, 1, 0, 20, 9), (3, 2, 2, 0, 90, 9)]
    c = Comparison(runs.both(low, high, hashes={1: b"h", 2: b"h"}), CompareParams(min_exec=10), SIDES)
    assert {r.obj_name for r in c.multi_plan_regressions.collect()} == {"dbo.p_one", "dbo.p_two"}
    assert [(r.obj_key, r.plan_id_l, r.plan_id_h) for r in c.multi_plan_pairs.collect()] == [("dbo.p_two", 3, 3)]
    assert [r.ObjName for r in c.shape_report().collect()] == ["dbo.p_two"]
    assert {r.ObjName for r in c.drilldown().select(F.col("ObjName")).collect()} == {"dbo.p_one", "dbo.p_two"}
