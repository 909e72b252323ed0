"""Run statistics, captured events and demo tables derived from the given tables.

The rules depend on keys only.  ``contract.oracle`` states the same rules in
SQL.  Times are taken as they are stored, in the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftscope.sources.runs import Run
from driftscope.sources.sides import Sides

# Names and levels the reports show for the two sides.
SIDES = Sides("RunF", "RunO", 120, 170)
MONEY = "decimal(18,2)"


_tables: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read once per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _tables:
        _tables[key] = spark.read.parquet(path)
    return _tables[key]


BOTH_SIDES = "explode(array('L', 'H')) AS side"
PART_QUARTER = "floor(p_partkey / 4)"
# parts whose lines all go to one side, so that some groups are missing on the other
LINE_SIDE = """CASE WHEN l_partkey % 50 IN (14, 15) THEN 'H' WHEN l_partkey % 50 IN (22, 23) THEN 'L'
 WHEN l_linestatus = 'F' THEN 'L' ELSE 'H' END AS side"""

# Names of operators, attributes and warnings in plan XML.
# Sample plans: (condition, XML), said once for Spark and for SQL.  An element
# that stays open is closed by a later entry with the same condition.
PLAN_XML = (
    ("true", '<ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan">'),
    ("side = 'H' AND p_partkey % 3 = 0", '<RelOp PhysicalOp="Parallelism" LogicalOp="Gather Streams">'),
    ("d = 0", '<RelOp PhysicalOp="Index Seek" LogicalOp="Index Seek"/>'),
    ("d = 1", '<RelOp PhysicalOp="Index Scan" LogicalOp="Index Scan" EstimatedExecutionMode="Batch"/>'),
    ("d = 2", '<RelOp PhysicalOp="Table Scan" LogicalOp="Table Scan"><RelOp PhysicalOp="Sort" LogicalOp="Sort"/></RelOp>'),
    ("side = 'L' AND p_partkey % 4 = 0", '<RelOp PhysicalOp="Index Seek" LogicalOp="Index Seek"/>'),
    ("side = 'H' AND p_partkey % 10 = 7", '<RelOp PhysicalOp="Index Scan" LogicalOp="Index Scan" EstimatedExecutionMode="Batch"/>'),
    ("side = 'L' AND p_partkey % 10 = 3", '<RelOp PhysicalOp="Table Scan" LogicalOp="Table Scan"/>'),
    ("side = 'H' AND p_partkey % 11 = 1", '<RelOp PhysicalOp="Sort" LogicalOp="Distinct Sort"/>'),
    ("side = 'H' AND p_partkey % 5 = 0", '<RelOp PhysicalOp="Hash Match" LogicalOp="Aggregate"/>'),
    ("side = 'L' AND p_partkey % 5 = 1", '<RelOp PhysicalOp="Hash Match" LogicalOp="Inner Join"/>'),
    ("side = 'H' AND p_partkey % 4 = 1", '<RelOp PhysicalOp="Merge Join" LogicalOp="Inner Join"/>'),
    ("side = 'L' AND p_partkey % 4 = 2", '<RelOp PhysicalOp="Nested Loops" LogicalOp="Inner Join"/>'),
    ("side = 'L' AND p_partkey % 6 = 1", '<RelOp PhysicalOp="Key Lookup" LogicalOp="Key Lookup"/>'),
    ("side = 'H' AND p_partkey % 6 = 2", '<RelOp PhysicalOp="RID Lookup" LogicalOp="RID Lookup"/>'),
    ("side = 'H' AND p_partkey % 6 = 3", '<RelOp PhysicalOp="Stream Aggregate" LogicalOp="Aggregate"/>'),
    ("side = 'L' AND p_partkey % 6 = 4", '<RelOp PhysicalOp="Table Spool" LogicalOp="Lazy Spool"/>'),
    ("side = 'L' AND p_partkey % 8 = 4", '<RelOp PhysicalOp="Index Spool" LogicalOp="Eager Spool"/>'),
    ("side = 'H' AND p_partkey % 6 = 5", '<RelOp PhysicalOp="Filter" LogicalOp="Filter"/>'),
    ("side = 'L' AND p_partkey % 7 = 1", '<RelOp PhysicalOp="Compute Scalar" LogicalOp="Compute Scalar"/>'),
    ("side = 'H' AND p_partkey % 7 = 2", '<RelOp PhysicalOp="Adaptive Join" LogicalOp="Inner Join"/>'),
    ("side = 'H' AND p_partkey % 7 = 3", '<RelOp PhysicalOp="Columnstore" LogicalOp="Scan"><IndexScan Storage="ColumnStore"/></RelOp>'),
    ("side = 'L' AND p_partkey % 7 = 4", '<MissingIndexes><MissingIndexGroup Impact="90"/></MissingIndexes>'),
    ("side = 'H' AND p_partkey % 7 = 0", "<Warnings><SpillToTempDb/></Warnings>"),
    ("side = 'L' AND p_partkey % 7 = 5", "<Warnings><MemoryGrantWarning/><NoJoinPredicate/></Warnings>"),
    ("side = 'H' AND p_partkey % 7 = 6", "<Warnings><PlanAffectingConvert/></Warnings>"),
    ("side = 'H' AND p_partkey % 9 = 0", "<Warnings><MissingStatistics/></Warnings>"),
    ("side = 'H' AND p_partkey % 3 = 0", "</RelOp>"),
    ("p_size % 8 = 0", '<MemoryGrantInfo GrantedMemory="0"/>'),
    ("p_size % 8 = 1", '<MemoryGrantInfo GrantedMemory="1024"/>'),
    ("p_size % 8 = 2 AND side = 'H'", '<MemoryGrantInfo GrantedMemory="2048" RequestedMemory="4096" UsedMemory="512"/>'),
    ("p_size % 8 = 2 AND side = 'L'", '<MemoryGrantInfo GrantedMemory="1024" RequestedMemory="2048" UsedMemory="256"/>'),
    ("p_size % 8 > 2 AND side = 'L'", '<MemoryGrantInfo GrantedMemory="4096"/>'),
    ("p_size % 8 > 2 AND side = 'H'", '<MemoryGrantInfo GrantedMemory="8192"/>'),
    ("p_size % 2 = 0", '<MemoryGrantInfo GrantedMemory="77" RequestedMemory="88" UsedMemory="99"/>'),
    ("p_partkey % 89 <> 0", "</ShowPlanXML>"),  # the others end too early
)


def plan_xml() -> str:
    """The derived plans' XML in SQL that both engines read; some have none."""
    parts = ", ".join(f"CASE WHEN {condition} THEN '{xml}' ELSE '' END" for condition, xml in PLAN_XML)
    return f"CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE concat({parts}) END"


MONTH = "cast(year(l_shipdate) * 12 + month(l_shipdate) AS bigint) AS runtime_stats_interval_id"


def derived_run(spark: SparkSession, sf_dir: str) -> Run:
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return Run(
        runtime_stats=_runtime_stats(lineitem), interval=_intervals(lineitem), plan=_plans(part),
        query=_queries(part), query_text=_texts(part),
        objects=table(spark, sf_dir, "nation").selectExpr(
            BOTH_SIDES, "cast(n_nationkey + 1 AS int) AS object_id", "n_name AS name", "n_regionkey AS schema_id"),
        schemas=table(spark, sf_dir, "region").selectExpr(BOTH_SIDES, "r_regionkey AS schema_id", "r_name AS name"),
    )


def _runtime_stats(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        LINE_SIDE,
        "l_partkey * 10 + if(floor(l_partkey / 4) % 3 = 0, 0, l_linenumber % 3) AS plan_id",
        MONTH,
        "1 AS replica_group_id",
        "cast(l_quantity AS bigint) AS count_executions",
        f"if(l_partkey % 50 IN (26, 27) AND l_linestatus = 'F', cast(0 AS {MONEY}), cast(l_extendedprice AS {MONEY}))"
        " AS avg_logical_io_reads",
        f"cast(cast(cast(l_discount AS {MONEY}) * 100 AS bigint) + 1 AS {MONEY}) AS avg_cpu_time",
        f"cast(cast(cast(l_tax AS {MONEY}) * 100 AS bigint) * 10 + l_linenumber AS {MONEY}) AS avg_duration",
    )


def _intervals(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(LINE_SIDE, MONTH, "date_trunc('month', l_shipdate) AS start_time").distinct().selectExpr(
        "*", "start_time + INTERVAL '1' MONTH AS end_time")


def _plans(part: DataFrame) -> DataFrame:
    return part.selectExpr("p_partkey", "p_size", BOTH_SIDES).selectExpr(
        "*", "explode(array(0, 1, 2)) AS d"
    ).selectExpr(
        "side", "p_partkey * 10 + d AS plan_id", "p_partkey AS query_id",
        f"{plan_xml()} AS query_plan",
    )


def _queries(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        BOTH_SIDES, "p_partkey AS query_id", "p_partkey AS query_text_id",
        f"if({PART_QUARTER} % 3 = 0, 1000000000 + p_partkey, floor(p_partkey / 2)) AS query_hash",
        f"""cast(CASE {PART_QUARTER} % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE {PART_QUARTER} % 25 + 1 END AS int)
            AS object_id""",
        "if(p_partkey % 61 = 0, 1, 0) AS is_internal_query",
    )


def _texts(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        BOTH_SIDES, "p_partkey AS query_text_id",
        f"""concat(CASE {PART_QUARTER} % 7 WHEN 0 THEN 'SELECT * FROM t' WHEN 1 THEN '(@p int)SELECT c FROM t'
             WHEN 2 THEN 'INSERT INTO t' WHEN 3 THEN 'UPDATE t' WHEN 4 THEN 'DELETE FROM t'
             WHEN 5 THEN 'WITH c AS (SELECT 1 AS x) UPDATE t' ELSE 'MERGE t' END,
            if(p_partkey % 2 = 0, ' ', char(9)), 'K',
            cast(if({PART_QUARTER} % 10 = 0, {PART_QUARTER}, floor(p_partkey / 2)) AS string)) AS query_sql_text""",
    )


def captured_events(events: DataFrame) -> DataFrame:
    """Batch frame or stream of ``events`` as statement events."""
    return events.selectExpr(
        "event_id", "cast(ts AS timestamp) AS ts", "user_id AS session_id",
        "cast(floor(cast(regexp_extract(props, '[0-9]+', 0) AS int) / 25) AS int) AS database_id",
        """if(event_type = 'error', 'cap_00.xel', concat('cap_', lpad(cast(day(ts) AS string), 2, '0'), '.xel'))
            AS file_name""",
        """CASE WHEN event_type IN ('click', 'purchase') THEN 'rpc_completed'
            WHEN event_type IN ('view', 'signup') THEN 'sql_batch_completed' ELSE 'attention' END AS event_name""",
        """CASE WHEN event_type = 'click' AND user_id % 5 = 0 THEN 'sp_executesql' WHEN event_type = 'click' THEN
            'sp_UpdateUser' WHEN event_type = 'purchase' THEN 'sp_AddOrder' END AS object_name""",
        """CASE WHEN event_type NOT IN ('click', 'purchase') THEN NULL
            WHEN event_id % 33 = 0 THEN 'EXEC Sp_Reset_Connection;'
            WHEN event_id % 11 = 0 THEN 'exec sp_reset_connection'
            WHEN event_type = 'click' AND user_id % 5 = 0 THEN concat("exec sp_executesql N'SELECT ", user_id, "'")
            WHEN event_type = 'click' THEN
             concat('exec dbo.sp_UpdateUser @UserID=', user_id, ",@NewLastName=N'Doe',@NewFirstName=Jo")
            WHEN user_id % 7 = 0 THEN concat('declare @o int exec dbo.sp_AddOrder @UserID=', user_id)
            ELSE concat('exec dbo.sp_AddOrder @UserID=', user_id, ',@OrderDate=2023-01-01') END AS statement""",
        """CASE WHEN event_type NOT IN ('view', 'signup') THEN NULL
            WHEN event_id % 13 = 0 THEN 'EXEC sp_reset_connection'
            ELSE concat('SELECT * FROM t WHERE k=', user_id, ';') END AS batch_text""",
        f"cast(value AS {MONEY}) AS duration", "if(value <= 40, 1, 0) AS succeeded",
    )


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured_events(table(spark, sf_dir, "events"))


def derived_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return captured_events(stream)
