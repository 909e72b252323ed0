"""What a query plan's XML tells: operator counts, presence bits, memory.

The XML uses one default namespace, which Spark's XPath functions ignore.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# cannot occur in XML, not even as a character reference
_SEPARATOR = "\x1f"
# Java's XPath compiler accepts about 100 operators in one expression
_PER_XPATH = 14


@dataclass(frozen=True)
class Indicator:
    """One fact about a plan, and the flag raised when it differs by side.

    ``kind``: "count" of nodes, "bit" for their presence, "value" of the first.
    ``shown`` is the report column, None for facts the report leaves out.
    """

    name: str
    kind: str
    xpath: str
    flag: str
    shown: str | None

    @property
    def missing(self) -> int:
        """What a missing indicator counts as when sides are compared."""
        return 0 if self.kind == "bit" else -1


def _operator(name: str) -> str:
    return f'//RelOp[@PhysicalOp="{name}"]'


# Indicator names, the nodes they look at, and the flags, in the
# order in which flags are reported.
INDICATORS = (
    Indicator("index_seek_count", "count", _operator("Index Seek"), "INDEX_SEEK_COUNT_CHANGED", "IndexSeekCount"),
    Indicator("index_scan_count", "count", _operator("Index Scan"), "INDEX_SCAN_COUNT_CHANGED", "IndexScanCount"),
    Indicator("table_scan_count", "count", _operator("Table Scan"), "TABLE_SCAN_COUNT_CHANGED", "TableScanCount"),
    Indicator("has_hash_join", "bit", _operator("Hash Match"), "JOIN_HASH_CHANGED", "HasHashJoin"),
    Indicator("has_merge_join", "bit", _operator("Merge Join"), "JOIN_MERGE_CHANGED", "HasMergeJoin"),
    Indicator("has_nested_loops", "bit", _operator("Nested Loops"), "JOIN_NL_CHANGED", "HasNestedLoops"),
    Indicator("has_parallelism", "bit", _operator("Parallelism"), "PARALLELISM_CHANGED", "HasParallelism"),
    Indicator("has_spill", "bit", "//Warnings/SpillToTempDb", "SPILL_CHANGED", "SpillToTempDb"),
    Indicator("has_missing_index", "bit", "//MissingIndexes", "MISSING_INDEX_CHANGED", "MissingIndex"),
    Indicator("key_lookup_count", "count", _operator("Key Lookup"), "KEY_LOOKUP_COUNT_CHANGED", "KeyLookupCount"),
    Indicator("rid_lookup_count", "count", _operator("RID Lookup"), "RID_LOOKUP_COUNT_CHANGED", "RIDLookupCount"),
    Indicator("sort_count", "count", _operator("Sort"), "SORT_COUNT_CHANGED", "SortCount"),
    Indicator("hash_agg_count", "count", '//RelOp[@LogicalOp="Aggregate" and @PhysicalOp="Hash Match"]',
              "HASH_AGG_COUNT_CHANGED", "HashAggCount"),
    Indicator("stream_agg_count", "count", _operator("Stream Aggregate"), "STREAM_AGG_COUNT_CHANGED",
              "StreamAggCount"),
    Indicator("spool_count", "count", '//RelOp[contains(@PhysicalOp,"Spool")]', "SPOOL_COUNT_CHANGED",
              "SpoolCount"),
    Indicator("filter_count", "count", _operator("Filter"), "FILTER_COUNT_CHANGED", "FilterCount"),
    Indicator("compute_scalar_count", "count", _operator("Compute Scalar"), "COMPUTE_SCALAR_COUNT_CHANGED",
              "ComputeScalarCount"),
    Indicator("has_adaptive_join", "bit", _operator("Adaptive Join"), "ADAPTIVE_JOIN_CHANGED", "HasAdaptiveJoin"),
    Indicator("has_batch_mode", "bit", '//RelOp[@EstimatedExecutionMode="Batch"]', "BATCH_MODE_CHANGED",
              "HasBatchMode"),
    Indicator("has_columnstore", "bit", '//IndexScan[@Storage="ColumnStore"]|//IndexSeek[@Storage="ColumnStore"]',
              "COLUMNSTORE_USAGE_CHANGED", "HasColumnstore"),
    Indicator("requested_memory_kb", "value", "//MemoryGrantInfo/@RequestedMemory", "REQUESTED_MEMORY_CHANGED", None),
    Indicator("granted_memory_kb", "value", "//MemoryGrantInfo/@GrantedMemory", "GRANTED_MEMORY_CHANGED",
              "GrantedMemoryKB"),
    Indicator("used_memory_kb", "value", "//MemoryGrantInfo/@UsedMemory", "USED_MEMORY_CHANGED", None),
    Indicator("has_memory_grant_warning", "bit", "//Warnings/MemoryGrantWarning", "MEMORY_GRANT_WARNING_CHANGED",
              "MemoryGrantWarning"),
    Indicator("has_implicit_conversion", "bit", "//Warnings/PlanAffectingConvert", "IMPLICIT_CONVERSION_CHANGED",
              "ImplicitConversion"),
    Indicator("has_no_join_predicate", "bit", "//Warnings/NoJoinPredicate", "NO_JOIN_PREDICATE_WARN_CHANGED",
              "NoJoinPredicateWarn"),
    Indicator("has_missing_stats", "bit", "//Warnings/MissingStatistics", "MISSING_STATS_WARN_CHANGED",
              "MissingStatsWarn"),
)
SHAPE_FLAG = "PLAN_SHAPE_CHANGED"


def _sql_type(indicator: Indicator) -> str:
    return "bigint" if indicator.kind == "value" else "int"


def _term(indicator: Indicator) -> str:
    if indicator.kind == "count":
        return f"count({indicator.xpath})"
    if indicator.kind == "bit":
        return f"number(boolean({indicator.xpath}))"
    return f"({indicator.xpath})[1]"


def well_formed(xml: str) -> str:
    """The XML column where it can be parsed, else NULL, as SQL text."""
    return f"if(from_xml({xml}, '_corrupt_record string', map('mode', 'PERMISSIVE'))._corrupt_record IS NULL, {xml}, NULL)"


def indicator_columns(xml: str) -> list[str]:
    """All indicators of an XML column with Spark's own XPath, as SQL texts.

    One XPath asks for many of them at once, so a plan is parsed once per XPath
    and not once per indicator.  No XML gives NULLs; malformed XML is an error,
    so pass a column of ``well_formed`` XML.
    """
    columns = []
    for first in range(0, len(INDICATORS), _PER_XPATH):
        some = INDICATORS[first:first + _PER_XPATH]
        wanted = f',"{_SEPARATOR}",'.join(_term(i) for i in some)
        found = f"split(xpath_string({xml}, 'concat({wanted})'), '{_SEPARATOR}')"
        columns += [f"try_cast({found}[{n}] AS {_sql_type(i)}) AS {i.name}" for n, i in enumerate(some)]
    return columns


def tolerant_indicators(xml: Column) -> Column:
    """The same as one struct, with NULLs for malformed XML instead of an error."""
    return _checked(xml)


_STRUCT = T.StructType([
    T.StructField(i.name, T.LongType() if i.kind == "value" else T.IntegerType()) for i in INDICATORS
])


@F.pandas_udf(_STRUCT)
def _checked(plans: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(plan) for plan in plans], columns=[i.name for i in INDICATORS], dtype=object)


# where the walk over a plan looks for each indicator
_BY_OPERATOR = {i.xpath.split('"')[1]: i.name for i in INDICATORS if i.xpath.startswith("//RelOp[@PhysicalOp=")}
_BY_WARNING = {i.xpath.rpartition("/")[2]: i.name for i in INDICATORS if i.xpath.startswith("//Warnings/")}
_BY_MEMORY = {i.xpath.rpartition("@")[2]: i.name for i in INDICATORS if i.kind == "value"}


def _read(plan: str | None) -> list[int | None]:
    """All indicators of one plan in one walk over its tree."""
    import xml.etree.ElementTree as ET

    if plan is None:
        return [None] * len(INDICATORS)
    try:
        root = ET.fromstring(plan)
    except ET.ParseError:
        return [None] * len(INDICATORS)
    found: dict[str, int | None] = {i.name: None if i.kind == "value" else 0 for i in INDICATORS}

    def count(name: str | None) -> None:
        if name:
            found[name] += 1

    waiting, memory = [root], dict(_BY_MEMORY)
    while waiting:
        node = waiting.pop()
        children = list(node)
        waiting += reversed(children)  # first things first
        tag = node.tag.rpartition("}")[2]
        if tag == "RelOp":
            operator = node.get("PhysicalOp", "")
            count(_BY_OPERATOR.get(operator))
            count("hash_agg_count" if operator == "Hash Match" and node.get("LogicalOp") == "Aggregate" else None)
            count("spool_count" if "Spool" in operator else None)
            count("has_batch_mode" if node.get("EstimatedExecutionMode") == "Batch" else None)
        elif tag in ("IndexScan", "IndexSeek"):
            count("has_columnstore" if node.get("Storage") == "ColumnStore" else None)
        elif tag == "MissingIndexes":
            count("has_missing_index")
        elif tag == "MemoryGrantInfo":
            for attribute in [a for a in memory if node.get(a) is not None]:
                value = node.get(attribute).strip()
                found[memory.pop(attribute)] = int(value) if value.lstrip("+-").isdigit() else None
        elif tag == "Warnings":
            for child in children:
                count(_BY_WARNING.get(child.tag.rpartition("}")[2]))
    return [min(1, found[i.name]) if i.kind == "bit" else found[i.name] for i in INDICATORS]
