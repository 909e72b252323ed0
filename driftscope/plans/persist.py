"""Keep the regressions of a run as a table or as files.

A history has one partition per run.  What tells the run, such as its inputs and
parameters, makes the run id, so that a run that is repeated, after a failure for
instance, replaces its own rows and no others.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftscope.params import ParameterError, check_table_name

RUN_ID = "RunId"
_DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


def run_id(run: Mapping[str, object] | None = None) -> str:
    """The id of a run: of equal descriptions the same, without one a new one."""
    if run is None:
        return f"run-{uuid.uuid4().hex}"
    text = json.dumps({str(k): str(v) for k, v in run.items()}, sort_keys=True)
    return f"run-{hashlib.sha256(text.encode()).hexdigest()[:32]}"


def save_table(rows: DataFrame, table: str, history: bool = False, run: Mapping[str, object] | None = None) -> str | None:
    """Write result rows to ``schema.table``.

    The default replaces the table.  ``history`` keeps other runs, in a table
    partitioned by run id, which is returned; ``run`` says what tells this one.
    """
    check_table_name(table)
    if not history:
        rows.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)
        return None
    spark, id = rows.sparkSession, run_id(run)
    marked = rows.withColumn(RUN_ID, F.lit(id))
    if not spark.catalog.tableExists(table):
        marked.write.partitionBy(RUN_ID).saveAsTable(table)
        return id
    if [c.name for c in spark.catalog.listColumns(table) if c.isPartition] != [RUN_ID]:
        raise ParameterError("results_table", f"{table} is no history: it is not partitioned by {RUN_ID}")
    before = spark.conf.get(_DYNAMIC)
    spark.conf.set(_DYNAMIC, "dynamic")
    try:
        marked.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(_DYNAMIC, before)
    return id


def save_files(rows: DataFrame, path: str, history: bool = False, format: str = "parquet",
               run: Mapping[str, object] | None = None) -> str | None:
    """The same for a folder."""
    if not history:
        rows.write.format(format).mode("overwrite").save(path)
        return None
    id = run_id(run)
    rows.withColumn(RUN_ID, F.lit(id)).write.format(format).mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(RUN_ID).save(path)
    return id
