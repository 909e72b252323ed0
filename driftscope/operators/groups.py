"""From plans to logical queries: identity of a plan's query, totals per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftscope.functions.report import TOTAL, weighted_average
from driftscope.operators.texts import text_features
from driftscope.params import CompareParams
from driftscope.sources.runs import Run

# (key, type, name) names a group; obj_key is the name with '' for none, so the
# three can be compared with plain equality.
GROUP = ["group_key", "query_type", "obj_key"]

_METRIC_COLUMN = {"LogicalReads": "reads", "CPU": "cpu", "Duration": "dur"}


def metric_column(kind: str, p: CompareParams) -> str:
    """``total_…`` or ``avg_…`` column of the chosen metric."""
    return f"{kind}_{_METRIC_COLUMN[p.metric]}"


def hash_bytes(df: DataFrame, column: str = "query_hash") -> str:
    """The query hash as 8 bytes, whether it is stored as binary or as a number."""
    if isinstance(df.schema[column].dataType, T.BinaryType):
        return column
    return f"unhex(lpad(hex(cast({column} AS bigint)), 16, '0'))"


def group_key(df: DataFrame, p: CompareParams) -> str:
    """SHA-256 of what identifies a query under the chosen grouping."""
    if p.group_by == "QueryHash":
        return f"unhex(sha2({hash_bytes(df)}, 256))"
    return "query_text_hash" if p.group_by == "QueryText" else "normalized_hash"


def object_names(objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """side, object_id and ``schema.name``; no name if the schema is unknown."""
    named = schemas.selectExpr("side", "schema_id", "name AS schema_name")
    return objects.join(named, ["side", "schema_id"], "left").selectExpr(
        "side", "object_id", "concat(schema_name, '.', name) AS full_name")


def identify(plans: DataFrame, run: Run, p: CompareParams) -> DataFrame:
    """Give every plan its group: key, query type and object name.

    Also attaches the text sample and ``candidate``, the struct whose maximum
    is the most executed plan.  Columns nobody asks for later are pruned, text
    included.  The join itself keeps texts in use; restricting them beforehand
    would compute the plans twice.  Texts have no bound and are merged, never
    sent to all tasks.
    """
    texts = text_features(run.query_text, p)
    if p.statement_type != "ALL":
        texts = texts.where(f"detected_type = '{p.statement_type}'")
    known = plans.join(texts.hint("merge"), ["side", "query_text_id"]).join(
        object_names(run.objects, run.schemas), ["side", "object_id"], "left"
    )
    average = metric_column("avg", p)
    return known.selectExpr(
        *plans.columns,
        "if(object_id > 0, 'SP', 'Adhoc') AS query_type",
        "if(object_id > 0, full_name, NULL) AS obj_name",
        "coalesce(if(object_id > 0, full_name, NULL), '') AS obj_key",
        f"{group_key(known, p)} AS group_key",
        "query_text_sample",
        f"{metric_column('total', p)} AS total_metric",
        f"{average} AS avg_metric",
        f"struct(sum_exec, {average} AS avg_metric, plan_id, query_id) AS candidate",
    )


def group_stats(identified: DataFrame, p: CompareParams) -> DataFrame:
    """Totals per side and group, with averages weighted anew.

    One row per side, key, type and name, so that a side can meet the other
    once only; with ``split_by_hash`` one row per query hash as well.  A plan
    occurs once per side here, which makes counting plans the same as counting
    distinct ones.
    """
    keys = ["side", "query_type", "obj_name", "obj_key", "group_key"]
    split = ["query_hash"] if p.split_by_hash else []
    merged = [f"min({c}) AS {c}" for c in ("query_hash", "object_id") if c not in split]
    totals = identified.groupBy(*keys, *split).agg(*map(F.expr, (
        *merged,
        "min(query_text_sample) AS query_text_sample",
        "min(query_id) AS query_id_min",
        "max(query_id) AS query_id_max",
        "cast(count(plan_id) AS int) AS plan_count",
        "sum(sum_exec) AS exec_count",
        f"cast(sum(total_metric) AS {TOTAL}) AS total_metric",
        f"cast(sum(total_dur) AS {TOTAL}) AS total_duration",
        "min(interval_start_min) AS interval_start_min",
        "max(interval_end_max) AS interval_end_max",
        "max(candidate) AS candidate",
    )))
    return totals.selectExpr(
        *keys, "query_hash", "object_id", "query_text_sample", "query_id_min", "query_id_max",
        "plan_count", "exec_count",
        "total_metric", f"{weighted_average('total_metric', 'exec_count')} AS avg_metric",
        "total_duration", f"{weighted_average('total_duration', 'exec_count')} AS avg_duration",
        "interval_start_min", "interval_end_max", "candidate",
    )
