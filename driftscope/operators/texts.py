"""Text features, computed once per text and only for texts in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftscope.functions.text import head, normalize, statement_type, text_digest
from driftscope.params import CompareParams


def text_features(query_text: DataFrame, p: CompareParams, ids: DataFrame | None = None) -> DataFrame:
    """Samples and digests of texts, and their statement type if p filters by it.

    ``ids`` (side, query_text_id) restricts the texts before any is hashed;
    repeated ids do no harm.
    """
    texts = query_text
    if ids is not None:
        texts = texts.join(ids.select("side", "query_text_id"), ["side", "query_text_id"], "left_semi")
    text = F.col("query_sql_text")
    normal = normalize(text, p.key_chars, p.compact)
    columns = [
        "side",
        "query_text_id",
        head(text, p.sample_chars).alias("query_text_sample"),
        head(normal, p.sample_chars).alias("normalized_sample"),
        text_digest(head(text, p.key_chars), p.charset).alias("query_text_hash"),
        text_digest(normal, p.charset).alias("normalized_hash"),
    ]
    if p.statement_type != "ALL":
        columns.append(statement_type(text, p.key_chars).alias("detected_type"))
    return texts.select(*columns)
