"""Captured statement events, already decoded to JSON or parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# file_name and file_created are added on reading if the events lack them
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("database_id", T.IntegerType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("object_name", T.StringType()),
    T.StructField("statement", T.StringType()),
    T.StructField("batch_text", T.StringType()),
    T.StructField("duration", T.DecimalType(18, 2)),
    T.StructField("succeeded", T.IntegerType()),
])


def with_file_facts(events: DataFrame) -> DataFrame:
    """Name and time of the file an event was read from."""
    return events.select(
        "*",
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_modification_time").alias("file_created"),
    )


def load_events(spark: SparkSession, path: str, format: str = "parquet",
                schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """A folder of capture files as one frame.

    The order of files, by time, is kept as a column for steps that need it;
    the files are read in parallel.
    """
    return with_file_facts(spark.read.schema(schema).format(format).load(path))


def stream_events(spark: SparkSession, path: str, format: str = "parquet",
                  schema: T.StructType = EVENT_SCHEMA, **options: str) -> DataFrame:
    """The same folder as a stream of files while a capture is running."""
    return with_file_facts(spark.readStream.schema(schema).format(format).options(**options).load(path))
