"""Statement events as a stream: classify, count, roll up.

The column functions are the batch ones.  Sinks are files in a shared folder,
which a restarted query continues from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftscope.folders import numbered
from driftscope.operators.capture import classify, executable, interval_rollup, replayable, rewrite

# Fixed value: interval length of the statistics.
INTERVAL = "1 minute"
BATCH = "batch"
SNAPSHOTS = "-snapshots"


def classified_stream(events: DataFrame, replay_type: int = 3) -> DataFrame:
    """Replayable events with kind and replay text.  Keeps no state."""
    return rewrite(classify(replayable(events, replay_type)))


def running_counts(events: DataFrame, *by: str) -> DataFrame:
    """Events per file and kind so far.  State: one count per group."""
    return executable(classify(replayable(events))).groupBy(*(by or ("file_name", "kind"))).count()


def rollup_stream(events: DataFrame, *key: str, interval: str = INTERVAL, delay: str | None = None) -> DataFrame:
    """Executions and averages per statement and interval, as they stand.

    Late events change their interval, however late they are; the state is one
    row per statement and interval.  ``delay`` bounds it to the intervals still
    open and drops events that come later than that.
    """
    return interval_rollup(events if delay is None else events.withWatermark("ts", delay), *key, interval=interval)


def to_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finished rows to parquet files."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def changes_to_files(changing: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                     key: Sequence[str] = (), every: int = 16) -> StreamingQuery:
    """Write the rows that a batch changed to a folder of its own.

    A batch that is written again replaces its own folder only; readers of
    earlier batches are not disturbed.  ``newest`` reads the present state.
    With ``key``, every so many batches the state so far is written beside them
    as a snapshot, which spares ``newest`` the batches before it.  Those stay
    where they are; nothing reads them any more once a later snapshot is there.
    """
    if every < 1:
        raise ValueError("every must be at least 1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
        if key and (number + 1) % every == 0:
            state = _state(batch.sparkSession, path, key, number)
            state.write.mode("overwrite").parquet(f"{path}{SNAPSHOTS}/{BATCH}={number}")

    writer = (changing.writeStream.outputMode("update").foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _state(spark: SparkSession, path: str, key: Sequence[str], last: int | None = None) -> DataFrame:
    """Of each key the row of its latest batch, up to ``last``, with that batch.

    Read from the latest finished snapshot before ``last`` and what follows it.
    """
    whole = [n for n in numbered(spark, path + SNAPSHOTS, BATCH, finished=True) if last is None or n < last]
    start = whole[-1] if whole else -1
    later = [n for n in numbered(spark, path, BATCH) if n > start and (last is None or n <= last)]
    parts = []
    if whole:
        # read as a folder of its own, so the batch is the stored column
        parts.append(spark.read.parquet(f"{path}{SNAPSHOTS}/{BATCH}={start}"))
    if later or not whole:
        changed = spark.read.option("basePath", path)
        parts.append(changed.parquet(*[f"{path}/{BATCH}={n}" for n in later] or [path])
                     .withColumn(BATCH, F.col(BATCH).cast("bigint")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rest = [c for c in rows.columns if c not in (*key, BATCH)]
    latest = rows.groupBy(*key).agg(F.max(F.struct(BATCH, *rest)).alias("latest"))
    return latest.select(*key, *[F.col(f"latest.{c}").alias(c) for c in (*rest, BATCH)])


def newest(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """Of each key the row of the latest batch that changed it."""
    return _state(spark, path, key).drop(BATCH)
