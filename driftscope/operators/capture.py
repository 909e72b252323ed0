"""Captured events: filters, classification, rewriting, counts, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftscope.functions import statement as st
from driftscope.operators.numbering import WIDTH, block, block_offsets
from driftscope.params import ParameterError
from driftscope.session import work_dir

# What the capture and the replay can be limited to.
COLLECT_TYPES = {
    "sp": (st.RPC_EVENT,),
    "adhoc": (st.BATCH_EVENT,),
    "sp-and-adhoc": (st.RPC_EVENT, st.BATCH_EVENT),
}
REPLAY_TYPES = {1: (st.RPC_EVENT,), 2: (st.BATCH_EVENT,), 3: (st.RPC_EVENT, st.BATCH_EVENT)}


class NoReplayableEvents(ValueError):
    """Not one capture file has a call or batch event."""


def restrict_capture(events: DataFrame, database_id: int, collect_type: str = "sp-and-adhoc") -> DataFrame:
    """Events of one database and of the collected kinds."""
    if collect_type not in COLLECT_TYPES:
        raise ParameterError("collect_type", f"{collect_type!r} is not one of {', '.join(COLLECT_TYPES)}")
    return events.where(
        (F.col("database_id") == database_id) & F.lower("event_name").isin(*COLLECT_TYPES[collect_type])
    )


def replayable(events: DataFrame, replay_type: int = 3) -> DataFrame:
    """Events of the replayed kinds, without connection resets."""
    if replay_type not in REPLAY_TYPES:
        raise ParameterError("replay_type", f"{replay_type!r} is not 1, 2 or 3")
    return events.where(F.lower("event_name").isin(*REPLAY_TYPES[replay_type])).where(~st.is_reset())


_CALL_COLUMNS = {"event_name", "object_name", "statement", "batch_text"}


def executable(events: DataFrame) -> DataFrame:
    """Events that are run again: not the calls of the reset procedure, however they are written.

    Counts, order, roll-ups and rewritten statements all use this rule, so they
    agree.  Frames without the columns of statements are left as they are.
    """
    if not _CALL_COLUMNS <= set(events.columns):
        return events
    name = F.lower(st.procedure_name(st.event_text()))
    return events.where(~(st.mentions_reset() & (st.kind() == st.SP) & name.eqNullSafe(F.lit(st.RESET_NAME))))


def classify(events: DataFrame) -> DataFrame:
    """Add ``kind`` and ``sql_text``, the text the event ran."""
    return events.withColumns({"kind": st.kind(), "sql_text": st.event_text()})


def rewrite(classified: DataFrame) -> DataFrame:
    """Add ``replay_text`` to the executable events."""
    text = F.col("sql_text")
    call = F.col("kind") == st.SP
    return executable(classified).withColumn(
        "replay_text", F.when(call, st.rewritten_call(text)).otherwise(st.rewritten_batch(text))
    )


def call_parameters(classified: DataFrame, *keep: str) -> DataFrame:
    """One row per parameter of a call: position, name and value as captured."""
    calls = classified.where(F.col("kind") == st.SP)
    return calls.select(
        *keep,
        st.procedure_name(F.col("sql_text")).alias("procedure_name"),
        F.posexplode(st.procedure_arguments(F.col("sql_text"))).alias("position", "argument"),
    ).select(
        *keep, "procedure_name", "position",
        F.col("argument.name").alias("parameter_name"), F.col("argument.value").alias("parameter_value"),
    )


def counts_by_file(events: DataFrame, file: str = "file_name") -> DataFrame:
    """Countable events per file, whatever is replayed: calls, batches, all."""
    rpc = st.is_rpc() & ~st.is_reset()
    batch = st.is_batch() & ~st.is_reset()
    return events.groupBy(file).agg(
        F.count_if(rpc).alias("rpc_count"),
        F.count_if(batch).alias("batch_count"),
        F.count_if(rpc | batch).alias("total_count"),
        F.count_if(st.is_rpc() | st.is_batch()).alias("seen_count"),
    )


def files_without_events(events: DataFrame, file: str = "file_name") -> DataFrame:
    """Files in which no call and no batch was captured, resets included."""
    return counts_by_file(events, file).where(F.col("seen_count") == 0).select(file)


def require_events(events: DataFrame) -> None:
    """Fail if no file has a call or a batch; reads until the first one found."""
    if events.where(st.is_rpc() | st.is_batch()).select(F.lit(1)).isEmpty():
        raise NoReplayableEvents("no call or batch event in any capture file")


def sequence(events: DataFrame, file: str = "file_name", created: str = "file_created",
             order_id: str = "event_id", width: int = WIDTH) -> DataFrame:
    """Global position and cumulative share of each event, files by creation time.

    Within a file events keep their order, given by ``order_id``.  The percent
    is cut to a whole number.  The events are read, filtered and shuffled once,
    on (file, block of ids), and written below the shared folder with their
    position in the block; what is counted over them then reads three narrow
    columns of that table.
    """
    path = work_dir(events.sparkSession, "sequence")
    inside = Window.partitionBy(file, "_block").orderBy(order_id)
    dealt = executable(events).withColumn("_block", block(order_id, width)).withColumn(
        "_inside", F.row_number().over(inside))
    dealt.write.parquet(path)
    dealt = events.sparkSession.read.schema(dealt.schema).parquet(path)
    blocks = dealt.groupBy(file, "_block").agg(F.min(created).alias("_created"), F.count(F.lit(1)).alias("_rows"))
    # one row per file and block of 2^20 ids
    blocks.write.parquet(f"{path}-blocks")
    blocks = events.sparkSession.read.schema(blocks.schema).parquet(f"{path}-blocks")
    in_file = block_offsets(blocks, [file], width)
    by_file = blocks.groupBy(file).agg(F.min("_created").alias("_created"), F.sum("_rows").alias("_in_file"))
    # one row per file: the only windows over everything
    earlier = Window.orderBy("_created", file).rowsBetween(Window.unboundedPreceding, -1)
    files = by_file.select(
        file,
        F.coalesce(F.sum("_in_file").over(earlier), F.lit(0)).alias("_earlier"),
        F.sum("_in_file").over(Window.partitionBy()).alias("total_count"),
    )
    offsets = in_file.join(files, file).selectExpr(file, "_block", "total_count", "_before + _earlier AS _before")
    return dealt.join(offsets, [file, "_block"]).withColumn(
        "exec_no", F.expr("cast(_inside + _before AS bigint)")).drop("_block", "_inside", "_before").withColumn(
        "percent", F.expr("cast(exec_no * 100 div total_count AS int)"))


def outcomes(classified: DataFrame, *by: str) -> DataFrame:
    """Successes and failures of calls and texts, overall or per file."""
    done = F.col("succeeded") == 1
    counted = [
        F.count_if((F.col("kind") == kind) & (done if ok else ~done)).alias(f"{word}_{name}")
        for kind, name in ((st.SP, "sp"), (st.ADHOC, "adhoc"))
        for ok, word in ((True, "successful"), (False, "failed"))
    ]
    return executable(classified).groupBy(*by).agg(*counted)


def duration_words(seconds: Column) -> Column:
    """``2 hours, 1 minute, 5 seconds``: zero parts left out, whole hours counted on."""
    def part(value: Column, word: str) -> Column:
        return F.when(value > 0, F.concat(
            value.cast("string"), F.lit(f" {word}"), F.when(value == 1, F.lit("")).otherwise(F.lit("s"))))

    hours = F.floor(seconds / 3600)
    minutes = F.floor(seconds % 3600 / 60)
    return F.concat_ws(", ", part(hours, "hour"), part(minutes, "minute"), part(seconds % 60, "second"))


def run_duration(events: DataFrame, *by: str, ts: str = "ts") -> DataFrame:
    """Time from the first to the last event, in whole seconds and in words."""
    bounds = events.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    seconds = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp")))
    return bounds.withColumn("seconds", F.floor(seconds / 1000000)).withColumn(
        "duration_text", duration_words(F.col("seconds"))
    )


def interval_rollup(events: DataFrame, *key: str, interval: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Executions and average duration per statement and interval.

    This is the shape of runtime statistics, so a capture can be compared too.
    Works on a stream as well (see :mod:`driftscope.streaming`).
    """
    rolled = executable(events).groupBy(F.window(ts, interval).alias("interval"), *key).agg(
        F.count(F.lit(1)).alias("count_executions"),
        F.sum("duration").alias("total_duration"),
    )
    return rolled.select(
        *key,
        F.col("interval.start").alias("start_time"),
        F.col("interval.end").alias("end_time"),
        "count_executions",
        (F.col("total_duration").cast("decimal(38,2)") / F.col("count_executions")).cast("decimal(38,6)").alias("avg_duration"),
    )
