"""File events to conversions, exactly once a version."""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import newest
from ..sources import events as parse_events

#: Event types that ask for a conversion.
CONVERT = ("file.created", "file.updated", "file.restored")
TIME_FORMAT = "yyyyMMdd_HHmmss.SSS"


def event_time(ts: Column) -> Column:
    """Time of an event's stamp, null for a broken one."""
    return F.try_to_timestamp(ts, F.lit(TIME_FORMAT))


def stamp(time: Column) -> Column:
    return F.date_format(time, TIME_FORMAT)


def action(events: DataFrame) -> Column:
    """What an event asks for: convert, delete, or null for nothing. Our own renditions ask for nothing."""
    ours = F.coalesce(F.col("is_rendition"), F.lit(False)) | (F.coalesce("file_uid", F.lit("")) == "")
    return F.when(ours, None).when(F.col("type").isin(*CONVERT), "convert").when(F.col("type") == "file.deleted", "delete")


def routed(events: DataFrame) -> DataFrame:
    """Events that ask for something, with column ``action``."""
    return events.withColumn("action", action(events)).filter("action is not null")


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event_id once, as long as repeats come within the delay; works on streams and tables."""
    timed = events.withColumn("event_time", event_time(F.col("ts")))
    if not events.isStreaming:
        return timed.dropDuplicates(["event_id"])
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def latest_actions(batch: DataFrame) -> DataFrame:
    """Of each file in a batch the last event that asks for something, by time stamp."""
    return newest(routed(batch), ["tenant", "file_uid"], "ts")


class ReadOnly(Exception):
    """What a handler raises while its tables cannot be written: the batch waits and is then handed over again."""


def event_tail(spark: SparkSession, path: str, group: str, most_files: int = 32) -> DataFrame:
    """Events of files that come after the group was made; whoever makes it first, sets the time. ``group`` is a path."""
    spark.range(1).select(F.current_timestamp().alias("since")).write.mode("ignore").parquet(group)
    since = spark.read.parquet(group).agg(F.min("since")).first()[0]
    lines = spark.readStream.option("maxFilesPerTrigger", most_files).text(path).select("value", F.col("_metadata.file_modification_time").alias("at"))
    return parse_events(lines.filter(F.col("at") >= F.lit(since)))


def _handed_over(rows: DataFrame, handle: Callable[[DataFrame], None], keys: list[str], depth: int = 0) -> list[tuple[DataFrame, str]]:
    """Hand rows over; where that fails, by halves, so that all but the rows at fault are handled. Returns those and why."""
    try:
        handle(rows)
        return []
    except ReadOnly:
        raise
    except Exception as error:
        if depth == 32 or rows.count() <= 1:
            return [(rows, f"{type(error).__name__}: {error}"[:1000])]
    half = F.shiftright(F.xxhash64(*keys), depth).bitwiseAND(F.lit(1))
    return [bad for side in (0, 1) if not (part := rows.filter(half == side)).isEmpty() for bad in _handed_over(part, handle, keys, depth + 1)]


def ingest(events: DataFrame, handle: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, once: bool = False, dead: str | None = None, pause: float = 5.0, most_pauses: int | None = None) -> StreamingQuery:
    """Run ``handle(to convert, to delete, batch id)`` for each batch.

    A handler that raises ReadOnly is tried again after ``pause`` seconds, before anything newer is read; after
    ``most_pauses`` tries (none: without end) the query stops. Any other error stops the query as well, unless ``dead``
    names a folder: then the batch is handed over by halves until the events at fault are found, these are written to
    ``dead`` with the error, and the stream goes on. A batch that was not finished is handed over again at the next
    start, so ``handle`` must write in a way that a row may come twice, which table replacements do.
    """
    def batch(df: DataFrame, number: int) -> None:
        last = latest_actions(df).persist()
        both = lambda rows: handle(rows.filter("action = 'convert'"), rows.filter("action = 'delete'"), number)
        try:
            for turn in count(1):
                try:
                    bad = _handed_over(last, both, ["tenant", "file_uid"]) if dead else both(last)
                    break
                except ReadOnly:
                    if turn == most_pauses:
                        raise
                    time.sleep(pause)
            for rows, error in bad or []:
                rows.withColumn("error", F.lit(error)).withColumn("batch", F.lit(number)).write.mode("append").parquet(dead)
        finally:
            last.unpersist()

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def windowed(events: DataFrame, length: str = "1 hour", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows (start, event_type, n, total) of tumbling windows; on streams, late events count up to ``late``."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows (user_id, start, end, n) of each user's sessions, parted by pauses of ``gap``."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
