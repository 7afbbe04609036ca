"""Streams of filing events: insert-ignore within a watermark, windowed counts of late events, changes of stored tables exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versioned import VersionedTable


def insert_ignore_stream(events: DataFrame, keys: list[str], at: str = "filed_at", late: str = "7 days") -> DataFrame:
    """The first row of each key; state is kept only as long as rows may come late."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def weekly_counts(events: DataFrame, at: str = "filed_at", late: str = "7 days") -> DataFrame:
    """Events by symbol and week from Monday."""
    week = F.window(at, "7 days", startTime="4 days")
    return events.withWatermark(at, late).groupBy(week, "symbol").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("week"), "symbol", "n")


def upsert_stream(events: DataFrame, table: VersionedTable, keys: list[str], checkpoint: str, at: str = "filed_at", name: str = "upsert"):
    """Keeps in a stored table the latest row of each key by ``at``. Of equal times, rows of a later batch count.

    Every batch is one version of the table, which names the batch: one that Spark hands over again after a failure changes nothing.
    Only months that a batch's rows and keys stand in are written anew.
    """
    return _into(events, checkpoint, lambda batch, number: table.upsert(batch, keys, (name, number), latest=at))


def insert_ignore_into(events: DataFrame, table: VersionedTable, keys: list[str], checkpoint: str, at: str = "filed_at", name: str = "insert"):
    """Adds to a stored table rows whose key it lacks, the first by ``at`` in their batch; exactly once, as ``upsert_stream`` does."""
    return _into(events, checkpoint, lambda batch, number: table.insert_ignore(batch, keys, (name, number), first=at))


def _into(events: DataFrame, checkpoint: str, change):
    def write(batch: DataFrame, number: int) -> None:
        change(batch, number)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
