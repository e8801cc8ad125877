"""Streams of observation slots: the newest reading a station, and a guard between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_by_station(slots: DataFrame, station: str = "station", ts: str = "ts", tolerance: str = "50 minutes") -> DataFrame:
    """Per station and window the newest reading, within the tolerance; later rows than the watermark are dropped.

    For streams and batches alike.  A TIMESTAMP_NTZ column is read as the session's zone.
    """
    rows = slots.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, tolerance)
    reading = F.struct(F.col(ts), *[F.col(c) for c in slots.columns if c not in (station, ts)])
    return rows.groupBy(F.window(ts, "10 minutes").alias("slot"), station).agg(F.max(reading).alias("latest")).select(
        F.col("slot.start").alias("slot_ts"), station, "latest.*")


def once(slots: DataFrame, keys: list[str], ts: str = "ts", tolerance: str = "50 minutes") -> DataFrame:
    """The first row of each key; state is kept for the tolerance only."""
    return slots.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, tolerance).dropDuplicatesWithinWatermark(keys)


def guarded(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, most_failed: float = 1 / 3) -> StreamingQuery:
    """Write micro-batches through ``sink`` unless a third of a batch failed; the stream then stops with an error."""

    def each(batch: DataFrame, epoch: int) -> None:
        r = batch.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "fetch_failed").alias("failed")).first()
        if r["failed"] and r["failed"] >= most_failed * r["n"]:
            raise RuntimeError(f"batch {epoch}: {r['failed']} of {r['n']} readings failed")
        sink(batch, epoch)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
