"""Event-time windows and upserts, for streams and for tables alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late) if events.isStreaming else events


def counts(events: DataFrame, size: str, slide: str | None = None, time: str = "ts", by: str = "event_type", late: str = "1 hour") -> DataFrame:
    """``window_start, <by>, events, total``: counts and sums in tumbling or sliding windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = _marked(events, time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "events", "total")


def sessions(events: DataFrame, gap: str, time: str = "ts", by: str = "user_id", late: str = "1 hour") -> DataFrame:
    """``session_start, session_end, <by>, events``: runs of events with less than ``gap`` between neighbours."""
    out = _marked(events, time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "events")


def append_log(rows: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> DataStreamWriter:
    """A stream appended to files, each row once."""
    return rows.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def upsert_stream(rows: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A stream merged into a table batch by batch; ``merge`` gets the batch and its number, and must be idempotent."""
    return rows.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint)


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the sink yet (resuming a run)."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
