"""The audit trail: one escaped, tab-separated line for each print job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audit_line, iso_instant

__all__ = ["AUDIT_FIELDS", "audit_lines", "null_sink", "session_counts", "stream_audit", "windowed_counts"]

AUDIT_FIELDS = ("job_id", "title", "page_count", "copies", "printer", "machine", "user", "status", "started", "completed", "tenant", "error")


def audit_lines(events: DataFrame) -> DataFrame:
    """(value) lines of events; a field that events lack is empty."""

    def field(name: str) -> Column:
        if name not in events.columns:
            return F.lit("")
        return F.coalesce(iso_instant(name), F.lit("")) if name in ("started", "completed") else F.col(name)

    return events.select(audit_line(*(field(n) for n in AUDIT_FIELDS)).alias("value"))


def stream_audit(events: DataFrame, path: str, checkpoint: str):
    """Appends the lines of a stream of events to text files, each event exactly once."""
    return audit_lines(events).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def null_sink(events: DataFrame, checkpoint: str):
    """Runs a stream of events and discards them."""
    return events.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark, which needs a zoned time: one without a zone counts as the session's."""
    if not events.isStreaming:
        return events
    zoned = events.withColumn(time, F.col(time).cast("timestamp")) if dict(events.dtypes)[time] == "timestamp_ntz" else events
    return zoned.withWatermark(time, late)


def windowed_counts(events: DataFrame, time: str, window: str, *, slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, window_end, .., n) with a watermark where events are a stream."""
    e = _watermarked(events, time, late)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return e.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def session_counts(events: DataFrame, time: str, gap: str, *, by: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """(session_start, session_end, .., n) of sessions that end after a gap."""
    e = _watermarked(events, time, late)
    return e.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
