"""Streaming aggregations. All take a stream with a TIMESTAMP `ts` and return a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.operators.spans import DURATION_BOUNDS

# Rows later than the instant-query lookback are too late to matter to any view.
WATERMARK = f"{cat.LOOKBACK // cat.SECOND} seconds"


def windowed(
    stream: DataFrame, keys: Sequence[str], width: str = "1 minute", slide: str | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Sum, mean and count per series and tumbling (or, with `slide`, sliding) window."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(*keys, span.alias("w"))
        .agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count("value").alias("n"))
        .select(*keys, F.unix_micros("w.start").alias("w_start"), F.unix_micros("w.end").alias("w_end"), "total", "mean", "n")
    )


def staleness_sessions(
    stream: DataFrame, keys: Sequence[str], timeout: str = f"{cat.STALE // cat.SECOND} seconds", watermark: str = WATERMARK
) -> DataFrame:
    """Refresh sessions of a gauge; at the end of a session the gauge has gone stale and reads 0.

    Sessions are merged inside each map partition first, so that a hot gauge is shuffled as a few sessions
    rather than as all of its samples.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(*keys, F.session_window("ts", timeout).alias("w"))
        .agg(F.count("*").alias("n"), F.max_by("value", "ts").alias("last_value"))
        .select(*keys, F.unix_micros("w.start").alias("fresh_from"), F.unix_micros("w.end").alias("stale_from"), "n", "last_value")
    )


def last_values(stream: DataFrame, keys: Sequence[str], order: str = "ts") -> DataFrame:
    """Current value per series: one state row each, refreshed by every newer sample."""
    return stream.groupBy(*keys).agg(F.max_by("value", order).alias("value"), F.max("ts").alias("last_ts")).select(
        *keys, "value", F.unix_micros("last_ts").alias("last_ts")
    )


def request_counts(stream: DataFrame, labels: Sequence[str], width: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Requests per label set and window; the counter is their running sum."""
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(*labels, F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("requests"))
        .select(*labels, F.unix_micros("w.end").alias("ts"), "requests")
    )


def span_metrics(
    stream: DataFrame, dims: Sequence[str] = ("service", "name", "status"), width: str = "1 minute",
    bounds: Sequence[float] = tuple(DURATION_BOUNDS), watermark: str = WATERMARK,
) -> DataFrame:
    """Calls, duration and cumulative histogram per dimension set and window; `ts` is the span start."""
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(*dims, F.window("ts", width).alias("w"))
        .agg(
            F.count("*").alias("calls"),
            F.sum("duration_ms").alias("duration_ms_sum"),
            *[F.count_if(F.col("duration_ms") <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds],
        )
        .select("*", F.unix_micros("w.start").alias("ts")).drop("w")
    )
