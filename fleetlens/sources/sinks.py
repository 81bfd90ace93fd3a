"""Writers. Tables are parquet folders; a table is replaced by writing a new version, never in place."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fleetlens import catalog as cat
from fleetlens.operators.history import decode_history, encode_history, keep_last


def append_samples(samples: DataFrame, path: str) -> None:
    """Append derived samples to the samples table, laid out by metric and day for pruning.

    Rows are rebalanced by partition before the write: small partitions become one file each, and adaptive
    execution splits those that hold too many rows for one task. Files are in time order, so that row
    groups outside a time range are skipped.
    """
    dated = samples.withColumn("day", F.to_date(F.timestamp_micros("ts")))
    laid_out = dated.hint("rebalance", "metric", "day").sortWithinPartitions("metric", "day", "ts")
    laid_out.write.mode("append").partitionBy("metric", "day").parquet(path)


def read_samples(
    spark: SparkSession, path: str, metrics: Sequence[str], start: int, end: int, reach: int
) -> DataFrame:
    """Samples of some metrics that a query over `start..end` with windows of `reach` can see.

    Only the folders of these metrics and days are read.
    """
    rows = spark.read.schema("metric string, labels map<string,string>, ts bigint, value double, day date").parquet(path)
    since, until = (F.to_date(F.timestamp_micros(F.lit(t).cast("long"))) for t in (start - reach, end))
    return rows.filter(
        F.col("metric").isin(*metrics) & F.col("day").between(since, until) & (F.col("ts") > start - reach) & (F.col("ts") <= end)
    ).drop("day")


def append_history(history: DataFrame, path: str) -> None:
    """Append records as JSON; the bound per task is applied on reading and compaction."""
    encode_history(history).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, task: str | None = None, limit: int = cat.HISTORY_LIMIT) -> DataFrame:
    """Kept records, newest first; undecodable ones are skipped."""
    raw = spark.read.schema("task string, timestamp bigint, record string").parquet(path)
    if task is not None:
        raw = raw.filter(F.col("task") == task)
    kept = keep_last(raw, limit).drop("timestamp")
    return decode_history(kept).orderBy("task", "position")


def compact_history(spark: SparkSession, path: str, limit: int = cat.HISTORY_LIMIT) -> str:
    """Write the bounded history as a new table beside the old one and return its path."""
    target = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    raw = spark.read.schema("task string, timestamp bigint, record string").parquet(path)
    keep_last(raw, limit).drop("position").write.parquet(target)
    return target


def write_telemetry_stream(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    brokers: str | None = None,
    topic: str | None = None,
    options: Mapping[str, str] | None = None,
    interval: str | None = None,
) -> DataStreamWriter:
    """Stream writer to a Kafka topic (rows as JSON) or a parquet folder; the caller starts it."""
    if brokers:
        out = stream.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("kafka")
        out = out.option("kafka.bootstrap.servers", brokers).option("topic", topic)
    else:
        out = stream.writeStream.format("parquet").option("path", path)
    out = out.options(**(options or {})).option("checkpointLocation", checkpoint)
    return out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)
