"""Recommendation history: bounded per task, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.schemas import HISTORY_RECORD

# Shown parameter names and the configuration field behind each.
CONFIG_ROWS = [
    ("batch size", "max_num_seqs"),
    ("tensor_parallel_size", "tensor_parallel_size"),
    ("gpu_memory_utilization", "gpu_memory_utilization"),
    ("replicas num", "replicas"),
]


def keep_last(history: DataFrame, limit: int = cat.HISTORY_LIMIT, tie: str | None = None) -> DataFrame:
    """Newest records per task, with their position; a limit of 10 keeps 11 as list trimming is inclusive.

    The row-number filter is cut to `limit + 1` rows per task on the map side before the shuffle.
    """
    order = [F.col("timestamp").desc()] + ([F.col(tie).desc()] if tie else [])
    ranked = history.withColumn("position", F.row_number().over(Window.partitionBy("task").orderBy(*order)))
    return ranked.filter(F.col("position") <= limit + 1)


def decode_history(raw: DataFrame, column: str = "record") -> DataFrame:
    """JSON records as columns; undecodable records are skipped."""
    keep = [c for c in raw.columns if c != column]
    parsed = raw.withColumn("_r", F.from_json(column, HISTORY_RECORD)).filter("_r.timestamp IS NOT NULL")
    return parsed.select(
        *keep,
        F.col("_r.timestamp").alias("timestamp"),
        F.col("_r.isAnomaly").alias("is_anomaly"),
        F.col("_r.configRecommendResult").alias("recommended"),
        F.col("_r.currentConfig").alias("current"),
    )


def encode_history(history: DataFrame) -> DataFrame:
    """Task, timestamp and the JSON record."""
    record = F.to_json(F.struct(
        "timestamp",
        F.col("is_anomaly").alias("isAnomaly"),
        F.col("recommended").alias("configRecommendResult"),
        F.col("current").alias("currentConfig"),
    ))
    return history.select("task", "timestamp", record.alias("record"))


def latest_record(history: DataFrame, tie: str | None = None) -> DataFrame:
    """Newest record per task as one aggregation."""
    rest = [c for c in history.columns if c != "task"]
    order = F.struct("timestamp", tie) if tie else F.col("timestamp")
    return history.groupBy("task").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("task", "_r.*")


def compare_config(history: DataFrame, tie: str | None = None) -> DataFrame:
    """Latest record of a task as four rows: parameter, current and recommended value."""
    latest = latest_record(history, tie)
    rows = F.array(*[
        F.struct(
            F.lit(title).alias("parameter"),
            F.col(f"current.{field}").cast("double").alias("current_value"),
            F.col(f"recommended.{field}").cast("double").alias("recommended_value"),
        )
        for title, field in CONFIG_ROWS
    ])
    return latest.select("task", "timestamp", F.inline(rows))
