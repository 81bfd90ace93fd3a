"""The detection pass: detect, recommend, record and apply for all services in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.operators import detect, history, recommend

FIELDS = ["max_num_seqs", "tensor_parallel_size", "gpu_memory_utilization", "replicas"]


def detection_pass(
    samples: DataFrame,
    tasks: DataFrame,
    timestamp: Column,
    kv_threshold: float = cat.KV_CACHE_THRESHOLD,
    running_threshold: float = cat.RUNNING_THRESHOLD,
    status: DataFrame | None = None,
    **rules,
) -> DataFrame:
    """History records (task, timestamp, is_anomaly, recommended, current) of the anomalous services.

    Samples are condensed once; detection and recovery both read the same joined row per service.
    `current` is the configuration before the recommendation is applied. With `status` (task, status) only
    tasks that run and have the strategy `auto` are judged.
    """
    if status is not None:
        named = tasks.withColumn("task", F.col("service"))
        tasks = detect.select_detect_candidates(named, status).drop("task")
    tails = detect.service_tails(samples, kv_threshold=kv_threshold, **rules)
    old = F.struct(*[F.col(f).alias(f) for f in FIELDS])
    loaded = tasks.join(tails, "service", "left").withColumn("current", old)
    anomalous = detect.flag(loaded, running_threshold).filter("is_anomaly = 1")
    recovered = recommend.recover(anomalous, kv_threshold, running_threshold, keep=["current"])
    return recovered.select(
        F.col("service").alias("task"),
        timestamp.cast("long").alias("timestamp"),
        F.lit(True).alias("is_anomaly"),
        F.struct(*[F.col(f).alias(f) for f in FIELDS]).alias("recommended"),
        "current",
    )


def current_tasks(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """Tasks after applying the newest recorded recommendation of each."""
    latest = history.latest_record(records).select(F.col("task").alias("service"), "recommended.*")
    return recommend.apply_recommendation(tasks, latest, ["service"])
