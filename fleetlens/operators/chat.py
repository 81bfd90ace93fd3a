"""Chat context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.operators.series import last_points


def context_window(messages: DataFrame, n: int = cat.CONTEXT_MESSAGES) -> DataFrame:
    """Last n messages of each conversation in order, as one array; only n rows per group reach it."""
    recent = last_points(messages, ["conv_id"], n, ts="turn")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return recent.groupBy("conv_id").agg(turns.alias("_t")).select(
        "conv_id",
        F.transform("_t", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
        F.size("_t").alias("n_messages"),
    )
