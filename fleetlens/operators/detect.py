"""Overload and under-use detection for all services in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.functions.expressions import ratio
from fleetlens.operators.series import all_true, regularise, sum_replicas

BINNED = ["pending", "kv_cache", "running"]
RAW = ["server_new", "server_success"]
SHORT = {"pending": "pending", "kv_cache": "kv", "running": "running", "server_new": "new", "server_success": "success"}


def service_tails(
    samples: DataFrame,
    points: int = cat.DETECT_POINTS,
    unit: int = cat.MINUTE,
    n: int = cat.GRID_MINUTES,
    pending_threshold: float = cat.PENDING_THRESHOLD,
    kv_threshold: float = cat.KV_CACHE_THRESHOLD,
    with_requests: bool = True,
    chunk: int | None = None,
) -> DataFrame:
    """One row per service with the last `points` of its summed replica series condensed to rule inputs.

    `samples`: service, replica, metric, ts, value, one range-query result per series: a bounded number of
    points each (else give `chunk`). All metrics go through the same grid, sum and
    resampling step together; only bounded grids reach the tail step.
    """
    metrics = BINNED + (RAW if with_requests else [])
    keys = ["service", "replica", "metric"]
    group = ["service", "metric"]
    wanted = samples.filter(F.col("metric").isin(*metrics))
    regular = regularise(wanted, keys, n=n, unit=unit, chunk=chunk, keep_irregular=False)
    summed = sum_replicas(regular, group)
    metric = F.col("metric")

    # Bins of the resampled metrics; request metrics keep their raw grid.
    resampled = metric.isin(*BINNED)
    slot = F.when(resampled, F.col("ts") - F.col("ts") % unit).otherwise(F.col("ts"))
    bins = summed.groupBy(*group, slot.alias("slot")).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("_total"), F.avg("value").alias("_mean"), F.max("n_valid").alias("n_valid")
    )
    whole = Window.partitionBy(*group)
    ranked = bins.withColumns({
        "_rn": F.row_number().over(whole.orderBy(F.col("slot").desc())),
        "_hi": F.max("slot").over(whole),
        "_lo": F.min("slot").over(whole),
    })
    in_tail = F.when(resampled, F.col("slot") > F.col("_hi") - points * unit).otherwise(F.col("_rn") <= points)
    # Resampling also yields the empty bins between the first and the last; here they are only counted.
    expected = F.least(F.lit(points), F.floor((F.col("_hi") - F.col("_lo")) / unit) + 1)
    tail = ranked.filter(in_tail).select(
        *group,
        "n_valid",
        F.when(metric == "pending", F.col("_total")).when(resampled, ratio(F.col("_mean"), F.col("n_valid")))
        .otherwise(F.col("_mean")).alias("value"),
        F.when(resampled, expected).alias("_expected"),
    )

    value = F.col("value")
    per_metric = tail.groupBy(*group).agg(
        F.max("n_valid").alias("n_valid"),
        (F.coalesce(F.max("_expected"), F.count("*")) - F.count("*")).alias("_empty"),
        (F.count("*") - F.count("value")).alias("_nulls"),
        all_true(value >= pending_threshold).alias("_high"),
        all_true(value <= kv_threshold).alias("_low"),
        F.max("value").alias("_peak"),
        F.percentile("value", F.lit(0.9)).alias("_p90"),
    )
    missing = F.col("_empty") + F.col("_nulls")
    at = lambda name, col: F.max(F.when(metric == name, col))
    valid = lambda name: F.coalesce(at(name, F.col("n_valid")), F.lit(0)).alias(f"n_{SHORT[name]}")
    p90 = lambda name: at(name, F.when(missing == 0, F.col("_p90"))).alias(f"p90_{SHORT[name]}")
    # An empty pending bin sums to zero.
    high = F.col("_high") & ((F.col("_empty") == 0) | F.lit(pending_threshold <= 0))
    columns = [
        *[valid(m) for m in metrics],
        *[p90(m) for m in metrics if m != "pending"],
        F.coalesce(at("pending", high), F.lit(False)).alias("pending_high"),
        F.coalesce(at("kv_cache", F.col("_low") & (F.col("_empty") == 0)), F.lit(False)).alias("kv_low"),
        at("running", F.col("_peak")).alias("running_peak"),
        F.coalesce(at("running", missing), F.lit(0)).alias("running_missing"),
    ]
    return per_metric.groupBy("service").agg(*columns)


def flag(loaded: DataFrame, running_threshold: float = cat.RUNNING_THRESHOLD) -> DataFrame:
    """Add is_up, is_down and is_anomaly (0 or 1) to tasks joined with their tails.

    With one replica only the scale-up rule counts.
    """
    c = F.col
    up = F.coalesce(c("pending_high"), F.lit(False))
    # All running points low is the same as the peak being low, as long as no point is missing.
    running_low = (c("n_running") > 0) & (c("running_missing") == 0) & (
        c("running_peak") <= running_threshold * c("max_num_seqs")
    )
    down = F.coalesce((c("n_kv") > 0) & c("kv_low") & running_low, F.lit(False)) & (c("replicas") != 1)
    return loaded.withColumns({"is_up": up, "is_down": down, "is_anomaly": (up | down).cast("int")})


def judge(tasks: DataFrame, tails: DataFrame, running_threshold: float = cat.RUNNING_THRESHOLD) -> DataFrame:
    """Scale-up flag, scale-down flag and the combined anomaly flag per service."""
    loaded = tasks.select("service", "replicas", "max_num_seqs").join(tails, "service", "left")
    return flag(loaded, running_threshold).select("service", "is_up", "is_down", "is_anomaly")


def detect_anomaly(samples: DataFrame, tasks: DataFrame, running_threshold: float = cat.RUNNING_THRESHOLD, **rules) -> DataFrame:
    return judge(tasks, service_tails(samples, with_requests=False, **rules), running_threshold)


def select_detect_candidates(tasks: DataFrame, status: DataFrame) -> DataFrame:
    """Tasks under automatic scaling that are running."""
    running = status.filter(F.col("status") == "running")
    return tasks.filter(F.col("strategy") == "auto").join(running, "task", "left_semi")


def rollup_task_status(replicas: DataFrame, strict: bool = False) -> DataFrame:
    """Task status from its replicas (task, idx, state).

    `running` if the last replica in list order runs (all of them, if `strict`), else `error` if one
    exited or failed, else `scheduling`.
    """
    runs = F.col("state") == "running"
    running = F.bool_and(runs) if strict else F.max_by(runs, "idx")
    return replicas.groupBy("task").agg(
        running.alias("_running"), F.bool_or(F.col("state").isin("exited", "failed")).alias("_failed")
    ).select(
        "task", F.when(F.col("_running"), "running").when(F.col("_failed"), "error").otherwise("scheduling").alias("status")
    )
