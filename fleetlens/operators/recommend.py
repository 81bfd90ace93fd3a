"""Serving configuration for whole fleets: first deployment and recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.functions.expressions import clip, divisors, first_passing, nearest_of, ratio
from fleetlens.operators.chunks import split_rank

BYTES_PER_GB = float(cat.GIB)


def match_catalog(specs: DataFrame) -> DataFrame:
    """Add param_size, token_size, n_head, seq_length and whether the model is in the catalogue.

    Unknown models take the default whose size is nearest. The catalogue is a fixed literal of ten rows, so
    it is broadcast; the three defaults are a plain expression.
    """
    spark: SparkSession = specs.sparkSession
    known = cat.model_catalog(spark).withColumnsRenamed({
        "framework": "_framework", "param": "_param", "param_size": "_ps",
        "token_size": "_ts", "n_head": "_nh", "seq_length": "_sl",
    })
    joined = specs.join(
        F.broadcast(known), (F.col("framework") == F.col("_framework")) & (F.col("param") == F.col("_param")), "left"
    )
    nearest = nearest_of([row[0] for row in cat.DEFAULT_MODELS], F.col("param"))
    default = lambda i: F.coalesce(*[F.when(nearest == row[0], F.lit(row[i]).cast("long")) for row in cat.DEFAULT_MODELS])
    return joined.select(
        *specs.columns,
        F.coalesce(F.col("_ps").cast("double"), F.col("param") * BYTES_PER_GB).alias("param_size"),
        F.coalesce(F.col("_ts"), default(1)).alias("token_size"),
        F.coalesce("_nh", F.lit(cat.DEFAULT_N_HEAD)).alias("n_head"),
        F.coalesce(F.col("_sl"), default(2)).alias("seq_length"),
        F.col("_ps").isNotNull().alias("in_catalog"),
    )


def batch_size(param_size: Column) -> Column:
    """Ladder step nearest to the baseline divided by the model size."""
    return nearest_of(cat.BATCH_LADDER, ratio(F.lit(float(cat.BATCH_BASELINE)), param_size)).cast("int")


def model_memory(activation_gib: Column) -> Column:
    """Bytes for weights, one full sequence of cache and activations."""
    return (F.col("param_size") + F.col("token_size") * F.col("seq_length")) * cat.DTYPE_SIZE + (
        activation_gib * BYTES_PER_GB
    )


def parallel_size(required: Column, n_head: Column, gpu_spec: Column, gpu_num: Column) -> Column:
    """Smallest number of cards, a divisor of the head count, that holds the required bytes; NULL if none does."""
    card = gpu_spec * cat.SAFE_GPU_SHARE
    top = max(cat.UTILISATION_LADDER)
    fits = F.filter(divisors(n_head), lambda d: (d * card * BYTES_PER_GB * top > required) & (d <= gpu_num))
    return F.array_min(fits)


def recommend_cold_start(requests: DataFrame) -> DataFrame:
    """Configuration for a first deployment.

    `requests` holds framework, param, gpu_spec (GB per card) and gpu_num beside any key columns.
    """
    matched = match_catalog(requests)
    activation = F.when(
        F.lower("framework") == cat.LARGE_ACTIVATION_FRAMEWORK, F.lit(cat.ACTIVATION_GIB_LARGE)
    ).otherwise(F.lit(cat.ACTIVATION_GIB))
    sized = matched.withColumn("_mem", model_memory(activation))
    tp = parallel_size(F.col("_mem"), F.col("n_head"), F.col("gpu_spec"), F.col("gpu_num"))
    sized = sized.withColumn("tensor_parallel_size", tp)
    util = utilisation(F.col("_mem"), F.col("tensor_parallel_size"), F.col("gpu_spec"))
    return sized.select(
        *requests.columns,
        batch_size(F.col("param_size")).alias("max_num_seqs"),
        "tensor_parallel_size",
        util.alias("gpu_memory_utilization"),
        F.lit(1).alias("replicas"),
    )


def utilisation(required: Column, tp: Column, gpu_spec: Column) -> Column:
    """Smallest utilisation step at which `tp` cards hold the required bytes; NULL if none does."""
    card = gpu_spec * cat.SAFE_GPU_SHARE
    return first_passing(cat.UTILISATION_LADDER, lambda u: F.lit(u) * tp * card * BYTES_PER_GB > required)


def recommend_recovery(
    tasks: DataFrame,
    tails: DataFrame,
    kv_threshold: float = cat.KV_CACHE_THRESHOLD,
    running_threshold: float = cat.RUNNING_THRESHOLD,
    compat: bool = False,
) -> DataFrame:
    """New configuration per service from its recent load: see ``recover``."""
    return recover(tasks.join(tails, "service", "left"), kv_threshold, running_threshold, compat)


def recover(
    loaded: DataFrame,
    kv_threshold: float = cat.KV_CACHE_THRESHOLD,
    running_threshold: float = cat.RUNNING_THRESHOLD,
    compat: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """New configuration per service from tasks joined with their tails.

    Task columns: service, framework, param, gpu_spec, gpu_num, max_num_seqs, tensor_parallel_size,
    gpu_memory_utilization, replicas. Tails (see ``detect.service_tails``): valid replicas per metric,
    the pending rule and the 90th percentiles. `compat` swaps the two out-of-memory fallbacks. `keep` names
    further columns to carry along.
    """
    c = F.col
    counted = match_catalog(loaded).withColumns({
        "_measured": F.coalesce(
            (c("n_pending") == c("replicas")) & (c("n_kv") == c("replicas")) & (c("n_running") == c("replicas")),
            F.lit(False),
        ),
        "_bu": ratio(c("p90_running"), c("max_num_seqs")),
        "_kv": c("p90_kv"),
        "_param_mem": c("param_size") * cat.DTYPE_SIZE,
        "_lower": model_memory(F.lit(cat.ACTIVATION_GIB_LARGE)),
        "_current": c("tensor_parallel_size") * c("gpu_memory_utilization") * c("gpu_spec") * BYTES_PER_GB,
    })
    ruled = counted.withColumns({
        "_up": F.coalesce(c("pending_high"), F.lit(False)),
        "_down": F.coalesce((c("_bu") < running_threshold) & (c("_kv") < kv_threshold), F.lit(False)),
    })
    spare = c("_current") - c("_param_mem")
    wanted = (
        # Without any batch usage a full cache has no finite need; no number of cards holds it.
        F.when((c("_kv") > 90) & (c("_bu") == 0), F.lit(float("inf")))
        .when((c("_kv") > 90) & (c("_bu") < 0.9), ratio(spare, c("_bu")))
        .when((c("_kv") < 90) & (c("_bu") > 0.9), c("_kv") * spare / 100)
        .otherwise(spare)
    )
    implausible = F.coalesce(c("_up") & (c("_kv") < 90) & (c("_bu") < 0.9), F.lit(False))
    needed = ruled.withColumns({
        "_active": c("_measured") & ~implausible,
        "_needed": F.greatest(wanted + c("_param_mem"), c("_lower")),
    })
    tp = parallel_size(c("_needed"), c("n_head"), c("gpu_spec"), c("gpu_num"))
    planned = needed.withColumn("_tp", tp)
    planned = planned.withColumn("_util", utilisation(c("_needed"), c("_tp"), c("gpu_spec")))
    most_cards = F.array_max(F.filter(divisors(c("n_head")), lambda d: d <= c("gpu_num")))
    top = F.lit(max(cat.UTILISATION_LADDER))
    fallback_tp, fallback_util = (top.cast("int"), most_cards.cast("double")) if compat else (most_cards, top)
    settled = planned.withColumns({
        "_tp_new": F.when(c("_up"), F.coalesce(c("_tp"), fallback_tp)).otherwise(c("tensor_parallel_size")),
        "_util_new": F.when(c("_up"), F.when(c("_tp").isNotNull(), c("_util")).otherwise(fallback_util)).otherwise(
            c("gpu_memory_utilization")
        ),
    })
    old_mem = c("_current") - c("_param_mem")
    new_mem = c("_tp_new") * c("_util_new") * c("gpu_spec") * BYTES_PER_GB - c("_param_mem")
    load = ratio(old_mem, new_mem) * ratio(c("p90_new"), c("p90_success")) * c("replicas")
    grown = clip(F.ceil(load), c("replicas").cast("long"), F.floor(ratio(c("gpu_num"), c("_tp_new"))))
    requests_measured = (c("n_new") == c("replicas")) & (c("n_success") == c("replicas"))
    replicas_new = (
        F.when(c("_up"), F.when(F.coalesce(requests_measured & load.isNotNull(), F.lit(False)), grown).otherwise(c("replicas")))
        .when(c("_down"), F.ceil(c("replicas") / 2))
        .otherwise(c("replicas"))
    )
    active = c("_active")
    return settled.select(
        "service",
        *keep,
        F.when(active & (c("_up") | c("_down")), batch_size(c("param_size"))).otherwise(c("max_num_seqs")).cast("int").alias("max_num_seqs"),
        F.when(active, c("_tp_new")).otherwise(c("tensor_parallel_size")).cast("int").alias("tensor_parallel_size"),
        F.when(active, c("_util_new")).otherwise(c("gpu_memory_utilization")).alias("gpu_memory_utilization"),
        F.when(active, replicas_new).otherwise(c("replicas")).cast("int").alias("replicas"),
        (active & c("_up")).alias("scaled_up"),
        (active & ~c("_up") & c("_down")).alias("scaled_down"),
    )


def apply_recommendation(tasks: DataFrame, recommended: DataFrame, key: list[str], overwrite: bool = False) -> DataFrame:
    """Merge recommendations into tasks: empty (<= 0) backend fields are filled, replicas always replaced."""
    fields = ["max_num_seqs", "tensor_parallel_size", "gpu_memory_utilization"]
    recs = recommended.select(*key, *[F.col(f).alias(f"_r_{f}") for f in [*fields, "replicas"]])
    joined = tasks.join(recs, key, "left")
    merged = {"replicas": F.coalesce("_r_replicas", "replicas")}
    for f in fields:
        fill = F.lit(True) if overwrite else F.col(f) <= 0
        merged[f] = F.when(fill, F.coalesce(f"_r_{f}", f)).otherwise(F.col(f))
    return joined.withColumns(merged).select(*tasks.columns)


def replica_gap(tasks: DataFrame, replicas: DataFrame) -> DataFrame:
    """Decision per task: replicas to add (positive) or remove (negative), and the action."""
    actual = replicas.groupBy("task").agg(F.count("*").alias("actual"))
    delta = F.col("desired") - F.coalesce("actual", F.lit(0))
    return tasks.join(actual, "task", "left").select(
        "task",
        "desired",
        F.coalesce("actual", F.lit(0)).cast("long").alias("actual"),
        delta.cast("long").alias("delta"),
        F.when((F.col("desired") == 0) & (delta < 0), "remove_all").when(delta < 0, "remove").when(delta > 0, "add")
        .otherwise("keep").alias("action"),
    )


def replica_removals(tasks: DataFrame, replicas: DataFrame) -> DataFrame:
    """Replicas to remove, oldest list position first, one row each.

    Ranks come from prefix counts over position ranges, so a task with very many replicas is not sorted
    in one place.
    """
    surplus = replica_gap(tasks, replicas).filter("delta < 0").select("task", (-F.col("delta")).alias("surplus"))
    ranked = split_rank(replicas, ["task"], "idx")
    return ranked.join(surplus, "task").filter(F.col("rank") <= F.col("surplus")).drop("surplus")
