"""Cold start, recovery, detection and history rules."""

import math

import pytest
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.catalog import SECOND
from fleetlens.operators import detect, history, recommend

GOLDEN = [
    ("chatglm", 6.0, 24, 1, 256, 1, 0.8),
    ("llama", 13.0, 24, 2, 128, 2, 0.7),
    ("mistral", 7.0, 24, 8, 256, 2, 0.6),
    ("llama", 7.0, 24, 1, 256, 1, 0.9),
    ("qwen", 14.0, 24, 1, 128, None, None),
    ("qwen", 14.0, 80, 1, 128, 1, 0.5),
    ("gemma", 2.0, 24, 1, 512, 1, 0.4),
    ("unknown", 10.0, 80, 2, 128, 1, 0.4),
]


def test_cold_start_golden_values(spark):
    rows = [r[:4] for r in GOLDEN]
    got = recommend.recommend_cold_start(
        spark.createDataFrame(rows, "framework string, param double, gpu_spec int, gpu_num int")
    ).collect()
    for row, wanted in zip(got, GOLDEN):
        assert (row["max_num_seqs"], row["tensor_parallel_size"], row["gpu_memory_utilization"], row["replicas"]) == (*wanted[4:], 1)


TASK = "service string, framework string, param double, gpu_spec int, gpu_num int, max_num_seqs int, tensor_parallel_size int, gpu_memory_utilization double, replicas int"
TAIL = "service string, n_pending bigint, n_kv bigint, n_running bigint, n_new bigint, n_success bigint, pending_high boolean, kv_low boolean, running_peak double, running_missing bigint, p90_running double, p90_kv double, p90_new double, p90_success double"


def recover_one(spark, task, tail, **options):
    tasks = spark.createDataFrame([("s", *task)], TASK)
    n = task[-1]
    tails = spark.createDataFrame([("s", n, n, n, n, n, tail[0], False, 0.0, 0, *map(float, tail[1:]))], TAIL)
    r = recommend.recommend_recovery(tasks, tails, **options).first()
    return r["max_num_seqs"], r["tensor_parallel_size"], r["gpu_memory_utilization"], r["replicas"]


MISTRAL = ("mistral", 7.0, 24, 8, 128, 1, 0.9, 2)


def test_recovery_unchanged_without_pressure(spark):
    # running p90, kv p90, new p90, success p90
    assert recover_one(spark, MISTRAL, (False, 60, 50, 10, 10)) == (128, 1, 0.9, 2)


def test_recovery_scales_down_by_half(spark):
    task = ("mistral", 7.0, 24, 8, 128, 1, 0.9, 5)
    assert recover_one(spark, task, (False, 1, 5, 10, 10)) == (256, 1, 0.9, 3)


def test_recovery_thresholds_are_strict(spark):
    assert recover_one(spark, MISTRAL, (False, 12.8, 5, 1, 1)) == (128, 1, 0.9, 2)
    assert recover_one(spark, MISTRAL, (False, 1, 10, 1, 1)) == (128, 1, 0.9, 2)


def test_recovery_implausible_pressure_changes_nothing(spark):
    assert recover_one(spark, MISTRAL, (True, 60, 50, 10, 10)) == (128, 1, 0.9, 2)


def test_recovery_scales_up(spark):
    """Cache nearly full, batch not: memory grows by the inverse batch usage; checked against the formula."""
    gib = 1024**3
    param_mem = 7110393856 * 2
    current = 1 * 0.9 * 24 * gib
    usage = 100 / 128
    lower = (7110393856 + 65536 * 32768) * 2 + 5 * gib
    needed = max((current - param_mem) / usage + param_mem, lower)
    card = 24 * 0.9 * gib
    tp = next(d for d in (1, 2, 4, 8) if d * card * 0.9 > needed)
    util = next(u for u in cat.UTILISATION_LADDER if u * tp * card > needed)
    load = (current - param_mem) / (tp * util * 24 * gib - param_mem) * 300 / 90 * 2
    replicas = min(max(math.ceil(load), 2), 8 // tp)
    assert recover_one(spark, MISTRAL, (True, 100, 95, 300, 90)) == (256, tp, util, replicas)


def test_recovery_out_of_memory_fallback(spark):
    task = ("qwen", 14.0, 24, 1, 128, 1, 0.9, 1)
    assert recover_one(spark, task, (True, 127, 95, 300, 90))[1:3] == (1, 0.9)
    assert recover_one(spark, task, (True, 127, 95, 300, 90), compat=True)[1:3] == (0, 1.0)


def test_recovery_full_cache_without_batch_usage(spark):
    """The need is infinite, so the fallback for too little memory is taken: most cards, highest utilisation."""
    assert recover_one(spark, MISTRAL, (True, 0, 95, 300, 90))[1:3] == (8, 0.9)
    assert recover_one(spark, MISTRAL, (True, 0, 95, 300, 90), compat=True)[1:3] == (0, 8.0)


def test_recovery_guards_division(spark):
    assert recover_one(spark, MISTRAL, (True, 127, 95, 300, 0))[3] == 2


def test_recovery_needs_all_replicas(spark):
    tasks = spark.createDataFrame([("s", *MISTRAL)], TASK)
    tails = spark.createDataFrame([("s", 1, 2, 2, 2, 2, True, False, 0.0, 0, 127.0, 95.0, 300.0, 90.0)], TAIL)
    r = recommend.recommend_recovery(tasks, tails).first()
    assert (r["max_num_seqs"], r["replicas"]) == (128, 2)
    assert recommend.recommend_recovery(tasks, tails.filter("false")).first()["replicas"] == 2


def test_apply_fills_only_empty_fields(spark):
    fields = "task string, max_num_seqs int, tensor_parallel_size int, gpu_memory_utilization double, replicas int"
    tasks = spark.createDataFrame([("a", 0, 4, 0.0, 1), ("b", 8, 1, 0.5, 3)], fields)
    recs = spark.createDataFrame([("a", 256, 2, 0.8, 5)], fields)
    out = recommend.apply_recommendation(tasks, recs, ["task"]).orderBy("task").collect()
    assert [tuple(r) for r in out] == [("a", 256, 4, 0.8, 5), ("b", 8, 1, 0.5, 3)]
    forced = recommend.apply_recommendation(tasks, recs, ["task"], overwrite=True).orderBy("task").first()
    assert tuple(forced) == ("a", 256, 2, 0.8, 5)


def test_replica_removals_take_the_oldest(spark):
    tasks = spark.createDataFrame([("a", 1), ("b", 3), ("c", 0)], "task string, desired bigint")
    replicas = spark.createDataFrame(
        [("a", 5000, "x"), ("a", 2, "y"), ("a", 9000, "z"), ("b", 1, "u"), ("c", 1, "v")], "task string, idx bigint, container string"
    )
    assert {r["container"] for r in recommend.replica_removals(tasks, replicas).collect()} == {"x", "y", "v"}
    actions = {r["task"]: (r["delta"], r["action"]) for r in recommend.replica_gap(tasks, replicas).collect()}
    assert actions == {"a": (-2, "remove"), "b": (2, "add"), "c": (-1, "remove_all")}


def load(spark, pending, running=5.0, kv=2.0, replicas=2, step=15, n=120, metrics=None):
    """Two replicas, points every 15 seconds, constant values."""
    values = {"pending": pending, "running": running, "kv_cache": kv, "server_new": 350.0, "server_success": 90.0}
    rows = [
        ("s", f"r{r}", m, (1713164400 + i * step) * SECOND, v)
        for r in range(replicas) for i in range(n) for m, v in values.items() if metrics is None or m in metrics
    ]
    return spark.createDataFrame(rows, "service string, replica string, metric string, ts bigint, value double")


def flags(spark, samples, replicas=2, max_num_seqs=256):
    tasks = spark.createDataFrame([("s", replicas, max_num_seqs)], "service string, replicas int, max_num_seqs int")
    r = detect.detect_anomaly(samples, tasks).first()
    return r["is_up"], r["is_down"], r["is_anomaly"]


def test_detect_sums_a_minute_over_replicas(spark):
    # Four points a minute and two replicas: 8 * 6.25 reaches the threshold of 50 exactly. The last bin
    # of this grid is full, as 120 points end at second 45 of a minute.
    assert flags(spark, load(spark, 6.25, running=100.0, kv=50.0)) == (True, False, 1)
    assert flags(spark, load(spark, 6.24, running=100.0, kv=50.0)) == (False, False, 0)


def test_detect_low_load_is_inclusive(spark):
    # Means are per replica: 10 and 25.6 (a tenth of 256) still count as low.
    assert flags(spark, load(spark, 0.0, running=25.6, kv=10.0)) == (False, True, 1)
    assert flags(spark, load(spark, 0.0, running=25.7, kv=10.0)) == (False, False, 0)
    assert flags(spark, load(spark, 0.0, running=25.6, kv=10.1)) == (False, False, 0)


def test_detect_single_replica_never_scales_down(spark):
    assert flags(spark, load(spark, 0.0, replicas=1), replicas=1) == (False, False, 0)


def test_detect_without_valid_series(spark):
    assert flags(spark, load(spark, 100.0, n=4)) == (False, False, 0)
    assert flags(spark, load(spark, 0.0, metrics=["pending", "running"])) == (False, False, 0)


def test_detect_unaligned_replicas_never_match(spark):
    """Replicas on different grids give no common point: sums are 0, means are missing."""
    a = load(spark, 100.0, replicas=1)
    b = a.withColumn("replica", F.lit("r9")).withColumn("ts", F.col("ts") + 7 * SECOND)
    tails = detect.service_tails(a.unionByName(b)).first()
    assert tails["n_pending"] == 2 and not tails["pending_high"] and tails["p90_running"] is None


def test_status_rollup(spark):
    rows = [("a", 0, "running"), ("a", 1, "exited"), ("b", 0, "exited"), ("b", 1, "running"), ("c", 0, "created")]
    df = spark.createDataFrame(rows, "task string, idx bigint, state string")
    assert {r["task"]: r["status"] for r in detect.rollup_task_status(df).collect()} == {"a": "error", "b": "running", "c": "scheduling"}
    assert {r["task"]: r["status"] for r in detect.rollup_task_status(df, strict=True).collect()}["b"] == "error"


@pytest.mark.parametrize("n,kept", [(0, 0), (1, 1), (11, 11), (12, 11)])
def test_history_keeps_eleven(spark, n, kept):
    rows = [("t", i) for i in range(n)]
    df = spark.createDataFrame(rows, "task string, timestamp bigint")
    got = [r["timestamp"] for r in history.keep_last(df).orderBy("position").collect()]
    assert got == list(range(n - 1, n - 1 - kept, -1))


def test_parameter_estimate_rounds_half_to_even(spark):
    from fleetlens.operators.inventory import estimate_params

    rows = [("llama", 32000, 4096, 32, 0), ("chatglm", 65024, 4096, 0, 28)]
    df = spark.createDataFrame(rows, "model_type string, vocab_size bigint, hidden_size bigint, num_hidden_layers bigint, num_layers bigint")
    for row, (_, v, h, deep, other) in zip(estimate_params(df).collect(), rows):
        depth = deep or other
        expected = v * h + depth * (4 * h * h + 4 * h) + depth * (8 * h * h + 5 * h) + 4 * depth * h
        assert row["params_size"] == expected and row["param"] == round(expected / 1e9)
