"""Streams in several micro-batches against the same work in one batch."""

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog import MINUTE, SECOND
from fleetlens.operators import series
from fleetlens.plans.detection import detection_pass
from fleetlens.sources import readers
from fleetlens.streaming import aggregates, live, runs, stores

SAMPLE = "service string, replica string, metric string, ts timestamp, value double"


def write_in_parts(spark, df, path, parts):
    """One file per micro-batch, in time order."""
    bounds = df.agg(F.min("ts"), F.max("ts")).first()
    width = (bounds[1] - bounds[0]) / parts
    for i in range(parts):
        lo, hi = bounds[0] + width * i, bounds[0] + width * (i + 1)
        last = i == parts - 1
        cond = (F.col("ts") >= F.lit(lo)) & ((F.col("ts") <= F.lit(hi)) if last else (F.col("ts") < F.lit(hi)))
        df.filter(cond).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path):
    return readers.read_telemetry_stream(spark, SAMPLE, path=path, options={"maxFilesPerTrigger": "1"})


@pytest.fixture(scope="module")
def samples(spark):
    seconds = spark.range(0, 7200, 15).select(F.timestamp_seconds(F.col("id") + 1713164400).alias("ts"), "id")
    names = F.explode(F.array(*[F.lit(x) for x in ("pending", "running", "kv_cache", "server_new", "server_success")]))
    rows = seconds.select("ts", "id", F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("replica"), F.lit("s").alias("service"))
    value = F.pmod(F.xxhash64("id", "replica", "metric"), F.lit(20)).cast("double") + F.when(F.col("metric") == "pending", 20.0).otherwise(0.0)
    return rows.select("service", "replica", names.alias("metric"), "ts", "id").withColumn("value", value).drop("id").select(
        "service", "replica", "metric", "ts", "value"
    )


@pytest.fixture(scope="module")
def parts(spark, samples, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "samples")
    write_in_parts(spark, samples, path, 3)
    return path


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_tumbling_windows_equal_batch_resampling(spark, samples, parts, tmp_path):
    keys = ["service", "replica", "metric"]
    stream = aggregates.windowed(stream_of(spark, parts), keys)
    runs.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 3
    got = runs.read_changelog(spark, f"{tmp_path}/out", [*keys, "w_start"]).select(*keys, "w_start", "total", "mean")
    batch = series.resample(samples.withColumn("ts", F.unix_micros("ts")), keys, MINUTE).select(*keys, "ts", "total", "mean")
    assert rows_of(got) == rows_of(batch)


def test_last_values_equal_batch(spark, samples, parts, tmp_path):
    keys = ["replica", "metric"]
    runs.run_to_table(aggregates.last_values(stream_of(spark, parts), keys), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = runs.read_changelog(spark, f"{tmp_path}/out", keys)
    batch = samples.groupBy(*keys).agg(F.max_by("value", "ts").alias("value"), F.unix_micros(F.max("ts")).alias("last_ts"))
    assert rows_of(got.select(*keys, "value", "last_ts")) == rows_of(batch)


def test_restart_reprocesses_nothing(spark, parts, tmp_path):
    keys = ["replica", "metric"]
    for _ in range(2):
        stream = aggregates.request_counts(stream_of(spark, parts), keys)
        runs.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = runs.read_changelog(spark, f"{tmp_path}/out", [*keys, "ts"])
    assert got.agg(F.sum("requests")).first()[0] == 480 * 2 * 5


def test_sessions_close_when_stale(spark, tmp_path):
    stamps = [0, 10, 20, 60, 70, 1000, 5000]
    df = spark.createDataFrame([("s", "r", "m", t, float(t)) for t in stamps], "service string, replica string, metric string, t bigint, value double")
    df.select("service", "replica", "metric", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = aggregates.staleness_sessions(stream_of(spark, f"{tmp_path}/in"), ["metric"])
    runs.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp", mode="append")
    got = runs.read_changelog(spark, f"{tmp_path}/out", ["metric", "fresh_from"])
    closed = {(r["fresh_from"] // 10**6, r["stale_from"] // 10**6, r["last_value"]) for r in got.collect()}
    assert closed == {(0, 35, 20.0), (60, 85, 70.0), (1000, 1015, 1000.0)}
    # The batch rule puts its zero at the same moments.
    batch = series.reset_stale(df.withColumn("ts", F.col("t") * SECOND), ["metric"]).filter("stale")
    assert {c[1] for c in closed} <= {r["ts"] // SECOND for r in batch.collect()}


TASK = ("service string, framework string, param double, gpu_spec int, gpu_num int, max_num_seqs int, "
        "tensor_parallel_size int, gpu_memory_utilization double, replicas int")


def test_detection_loop_over_batches(spark, samples, parts, tmp_path):
    tasks = spark.createDataFrame([("s", "mistral", 7.0, 24, 8, 12, 1, 0.9, 2)], TASK)
    out = f"{tmp_path}/out"
    runs.detection_stream(stream_of(spark, parts), tasks, out, f"{tmp_path}/cp").start().awaitTermination()
    records = runs.detection_history(spark, out).orderBy("timestamp").collect()
    stored = spark.read.parquet(f"{out}/samples")
    assert stored.count() == samples.count()
    assert len(records) == 3 and records[0]["current"]["replicas"] == 2
    # Each tick starts from the replica count the one before it recommended.
    assert [r["current"]["replicas"] for r in records[1:]] == [r["recommended"]["replicas"] for r in records[:-1]]
    end = records[0]["timestamp"] * 1000
    first = samples.withColumn("ts", F.unix_micros("ts")).filter(F.col("ts") <= end)
    batch = detection_pass(first, tasks, F.lit(records[0]["timestamp"])).first()
    assert batch["recommended"] == records[0]["recommended"]


def test_map_labels_identify_series(spark):
    from fleetlens.operators.ranges import promote_labels
    from fleetlens.plans.views import View, run_view

    rows = [("m", {"exported_job": j, "x": x}, t, v) for j, x, v in (("a", "1", 1.0), ("a", "2", 2.0), ("b", "1", 4.0)) for t in (0, MINUTE)]
    df = spark.createDataFrame([*rows, ("m", {}, 0, 9.0)], "metric string, labels map<string,string>, ts bigint, value double")
    view = View("v", "gauge", ("m",), "sum", ("exported_job",))
    with pytest.raises(ValueError):
        run_view(view, df, 0, MINUTE)
    got = run_view(view, promote_labels(df, ["exported_job"]), 0, MINUTE)
    assert rows_of(got.select("exported_job", "ts", "value")) == [("a", 0, 3.0), ("a", MINUTE, 3.0), ("b", 0, 4.0), ("b", MINUTE, 4.0)]


def test_views_over_batches_equal_one_run(spark, samples, parts, tmp_path):
    """Rates and gauges evaluated tick by tick, with windows reaching into earlier batches."""
    from fleetlens.plans.views import View, run_dashboard

    views = [View("r", "rate", ("pending",), "sum", ("service",), window=300), View("g", "gauge", ("running",), "avg", ("service",))]
    start = 1713164400 * SECOND
    runs.view_stream(stream_of(spark, parts), views, f"{tmp_path}/out", f"{tmp_path}/cp", start).start().awaitTermination()
    schema = "view string, exported_job string, device string, ts bigint, value double"
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out/values").select("view", "ts", F.round("value", 9))
    last = start + (7185 - 300) // 60 * MINUTE
    batch = run_dashboard(views, samples.withColumn("ts", F.unix_micros("ts")), start, last)
    assert rows_of(got) == rows_of(batch.select("view", "ts", F.round("value", 9)))
    assert len(list((tmp_path / "out" / "values").glob("batch=*"))) >= 3


def test_views_store_only_what_they_read(spark, tmp_path):
    """Metrics that no view reads move the clock, also alone in a batch, but are not stored."""
    from fleetlens.plans.views import View, run_dashboard

    start = 1713164400
    for name, metric, lo, hi in (("b0", "hits", 0, 600), ("b1", "other", 0, 1800), ("b2", "hits", 600, 1200)):
        rows = [("s", "r0", metric, start + t, float(t)) for t in range(lo, hi, 15)]
        df = spark.createDataFrame(rows, "service string, replica string, metric string, t bigint, value double")
        df.select("service", "replica", "metric", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    views = [View("r", "rate", ("hits",), "sum", ("service",), window=300)]
    for name in ("b0", "b1", "b2"):
        stream = stream_of(spark, f"{tmp_path}/in/{{{','.join(f'b{i}' for i in range(int(name[1]) + 1))}}}")
        runs.view_stream(stream, views, f"{tmp_path}/out", f"{tmp_path}/cp", start * SECOND).start().awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/out/samples")
    assert {r["metric"] for r in stored.select("metric").distinct().collect()} == {"hits"} and stored.count() == 80
    (seen,) = spark.read.parquet(f"{tmp_path}/out/ticks/batch=1").select("seen").first()
    assert seen == (start + 1785) * SECOND
    # Ticks before the second batch's clock are done with what had come by then.
    got = spark.read.schema("view string, ts bigint, value double").parquet(f"{tmp_path}/out/values")
    known = spark.read.parquet(f"{tmp_path}/in/b0").withColumn("ts", F.unix_micros("ts"))
    batch = run_dashboard(views, known, start * SECOND, start * SECOND + (1785 - 300) // 60 * MINUTE)
    assert got.count() > 0 and rows_of(got.select("view", "ts", F.round("value", 9))) == rows_of(batch.select("view", "ts", F.round("value", 9)))


def test_kafka_and_parquet_writers_are_configured(spark, parts, tmp_path):
    from fleetlens.sources.sinks import write_telemetry_stream

    q = write_telemetry_stream(stream_of(spark, parts), f"{tmp_path}/cp", path=f"{tmp_path}/out").start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 480 * 2 * 5


def test_late_batches_and_new_services(spark, tmp_path):
    """A batch of late rows judges nothing and keeps the clock; a service of the third batch is judged from then on."""
    def batch(name, service, start):
        metrics = ["active", "running", "pending", "server_new", "server_success", "kv_cache"]
        rows = [(service, "r0", m, start + 60 * i, 90.0) for m in metrics for i in range(60)]
        df = spark.createDataFrame(rows, "service string, replica string, metric string, t bigint, value double")
        path = f"{tmp_path}/in/{name}"
        df.select("service", "replica", "metric", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.parquet(path)

    known = [("a", "mistral", 7.0, 24, 8, 12, 1, 0.9, 1)]
    out = f"{tmp_path}/out"
    ends = []
    for name, service, start in (("b0", "a", 36_000), ("b1", "a", 30_000), ("b2", "b", 42_000)):
        if name == "b2":
            known.append(("b", "mistral", 7.0, 24, 8, 12, 1, 0.9, 1))
        batch(name, service, start)
        stream = stream_of(spark, f"{tmp_path}/in/*")
        runs.detection_stream(stream, lambda: spark.createDataFrame(known, TASK), out, f"{tmp_path}/cp").start().awaitTermination()
        ends.append([(r["task"], r["timestamp"]) for r in runs.detection_history(spark, out).orderBy("timestamp", "task").collect()])
    assert ends[1] == ends[0] and {t for _, t in ends[0]} == {(36_000 + 59 * 60) * 1000}
    assert ("b", (42_000 + 59 * 60) * 1000) in ends[2]
    assert {r["service"] for r in spark.read.schema(TASK).parquet(f"{out}/tasks/batch=2").collect()} == {"a", "b"}


def test_views_without_grouping_keep_all_labels(spark):
    from fleetlens.plans.views import BY_NAME, run_dashboard, run_view

    rows = [("DCGM_FI_DEV_GPU_UTIL", "gpu0", host, 0, v) for host, v in (("h1", 10.0), ("h2", 20.0))] + [("other", "gpu0", "h1", 0, 99.0)]
    df = spark.createDataFrame(rows, "metric string, device string, host string, ts bigint, value double")
    assert rows_of(run_view(BY_NAME["gpu_util"], df, 0, 0).select("device", "host", "value")) == [("gpu0", "h1", 10.0), ("gpu0", "h2", 20.0)]
    long = run_dashboard([BY_NAME["gpu_util"]], df, 0, 0).collect()
    assert sorted(r["series"] for r in long) == ['{"device":"gpu0","host":"h1"}', '{"device":"gpu0","host":"h2"}']


def put(spark, path, rows, schema="service string, t double, value double"):
    df = spark.createDataFrame(rows, schema)
    seconds = F.timestamp_micros((F.col("t") * SECOND).cast("long"))
    df.withColumn("ts", seconds).drop("t").coalesce(1).write.mode("append").parquet(path)


def live_stream(spark, path, schema="service string, value double, ts timestamp"):
    return readers.read_telemetry_stream(spark, schema, path=path, options={"maxFilesPerTrigger": "1"})


def test_a_late_batch_changes_exactly_its_windows(spark, tmp_path):
    sums = {"total": F.col("value"), "n": F.lit(1)}

    def run():
        stream = live_stream(spark, f"{tmp_path}/in")
        live.window_stream(stream, ["service"], sums, f"{tmp_path}/out", f"{tmp_path}/cp").start().awaitTermination()

    put(spark, f"{tmp_path}/in", [("a", 90_000 + 7.5 * k, 1.0) for k in range(40)] + [(None, 90_000.0, 5.0)])
    run()
    put(spark, f"{tmp_path}/in", [("a", 200_000.0, 2.0)])
    run()
    # A day late: one window known, one new; and one row on the edge of a window.
    put(spark, f"{tmp_path}/in", [("a", 90_001.25, 10.0), ("a", 50_000.0, 3.0), ("a", 90_060.0, 1.0), (None, 90_001.0, 1.0)])
    run()
    changes = spark.read.parquet(f"{tmp_path}/out/changes/batch=2")
    assert sorted((str(r["service"]), r["w_start"] // SECOND, r["total"], r["n"]) for r in changes.collect()) == [
        ("None", 90_000, 6.0, 2), ("a", 49_980, 3.0, 1), ("a", 90_000, 18.0, 9), ("a", 90_060, 9.0, 9)]
    table = runs.read_changelog(spark, f"{tmp_path}/out/changes", ["service", "w_start"])
    assert table.agg(F.sum("n")).first()[0] == 46 and table.filter("w_end - w_start <> 60000000").count() == 0


def test_sliding_windows_hold_each_row_as_often_as_they_overlap(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [("a", t, 1.0) for t in (100.0, 119.999999, 120.0, 130.5)])
    stream = live_stream(spark, f"{tmp_path}/in")
    live.window_stream(stream, ["service"], {"n": F.lit(1)}, f"{tmp_path}/out", f"{tmp_path}/cp", 50 * SECOND, 20 * SECOND).start().awaitTermination()
    got = {r["w_start"] // SECOND: r["n"] for r in runs.read_changelog(spark, f"{tmp_path}/out/changes", ["service", "w_start"]).collect()}
    assert got == {w: n for w in range(0, 200, 20) if (n := sum(w <= t < w + 50 for t in (100.0, 119.999999, 120.0, 130.5)))}


def test_counters_never_fall(spark, tmp_path):
    """Three batches, one of them late; the last one is repeated after its offset was lost."""
    sums = {"n": F.lit(1), "total": F.col("value")}

    def run(checkpoint="cp"):
        stream = live_stream(spark, f"{tmp_path}/in")
        live.counter_stream(stream, ["service"], sums, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", expiry=1000 * SECOND).start().awaitTermination()

    for rows in ([("a", 100.0, 1.0), ("b", 110.0, 1.0)], [("a", 500.0, 2.0)], [("a", 50.0, 4.0), ("c", 1200.0, 1.0)]):
        put(spark, f"{tmp_path}/in", rows)
        run()
    want = {("a", 3, 7.0), ("c", 1, 1.0)}
    totals = lambda: {(r["service"], r["n"], r["total"]) for r in live.read_counters(spark, f"{tmp_path}/out").collect()}
    # b has expired: its last event is 1090 seconds before the newest one.
    assert totals() == want
    for name in ("2", ".2.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    run()
    assert totals() == want
    samples = spark.read.parquet(f"{tmp_path}/out/samples")
    by_batch = [(r["batch"], r["ts"] // SECOND, r["total"]) for r in samples.filter("service = 'a'").orderBy("batch").collect()]
    assert by_batch == [(0, 100, 1.0), (1, 500, 3.0), (2, 500, 7.0)]
    put(spark, f"{tmp_path}/in", [("b", 1300.0, 1.0)])
    run()
    assert totals() == want | {("b", 1, 1.0)}


def test_spans_without_partner_go_to_a_side_table(spark, tmp_path):
    schema = "trace_id string, span_id string, parent_id string, service string, kind string, status string, duration_ms double, t double"
    spans = [("t", "1", None, "front", "client", "ok", 9.0, 10.0), ("t", "3", None, "front", "client", "ok", 9.0, 12.0)]
    put(spark, f"{tmp_path}/in", spans, schema)
    put(spark, f"{tmp_path}/in", [("t", "2", "1", "back", "server", "error", 4.0, 11.0), ("t", "4", "9", "back", "server", "ok", 4.0, 13.0)], schema)
    # Later spans on both sides move the watermark over the two that are alone.
    late = [("u", "1", None, "front", "client", "ok", 9.0, 9000.0), ("u", "2", "1", "back", "server", "ok", 6.0, 9001.0)]
    put(spark, f"{tmp_path}/in", late, schema)
    stream = live_stream(spark, f"{tmp_path}/in", schema.replace(", t double", ", ts timestamp"))
    live.graph_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", bounds=(5,)).start().awaitTermination()
    edges = live.read_graph(spark, f"{tmp_path}/out").collect()
    assert [(r["client"], r["server"], r["calls"], r["failed"], r["le_5"], r["mean_ms"]) for r in edges] == [("front", "back", 2, 1, 1, 5.0)]
    alone = spark.read.parquet(f"{tmp_path}/out/unmatched")
    assert {(r["span_id"], r["kind"]) for r in alone.collect()} >= {("3", "client")} and not alone.filter("trace_id = 'u'").count()


def test_compaction_bounds_folders_and_loses_nothing(spark, tmp_path):
    """Killed before its manifest or before it cleans up, repeated, and with batches that come afterwards."""
    path = f"{tmp_path}/samples"
    schema = spark.createDataFrame([], "service string, ts timestamp, value double").schema

    def put_batch(n, days):
        rows = [("s", float(day * 86_400 + n), float(n)) for day in days]
        df = spark.createDataFrame(rows, "service string, t double, value double").select("service", F.timestamp_micros((F.col("t") * SECOND).cast("long")).alias("ts"), "value")
        assert stores.store_batch(df, n, path) == (max(days) * 86_400 + n) * SECOND

    def found():
        return sorted((r["ts"] // SECOND, r["value"], r["batch"]) for r in stores.read_days(spark, path, schema, 0, 9).collect())

    def folders():
        return len(list((tmp_path / "samples").glob("day=*/batch=*")))

    for n in range(4):
        put_batch(n, [1, 2] if n % 2 else [1])
    want = found()
    assert len(want) == 6 and folders() == 6
    # Killed while writing: files of a version without a manifest.
    spark.createDataFrame([("x", 86_400 * SECOND, 9.0, 0)], "service string, ts long, value double, batch long").write.parquet(f"{path}-merged/data/version=2/day=1")
    assert found() == want
    assert stores.compact(spark, path, schema, 2) == 2
    assert found() == want and folders() == 2
    # Killed before the folders were removed: a batch that is merged already is there again.
    put_batch(1, [1, 2])
    assert found() == want
    put_batch(4, [2, 3])
    want = sorted([*want, (2 * 86_400 + 4, 4.0, 4), (3 * 86_400 + 4, 4.0, 4)])
    assert found() == want
    assert stores.compact(spark, path, schema, 4) == 3 and stores.compact(spark, path, schema, 4) == 0
    assert found() == want and folders() == 0
    assert len(list((tmp_path / "samples-merged" / "data").glob("version=*/day=*"))) == 3
    assert [v for t, v, _ in sorted((r["ts"], r["value"], r["batch"]) for r in stores.read_days(spark, path, schema, 3, 3).collect())] == [4.0]


def test_detection_loop_compacts_as_it_goes(spark, samples, parts, tmp_path):
    tasks = spark.createDataFrame([("s", "mistral", 7.0, 24, 8, 12, 1, 0.9, 2)], TASK)
    runs.detection_stream(stream_of(spark, parts), tasks, f"{tmp_path}/plain", f"{tmp_path}/cp1").start().awaitTermination()
    runs.detection_stream(stream_of(spark, parts), tasks, f"{tmp_path}/merged", f"{tmp_path}/cp2", compact_every=1).start().awaitTermination()
    plain, merged = (rows_of(runs.detection_history(spark, f"{tmp_path}/{x}").select("task", "timestamp", "recommended")) for x in ("plain", "merged"))
    assert plain == merged and len(plain) == 3
    assert len(list((tmp_path / "merged" / "samples").glob("day=*/batch=*"))) == 1
