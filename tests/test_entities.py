"""Lists, load tests, sizes, readers and sinks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog import HOUR, SECOND
from fleetlens import catalog as cat
from fleetlens.functions import expressions as ex
from fleetlens.operators import chat, entities, inventory, loadtest
from fleetlens.operators import spans as sp
from fleetlens.sources import entity_tables as tables
from fleetlens.sources import readers, sinks


def test_page_past_the_end_and_bad_pages(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    assert entities.paginate(df, ["k"], page=4, size=10).count() == 0
    assert [r["k"] for r in entities.paginate(df, ["k"], 3, 10, "k", "desc").collect()] == [4, 3, 2, 1, 0]
    assert entities.page_summary(df, 3, 10).first().asDict() == {"page": 3, "size": 10, "total_num": 25, "total_page": 3, "num": 5}
    assert entities.page_summary(df, 4, 10).first()["num"] == 0
    for page, size in ((0, 10), (1001, 10), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            entities.paginate(df, ["k"], page, size)
    with pytest.raises(ValueError):
        entities.paginate(df, ["k"], order_by="nope", order_type="asc")


def test_pages_are_planned_as_top_k(spark):
    plan = entities.paginate(spark.range(1000), ["id"], 2, 10, "id", "desc")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_upsert_leaves_null_fields(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", None)], "k int, name string, n int")
    assert sorted(map(tuple, entities.upsert(old, new, ["k"]).collect())) == [(1, "a", 5), (2, "b", 9), (3, "c", None)]
    assert entities.upsert(old, new, ["k"], insert=False).count() == 2
    steps = spark.createDataFrame([(1, "x", None, 1), (1, None, 7, 2), (1, "y", None, 3)], "k int, name string, n int, step int")
    assert sorted(map(tuple, entities.upsert(old, steps, ["k"], order="step").collect())) == [(1, "y", 7), (2, "b", 6)]


def test_window_cover_is_exact(spark):
    rng = random.Random(2)
    lengths = [0, 5, 60, 61, 119, 600, 3601, 90_000, 0.000001, 61.5]
    windows = [(i, a * SECOND + i % 3, a * SECOND + i % 3 + round(rng.choice(lengths) * SECOND)) for i, a in enumerate(rng.sample(range(10_000, 40_000), 60))]
    df = spark.createDataFrame(windows, "i int, a bigint, b bigint")
    cover = df.select("i", "a", "b", F.inline(loadtest._cover(F.col("a"), F.col("b")))).collect()
    seen = {i: [] for i, _, _ in windows}
    for r in cover:
        seen[r["i"]].append((r["lo"], r["hi"] + r["size"] if r["size"] > 1 else r["hi"] + 1))
    for i, a, b in windows:
        parts = sorted(seen[i])
        assert parts[0][0] == a and parts[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    assert max(sum(1 for r in cover if r["i"] == i and r["size"] < HOUR) for i, _, _ in windows) <= 30


def test_window_join_with_a_hot_block(spark):
    rng = random.Random(4)
    samples = [("m", f"j{j}", HOUR + t * SECOND + t % 2, float(rng.randint(0, 3))) for j in range(5) for t in sorted(rng.sample(range(4000), 200))]
    windows = [(i, HOUR + (i % 7) * SECOND, HOUR + (i % 7) * SECOND + 60 * SECOND * (1 + i % 50)) for i in range(120)]
    sdf = spark.createDataFrame(samples, "metric string, job string, ts bigint, value double")
    wdf = spark.createDataFrame(windows, "test_id int, w_start bigint, w_end bigint")
    got = {(r["test_id"], r["job"]): (r["v_sum"], r["v_n"], r["v_peak"]) for r in loadtest.series_in_windows(wdf, sdf, ["metric", "job"]).collect()}
    expected = {}
    for i, a, b in windows:
        for j in range(5):
            values = [v for _, job, t, v in samples if job == f"j{j}" and a <= t <= b]
            if values:
                expected[i, f"j{j}"] = (sum(values), len(values), max(values))
    assert got == expected


def test_robust_average_ignores_flat_zero_series(spark):
    rows = [("t", "a", 0.0), ("t", "a", 0.0), ("t", "b", 4.0), ("t", "b", 0.0), ("u", "a", 0.0)]
    df = spark.createDataFrame(rows, "test_id string, job string, value double")
    got = {r["test_id"]: r["robust_avg"] for r in loadtest.robust_metric_avg(df, ["test_id"], ["job"]).collect()}
    assert got == {"t": 2.0, "u": 0.0}


def test_sizes(spark):
    cases = {
        "24 GB": 24 * 1024**3, "24GiB": 24 * 1024**3, "1.5Ki": 1536, "80 gibibytes": 80 * 1024**3, "7 tb": 7 * 1024**4,
        "3 TiB": 3 * 1024**4, "2YB": 2 * 1024**8, "512": 512, "512 bytes": 512, "9B": 9, "2 kilobytes": 2048, "5 eb": 5 * 1024**6,
        "12345678901": 12345678901, "99999999999999999999999 GB": None, "oops": None, "5 parsecs": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "size_text string")
    got = {r["size_text"]: r["size_bytes"] for r in inventory.normalise_inventory(df).collect()}
    assert {k: None if v is None else int(v) for k, v in got.items()} == cases
    decimal = df.select("size_text", ex.parse_size(F.col("size_text"), binary=False).alias("b")).collect()
    assert {r["size_text"]: r["b"] for r in decimal}["24 GB"] == 24 * 10**9


def test_size_text_strips_zeros_after_the_point_only(spark):
    cases = {80 * 1024**3: "80GiB", 1536: "1.5KiB", 1023: "1023B", 100 * 1024**2: "100MiB", 1152: "1.12KiB", 0: "0B"}
    df = spark.createDataFrame([(b,) for b in cases], "b bigint")
    assert {r["b"]: r["t"] for r in df.select("b", ex.format_size(F.col("b")).alias("t")).collect()} == cases
    assert df.select(ex.format_size(F.lit(5_000_000), binary=False)).first()[0] == "5MB"


def test_scalar_expressions(spark):
    row = spark.range(1).select(
        ex.duration_seconds(F.lit(2), F.lit("hour")).alias("h"),
        ex.duration_seconds(F.lit(2), F.lit("fortnight")).alias("bad"),
        ex.epoch_to_seconds(F.lit(1713164400123)).alias("ms"),
        ex.epoch_to_seconds(F.lit(1713164400)).alias("s"),
        ex.clip(F.lit(5), F.lit(4), F.lit(3)).alias("clipped"),
        ex.nearest_of([7, 13, 70], F.lit(10.0)).alias("tie"),
        ex.divisors(F.lit(12)).alias("divs"),
        ex.throughput_unit_index(F.lit(0.001)).alias("tiny"),
        ex.throughput_unit_index(F.lit(1e20)).alias("huge"),
        ex.success_percent(F.lit(1), F.lit(3)).alias("rate"),
        ex.success_percent(F.lit(1), F.lit(None).cast("int")).alias("none"),
    ).first()
    assert (row["h"], row["bad"], row["ms"], row["s"], row["clipped"]) == (7200, None, 1713164400, 1713164400, 3)
    assert (row["tie"], row["divs"], row["tiny"], row["huge"]) == (7.0, [1, 2, 3, 4, 6, 12], 0, 4)
    assert (row["rate"], row["none"]) == (33.333, 0.0)


def test_range_response_cases(spark):
    def body(status, result):
        return json.dumps({"status": status, "data": {"resultType": "matrix", "result": result}})

    good = body("success", [{"metric": {"job": "a"}, "values": [[1.000001, "1.5"], [2, "x"], ["t", "3"], [], [7], [4, "NaN"]]}])
    rows = [(1, good), (2, body("error", [{"metric": {}, "values": [[1, "1"]]}])), (3, body("success", [])), (4, "junk")]
    got = readers.parse_range_response(spark.createDataFrame(rows, "id int, body string"), "body", ["id"]).orderBy("ts").collect()
    assert [(r["id"], r["ts"]) for r in got] == [(1, 1_000_001), (1, 4 * SECOND)]
    assert got[0]["labels"] == {"job": "a"} and got[0]["value"] == 1.5 and got[1]["value"] != got[1]["value"]


def test_metric_dictionary_file(spark, tmp_path):
    path = tmp_path / "fields.csv"
    path.write_text("# Format\n\nFIELD_A,  gauge, Clock (in MHz), sampled.\nFIELD_B ,   counter, Energy\n# FIELD_C, gauge, off\nFIELD_D, label, Version\n")
    df = readers.read_metric_dictionary(spark, str(path))
    assert sorted(map(tuple, df.collect())) == [
        ("FIELD_A", "gauge", "Clock (in MHz), sampled."), ("FIELD_B", "counter", "Energy"), ("FIELD_D", "label", "Version")
    ]
    assert {r["field"] for r in inventory.enabled_fields(df).collect()} == {"FIELD_A", "FIELD_B"}


def test_load_report_files(spark, tmp_path):
    # A load generator's default columns; the order of columns doesn't matter, commas may be quoted.
    head = ("timeStamp,elapsed,label,responseCode,responseMessage,threadName,dataType,success,failureMessage,bytes,sentBytes,"
            "grpThreads,allThreads,URL,Latency,IdleTime,Connect")
    tail = "10,5,1,1,http://x,3,0,1"
    for test, lines in {
        "t1": [f"1,10,g,200,OK,u 1-1,text,true,,{tail}", f'2,30,g,500,"no, really",u 1-1,text,false,"expected ""200"", got 500",{tail}'],
        "t2": [f"1,7,g,200,OK,u 1-1,text,true,,{tail}"],
    }.items():
        folder = tmp_path / test / "report"
        os.makedirs(folder)
        (folder / "report.log").write_text("\n".join([head, *lines]) + "\n")
    out = loadtest.summarise_load_report(readers.read_load_report(spark, f"{tmp_path}/*/report"))
    assert {tuple(r) for r in out.collect()} == {("t1", 2, 1, 20.0), ("t2", 1, 1, 7.0)}


def test_headers_are_found_without_sorting_lines(spark, tmp_path):
    """Several files in a split and several splits of a file; the plan that reads the lines holds no sort."""
    head = "elapsed,success,failureMessage"
    for test, (first, n) in {"t1": (head, 1), "t2": ("success,elapsed,failureMessage", 2), "t3": (head, 400), "t4": (f"\ufeff{head}", 3)}.items():
        folder = tmp_path / test / "report"
        os.makedirs(folder)
        row = "true,10," if test == "t2" else '10,true,"two\nlines"' if test == "t1" else "10,true,"
        (folder / "report.log").write_text("\n".join([first, *[row] * n]) + "\n")
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        out = loadtest.summarise_load_report(readers.read_load_report(spark, f"{tmp_path}/*/report")).collect()
        lines = spark.read.text(f"{tmp_path}/*/report").select(
            "value", F.col("_metadata.file_path").alias("file"), F.lit(0).alias("start"), F.monotonically_increasing_id().alias("id"))
        assert lines.rdd.getNumPartitions() > 4
        assert "Sort" not in readers._first_lines(lines)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert {tuple(r) for r in out} == {("t1", 1, 1, 10.0), ("t2", 2, 2, 10.0), ("t3", 400, 400, 10.0), ("t4", 3, 3, 10.0)}


def test_engine_log_lines(spark):
    good = ("INFO Avg prompt throughput: 1.5 tokens/s, Avg generation throughput: 20.0 tokens/s, Running: 3 reqs, "
            "Swapped: 0 reqs, Pending: 7 reqs, GPU KV cache usage: 12.5%, CPU KV cache usage: 0.0%")
    lines = [("s", 1, good), ("s", 2, good.replace("1.5 tokens", "2 tokens")), ("s", 3, "hello")]
    got = sp.parse_engine_log(spark.createDataFrame(lines, "service string, ts bigint, line string")).collect()
    assert {(r["ts"], r["metric"]): r["value"] for r in got} == {
        (1, m): v for m, v in zip(cat.ENGINE_LOG_METRICS, [1.5, 20.0, 3.0, 0.0, 7.0, 12.5, 0.0])
    }


def test_bad_json_columns_read_as_null(spark):
    rows = spark.createDataFrame([(1, '{"duration": 5}'), (2, "{oops"), (3, None)], "id int, test_spec string")
    got = {r["id"]: r["test_spec"] for r in readers.read_entity_table(rows, {"test_spec": "struct<duration int>"}).collect()}
    assert got[1]["duration"] == 5 and got[2] is None and got[3] is None


def test_context_window_keeps_order(spark):
    rows = [(1, t, "user", f"m{t}") for t in random.Random(1).sample(range(9), 9)] + [(2, 0, "user", "only")]
    got = {r["conv_id"]: [m["content"] for m in r["messages"]] for r in chat.context_window(
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {1: ["m4", "m5", "m6", "m7", "m8"], 2: ["only"]}


def test_history_table_bounds_and_bad_records(spark, tmp_path):
    config = F.struct(F.lit(1).alias("max_num_seqs"), F.lit(1).alias("tensor_parallel_size"), F.lit(0.5).alias("gpu_memory_utilization"), F.lit(1).alias("replicas"))
    rows = spark.range(12).select(F.lit("t").alias("task"), F.col("id").alias("timestamp"), F.lit(True).alias("is_anomaly"), config.alias("recommended"), config.alias("current"))
    path = str(tmp_path / "history")
    sinks.append_history(rows, path)
    got = sinks.read_history(spark, path, "t").collect()
    assert [r["timestamp"] for r in got] == list(range(11, 0, -1))
    spark.createDataFrame([("t", 99, "{broken")], "task string, timestamp bigint, record string").write.mode("append").parquet(path)
    assert [r["timestamp"] for r in sinks.read_history(spark, path, "t").collect()] == list(range(11, 1, -1))
    compacted = sinks.compact_history(spark, path)
    assert spark.read.parquet(compacted).count() == 11 and spark.read.parquet(path).count() == 13


def test_samples_table_is_pruned(spark, tmp_path):
    rows = spark.createDataFrame([("a", {"k": "v"}, 10 * SECOND, 1.0), ("b", {}, 90_000 * SECOND, 2.0)], "metric string, labels map<string,string>, ts bigint, value double")
    path = str(tmp_path / "samples")
    sinks.append_samples(rows, path)
    read = sinks.read_samples(spark, path, ["b"], 89_990 * SECOND, 90_010 * SECOND, 300 * SECOND)
    assert [r["value"] for r in read.collect()] == [2.0]
    assert sinks.read_samples(spark, path, ["b"], 0, 89_999 * SECOND, 300 * SECOND).count() == 0
    filters = read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "metric" in filters and "day" in filters


def test_prompts_are_found_by_header(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,question\n7,"hello, ""you""\nthere"\n')
    assert [tuple(r) for r in readers.read_prompt_dataset(spark, str(tmp_path)).collect()] == [('hello, "you"\nthere',)]
    assert [tuple(r) for r in readers.read_prompt_dataset(spark, str(tmp_path), "question string, id int").collect()] == [('hello, "you"\nthere', 7)]


def test_unreadable_records_go_to_a_side_table(spark):
    rows = spark.createDataFrame([('{"ts": 5, "value": 1.5}',), ("{broken",), ('{"value": 2}',), (None,)], "value string")
    good, bad = readers.split_records(rows, "value", "ts bigint, value double")
    assert [tuple(r) for r in good.collect()] == [(5, 1.5)]
    assert sorted(map(str, (r["raw"] for r in bad.collect()))) == ["None", '{"value": 2}', "{broken"]


def test_unknown_duration_units_have_no_window(spark):
    tests = spark.createDataFrame([(1, 100, 2, "min"), (2, 100, 5, "fortnight"), (3, 100, None, "sec"), (4, 100, 1, "week"), (5, 100, 10**9, "hour")],
                                  "test_id int, created bigint, duration bigint, duration_unit string")
    assert {r["test_id"]: r["w_end"] - r["w_start"] for r in loadtest.test_windows(tests).collect()} == {1: 120 * SECOND, 4: 604_800 * SECOND}
    assert {r["test_id"] for r in loadtest.unreadable_durations(tests).collect()} == {2, 3, 5}


def test_charts_show_whole_tests(spark):
    tests = spark.createDataFrame([(1, 1000, 45, "sec")], "test_id int, created bigint, duration bigint, duration_unit string")
    assert loadtest.test_query_window(tests, F.lit(10**9)).first()["q_end"] == 1225
    assert loadtest.test_query_window(tests, F.lit(10**9), compat=True).first()["q_end"] == 1190


def test_only_forward_calls_produce_tokens(spark):
    rows = [("s", "Llama.forward", {"batch_size": "4"}), ("s", "Llama.forward", {}), ("s", "POST /generate", {"batch_size": "9"})]
    got = sp.generated_tokens(spark.createDataFrame(rows, "service string, name string, attrs map<string,string>")).collect()
    assert [tuple(r) for r in got] == [("s", 2, 5)]


def test_throughput_takes_stepped_means_of_jobs(spark):
    """Against a plain range query: lookback before the window, two series of a job, a job at zero, an empty window."""
    rng = random.Random(7)
    rows = [("g", "a", x, t, float(rng.randrange(50))) for x, every in (("1", 17), ("2", 95)) for t in range(900, 2000, every)]
    rows += [("g", "b", "1", t, 0.0) for t in range(900, 2000, 30)] + [("p", "a", "1", 950, 8.0), ("p", "a", "1", 1500, 3.0)]
    # Many samples a second, values whose sums round, and a job that falls to zero before most windows.
    rows += [("g", "c", x, t / 8, 0.1 * rng.randrange(9)) for x in "12" for t in range(8 * 1100, 8 * 1160)]
    rows += [("g", "d", x, t, v) for x, v in (("1", 0.1), ("2", 0.2), ("3", 0.7)) for t in (700, 720)]
    rows += [("g", "d", x, t, 0.0) for x in "123" for t in range(730, 2000, 50)]
    rows = [(m, j, x, round(t * SECOND), v) for m, j, x, t, v in rows]
    samples = spark.createDataFrame(rows, "metric string, exported_job string, x string, ts bigint, value double")
    tests = [(1, 1000, 5, "min"), (2, 1013, 1, "sec"), (3, 5000, 1, "min"), (4, 1000, 5, "min"), (5, 1400, 2, "hour")]
    got = loadtest.test_throughput(spark.createDataFrame(tests, "test_id int, created bigint, duration bigint, duration_unit string"), samples, "p", "g")

    def plain(metric, start, end):
        values = []
        for job in "abcd":
            means = []
            for t in range(start * SECOND, end * SECOND + 1, 60 * SECOND):
                last = {}
                for m, j, x, ts, v in sorted(rows, key=lambda r: r[3]):
                    if (m, j) == (metric, job) and t - 300 * SECOND < ts <= t:
                        last[x] = v
                if last:
                    means.append(sum(last.values()) / len(last))
            values += means if any(means) else []
        return int(round(sum(values) / len(values), 9)) if values else 0

    seconds = {"sec": 1, "min": 60, "hour": 3600}
    want = {i: tuple(plain(m, s, s + max(60, n * seconds[u])) for m in "pg") for i, s, n, u in tests}
    assert {r["test_id"]: (r["prompt_tps"], r["generation_tps"]) for r in got.collect()} == want
    assert want[1][0] > 0 and want[3] == (0, 0)


def test_sweep_of_means_equals_the_mean_at_every_moment(spark):
    """Segments of a job's mean against the series in view at random moments, over chunk edges and with odd values."""
    rng = random.Random(11)
    rows = []
    for x in range(6):
        t = 0.0
        for _ in range(60):
            t += rng.choice([0.000001, 0.5, 3, 40, 299.999999, 300, 700])
            rows.append(("m", "a", str(x), round(t * SECOND), rng.choice([0.0, 0.1, 0.2, 0.3, 5.0, 1e9])))
    rows += [("m", "b", "0", 100 * SECOND, float("inf")), ("m", "b", "1", 200 * SECOND, 1.0), ("m", "c", "0", 100 * SECOND, float("nan"))]
    samples = spark.createDataFrame(rows, "metric string, exported_job string, x string, ts bigint, value double")
    segments = loadtest.job_averages(samples).collect()
    for job in "abc":
        own = sorted((r["t"], r["t_end"], r["value"]) for r in segments if r["exported_job"] == job)
        assert all(p[1] <= q[0] for p, q in zip(own, own[1:]))
        moments = [rng.randrange(0, 8_000 * SECOND) for _ in range(300)] + [r[3] + d for r in rows for d in (-1, 0, 1)]
        for t in moments:
            last = {}
            for _, j, x, ts, v in sorted(rows, key=lambda r: r[3]):
                if j == job and t - 300 * SECOND < ts <= t:
                    last[x] = v
            here = [v for a, b, v in own if a <= t < b]
            if not last:
                assert not here
            else:
                want = sum(last.values()) / len(last)
                assert len(here) == 1 and (here[0] == pytest.approx(want, rel=1e-6, abs=1e-6, nan_ok=True))
                assert any(last.values()) or here[0] == 0.0


def test_reports_are_read_by_their_own_headers(spark, tmp_path):
    """A quoted line break is no second request, and runs whose columns differ in order or number are read together."""
    texts = {
        "a b": 'elapsed,success,failureMessage\n10,true,\n20,false,"lost\nconnection, ""why"""\n30,true,\n',
        "t[2]": "\ufefflabel,success,elapsed\nx,true,7\ny,false,9\n", "t3": "elapsed,label\n5,z\n", "t4": "success,elapsed\n",
    }
    for test, text in texts.items():
        (tmp_path / test / "report").mkdir(parents=True)
        (tmp_path / test / "report" / "log.csv").write_text(text, encoding="utf-8")
    rows = readers.read_load_report(spark, f"{tmp_path}/*/report")
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, [
        ("a b", True, 10.0), ("a b", False, 20.0), ("a b", True, 30.0), ("t[2]", True, 7.0), ("t[2]", False, 9.0), ("t3", None, 5.0)]))
    assert readers.read_load_report(spark, f"{tmp_path}/t4/report").count() == 0


def test_a_merge_rewrites_only_its_buckets(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["k"]
    rows = [(k, f"n{k}", 0) for k in range(1000)] + [(None, "nameless", 0)]
    tables.create_table(spark.createDataFrame(rows, "k int, name string, is_deleted int"), path, key, 64)
    before = sorted(os.listdir(f"{path}/data/version=0"))
    changes = [(k, f"x{k}") for k in (3, 5, 8, 1005, 1007, 11, 13, 17, 19, 23)]
    assert tables.upsert_table(spark, path, spark.createDataFrame(changes, "k int, name string"), key) == 1
    assert 1 <= len([f for f in os.listdir(f"{path}/data/version=1") if f.startswith("bucket=")]) <= 10
    assert sorted(os.listdir(f"{path}/data/version=0")) == before
    want = {k: n for k, n, _ in rows} | dict(changes)
    assert {r["k"]: r["name"] for r in tables.read_table(spark, path).collect()} == want
    assert tables.read_table(spark, path, 0).count() == 1001
    # A merge that is killed before its manifest leaves nothing that counts, and the next one replaces it.
    left_over = f"{path}/data/version=2/bucket=0"
    spark.createDataFrame([(-1, "half", 0)], "k int, name string, is_deleted int").write.parquet(left_over)
    assert {r["k"]: r["name"] for r in tables.read_table(spark, path).collect()} == want
    assert tables.hard_delete_table(spark, path, spark.createDataFrame([(k,) for k in range(500)], "k int"), key) == 2
    assert tables.soft_delete_table(spark, path, spark.createDataFrame([(700,), (700,)], "k int"), key) == 3
    left = {r["k"]: r["is_deleted"] for r in tables.read_table(spark, path).collect()}
    assert left.keys() == {k for k in want if k is None or k >= 500} and {k for k, gone in left.items() if gone} == {700}
    assert tables.upsert_table(spark, path, spark.createDataFrame([], "k int, name string"), key) == 3


def test_empty_entity_tables(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, name string, is_deleted int"
    tables.create_table(spark.createDataFrame([], schema), path, ["k"], 8)
    assert tables.read_table(spark, path).count() == 0
    tables.upsert_table(spark, path, spark.createDataFrame([(1, "a", 0)], schema), ["k"])
    tables.hard_delete_table(spark, path, spark.createDataFrame([(1,)], "k int"), ["k"])
    assert tables.read_table(spark, path).count() == 0 and tables.read_table(spark, path, 1).count() == 1
    with pytest.raises(ValueError):
        tables.read_table(spark, path, 9)
