"""Registered queries: lists, joins, load tests, requests, spans, logs and chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.functions import expressions as ex
from fleetlens.operators import chat, entities, loadtest
from fleetlens.operators import spans as sp
from fleetlens.plans import sql as q
from fleetlens.plans.registry import query
from fleetlens.session import scratch_path
from fleetlens.sources import entity_tables as tables
from fleetlens.sources import fixtures as fx
from fleetlens.sources import readers

FUZZY = ["data_set", "test_status", "exported_job"]
T0 = 1704067200
LIST_ARGS = {
    "test_status": ["success", "running"], "instance_id": None, "no_such_column": 3, "fuzzy": "LOW",
    "start_time": T0 + 86400, "end_time": T0 + 20 * 86400, "page": 3, "size": 20, "order_by": "cost", "order_type": "desc",
}
LIST_WHERE = f"""test_status IN ('success', 'running') AND created >= {T0 + 86400} AND created <= {T0 + 20 * 86400}
    AND (data_set ILIKE '%LOW%' OR test_status ILIKE '%LOW%' OR exported_job ILIKE '%LOW%')"""
LIST_FILTERS = dict(start_column="created", end_column="created", fuzzy_columns=FUZZY)


@query("list_tests_page", q.with_ctes(q.TESTS) + f"""
  SELECT test_id, instance_id, data_set, test_status, created, cost FROM tests WHERE {LIST_WHERE}
  ORDER BY cost DESC, test_id LIMIT 20 OFFSET 40""")
def list_tests_page(spark, d):
    rows, _ = entities.list_rows(fx.tests(spark, d), LIST_ARGS, ["test_id"], **LIST_FILTERS)
    return rows.select("test_id", "instance_id", "data_set", "test_status", "created", "cost")


@query("list_tests_summary", q.with_ctes(q.TESTS) + f"""
  SELECT 3 AS page, 20 AS size, count(*) AS total_num, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_page,
         greatest(least(count(*) - 40, 20), 0) AS num FROM tests WHERE {LIST_WHERE}""")
def list_tests_summary(spark, d):
    _, summary = entities.list_rows(fx.tests(spark, d), LIST_ARGS, ["test_id"], **LIST_FILTERS)
    return summary


@query("newest_instances", q.with_ctes(q.INSTANCES) + "SELECT * FROM instances WHERE is_deleted = 0")
def newest_instances(spark, d):
    return entities.newest_instances(fx.instances(spark, d))


@query("fuzzy_search", q.with_ctes(q.INSTANCES) + """
  SELECT instance_id, instance_name, deploy_status FROM instances
  WHERE instance_name ILIKE '%r#0000_01%' OR deploy_status ILIKE '%r#0000_01%'""")
def fuzzy_search(spark, d):
    rows = fx.instances(spark, d).select("instance_id", "instance_name", "deploy_status")
    return entities.where_fuzzy(rows, ["instance_name", "deploy_status"], "R#0000_01")


@query("ignore_case_filter", q.with_ctes(q.INSTANCES) + """
  SELECT instance_id, deploy_status FROM instances WHERE lower(deploy_status) = lower('RunNing')""")
def ignore_case_filter(spark, d):
    rows = fx.instances(spark, d).select("instance_id", "deploy_status")
    return entities.apply_filters(rows, {"deploy_status": "RunNing"}, ignore_case=["deploy_status"])


@query("list_with_join", q.with_ctes(q.TESTS, q.INSTANCES) + """
  SELECT test_id, t.instance_id, i.instance_name, i.deploy_status, i.balance FROM tests t
  LEFT JOIN (SELECT * FROM instances WHERE is_deleted = 0) i USING (instance_id)""")
def list_with_join(spark, d):
    live = fx.instances(spark, d).filter("is_deleted = 0")
    out = entities.list_with_join(fx.tests(spark, d), [("instance", live, "instance_id", "instance_id")])
    return out.select(
        "test_id", "instance_id", F.col("instance.instance_name").alias("instance_name"),
        F.col("instance.deploy_status").alias("deploy_status"), F.col("instance.balance").alias("balance"),
    )


@query("search_instances", q.with_ctes(q.INSTANCES) + """
  SELECT instance_id, instance_name, deploy_status, status_text FROM instances i LEFT JOIN statuses s ON s.status = i.deploy_status
  WHERE contains(lower(instance_name), 'fail') OR contains(lower(status_text), 'fail')""")
def search_instances(spark, d):
    out = entities.search_instances(fx.instances(spark, d), fx.statuses(spark), "Fail")
    return out.select("instance_id", "instance_name", "deploy_status", "status_text")


@query("distinct_statuses", q.with_ctes(q.INSTANCES) + """
  SELECT DISTINCT deploy_status AS status, coalesce(status_text, deploy_status) AS status_text
  FROM instances i LEFT JOIN statuses s ON s.status = i.deploy_status""")
def distinct_statuses(spark, d):
    return entities.distinct_statuses(fx.instances(spark, d), fx.statuses(spark))


@query("label_instances", q.with_ctes(q.TESTS, q.INSTANCES) + """
  SELECT test_id, t.instance_id, coalesce(i.instance_name, CAST(t.instance_id AS VARCHAR)) AS instance_name FROM tests t
  LEFT JOIN (SELECT * FROM instances WHERE deploy_status <> 'failed') i USING (instance_id)""")
def label_instances(spark, d):
    known = fx.instances(spark, d).filter("deploy_status <> 'failed'")
    return entities.label_instances(fx.tests(spark, d).select("test_id", "instance_id"), known)


@query("mask_unfinished", q.with_ctes(q.TESTS) + """
  SELECT test_id, test_status, CASE WHEN test_status = 'success' THEN cost END AS cost FROM tests""")
def mask_unfinished(spark, d):
    return entities.mask_unfinished(fx.tests(spark, d).select("test_id", "test_status", "cost"), ["cost"])


@query("active_guard", q.with_ctes(q.INSTANCES) + """
  SELECT count(*) FILTER (deploy_status IN ('running', 'pending', 'failed', 'unknown') AND is_deleted = 0) AS active,
         count(*) FILTER (deploy_status IN ('running', 'pending', 'failed', 'unknown') AND is_deleted = 0) = 0 AS may_start FROM instances""")
def active_guard(spark, d):
    return entities.active_count(fx.instances(spark, d), "deploy_status", cat.BLOCKING_DEPLOY_STATUSES, live_only=True)


@query("active_tests_guard", q.with_ctes(q.TESTS) + """
  SELECT count(*) FILTER (test_status IN ('init', 'running', 'unknown')) AS active,
         count(*) FILTER (test_status IN ('init', 'running', 'unknown')) = 0 AS may_start FROM tests""")
def active_tests_guard(spark, d):
    return entities.active_count(fx.tests(spark, d), "test_status", cat.BLOCKING_TEST_STATUSES)


@query("exists_check", q.with_ctes(q.TESTS, q.INSTANCES) + """
  SELECT DISTINCT instance_id, instance_id IN (SELECT instance_id FROM instances WHERE deploy_status = 'running') AS found FROM tests""")
def exists_check(spark, d):
    wanted = fx.tests(spark, d).select("instance_id").distinct()
    running = fx.instances(spark, d).filter("deploy_status = 'running'")
    there, missing = entities.exists_check(wanted, running, ["instance_id"])
    return there.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


def _changes(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").filter(k % 3 == 0).select(
        (k + F.when(k % 2 == 0, F.lit(0)).otherwise(F.lit(1000000))).alias("instance_id"),
        F.when(k % 4 == 0, F.concat(F.lit("new-"), F.col("c_name"))).alias("instance_name"),
        F.lit("pending").alias("deploy_status"),
    )


@query("upsert", q.with_ctes(q.INSTANCES) + """
  , ch AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000 END AS instance_id,
             CASE WHEN c_custkey % 4 = 0 THEN 'new-' || c_name END AS n, 'pending' AS s FROM customer WHERE c_custkey % 3 = 0)
  SELECT instance_id, coalesce(n, instance_name) AS instance_name, coalesce(s, deploy_status) AS deploy_status, create_time, is_deleted, balance
  FROM instances FULL JOIN ch USING (instance_id)""")
def upsert(spark, d):
    return entities.upsert(fx.instances(spark, d), _changes(spark, d), ["instance_id"])


@query("soft_delete", q.with_ctes(q.INSTANCES) + """
  SELECT instance_id, CASE WHEN instance_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 1 ELSE is_deleted END AS is_deleted
  FROM instances""")
def soft_delete(spark, d):
    gone = fx.tests(spark, d).filter("test_status = 'success'").select("instance_id")
    return entities.soft_delete(fx.instances(spark, d).select("instance_id", "is_deleted"), gone, ["instance_id"])


@query("hard_delete", q.with_ctes(q.INSTANCES) + """
  SELECT instance_id, instance_name FROM instances
  WHERE instance_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def hard_delete(spark, d):
    gone = fx.tests(spark, d).filter("test_status = 'success'").select("instance_id")
    return entities.hard_delete(fx.instances(spark, d).select("instance_id", "instance_name"), gone, ["instance_id"])


@query("merged_table", q.with_ctes(q.INSTANCES) + """
  , ch AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000 END AS instance_id,
             CASE WHEN c_custkey % 4 = 0 THEN 'new-' || c_name END AS n, 'pending' AS s FROM customer WHERE c_custkey % 3 = 0),
  up AS (SELECT instance_id, coalesce(n, instance_name) AS instance_name, coalesce(s, deploy_status) AS deploy_status, create_time, is_deleted, balance
         FROM instances FULL JOIN ch USING (instance_id))
  SELECT * REPLACE (CASE WHEN instance_id % 5 = 1 THEN 1 ELSE is_deleted END AS is_deleted) FROM up WHERE instance_id % 7 <> 2""")
def merged_table(spark, d):
    """An entity table on disk through an upsert, a soft delete and a hard delete, each rewriting only the buckets it touches."""
    path, key = scratch_path(spark, "instances"), ["instance_id"]
    tables.create_table(fx.instances(spark, d), path, key, 16)
    tables.upsert_table(spark, path, _changes(spark, d), key)
    ids = tables.read_table(spark, path).select("instance_id")
    tables.soft_delete_table(spark, path, ids.filter("instance_id % 5 = 1"), key)
    tables.hard_delete_table(spark, path, ids.filter("instance_id % 7 = 2"), key)
    return tables.read_table(spark, path)


@query("engine_args", """
  SELECT 'task-' || CAST(p_partkey AS VARCHAR) AS task, p_brand AS exported_job, p_type AS dtype, p_name AS model,
         CAST(p_size AS VARCHAR) AS max_num_seqs, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size * 100 AS VARCHAR) ELSE CAST(p_size * 7 AS VARCHAR) END AS max_seq_len,
         CAST(p_size * 3 AS VARCHAR) AS max_num_batched_tokens, 'auto' AS load_format, CAST(NULL AS VARCHAR) AS max_paddings, p_type AS tokenizer,
         '1' AS pipeline_parallel_size, CAST(p_partkey % 4 AS VARCHAR) AS tensor_parallel_size, CAST(NULL AS VARCHAR) AS quantization, 8 AS n_args
  FROM part""")
def engine_args(spark, d):
    size = F.col("p_size")
    args = F.create_map(
        F.lit("dtype"), F.col("p_type"), F.lit("model"), F.col("p_name"), F.lit("max_num_seqs"), size.cast("string"),
        F.lit("max_model_len"), (size * 100).cast("string"),
        F.lit("max_seq_len"), F.when(F.col("p_partkey") % 3 != 0, (size * 7).cast("string")),
        F.lit("load_format"), F.lit("auto"), F.lit("tokenizer"), F.col("p_type"), F.lit("pipeline_parallel_size"), F.lit("1"),
    )
    tasks = fx.table(spark, d, "part").select(
        F.concat(F.lit("task-"), F.col("p_partkey").cast("string")).alias("task"),
        F.col("p_brand").alias("exporter_service_name"), (size * 3).alias("max_num_batched_tokens"),
        F.map_concat(args, F.create_map(F.lit("tensor_parallel_size"), (F.col("p_partkey") % 4).cast("string"))).alias("engine_args"),
    )
    out = entities.project_engine_args(tasks)
    return out.withColumn("n_args", F.size("engine_args") - 1).drop("engine_args")


@query("entity_table", """
  SELECT o_orderkey AS test_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 + 1 END AS duration,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS data_set FROM orders""")
def entity_table(spark, d):
    spec = F.to_json(F.struct(F.col("o_orderpriority").alias("data_set"), (F.col("o_orderkey") % 4 + 1).alias("duration")))
    rows = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("test_id"), F.when(F.col("o_orderkey") % 5 == 0, "{bad").otherwise(spec).alias("test_spec")
    )
    from fleetlens.schemas import TEST_JSON

    out = readers.read_entity_table(rows, TEST_JSON)
    return out.select("test_id", F.col("test_spec.duration").cast("long").alias("duration"), F.col("test_spec.data_set").alias("data_set"))


@query("instance_columns", """
  SELECT c_custkey AS instance_id, c_mktsegment AS product, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS model, CAST(c_nationkey AS VARCHAR) AS port,
         CAST(NULL AS VARCHAR) AS note FROM customer""")
def instance_columns(spark, d):
    """The four JSON columns of the instance table; unreadable ones read as NULL."""
    from fleetlens.schemas import INSTANCE_JSON

    one = lambda key, value: F.to_json(F.create_map(F.lit(key), value))
    rows = fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("instance_id"), one("product", F.col("c_mktsegment")).alias("instance_spec"),
        F.when(F.col("c_custkey") % 5 == 0, "{bad").otherwise(one("model", F.col("c_name"))).alias("startup_args"),
        one("port", F.col("c_nationkey").cast("string")).alias("mdl_cfg"), F.lit(None).cast("string").alias("extra"),
    )
    out = readers.read_entity_table(rows, INSTANCE_JSON)
    return out.select(
        "instance_id", F.col("instance_spec")["product"].alias("product"), F.col("startup_args")["model"].alias("model"),
        F.col("mdl_cfg")["port"].alias("port"), F.col("extra")["note"].alias("note"))


@query("unwrap_envelope", """
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 END AS is_anomaly, o_orderkey % 3 AS code FROM orders""")
def unwrap_envelope(spark, d):
    key = F.col("o_orderkey")
    body = F.to_json(F.struct(
        (key % 3).alias("code"), F.lit("m").alias("message"), F.struct((key % 2).alias("is_anomaly")).alias("result")
    ))
    rows = fx.table(spark, d, "orders").select(key.alias("id"), body.alias("body"))
    good, bad = readers.unwrap_envelope(rows, "body", "struct<is_anomaly bigint>", ["id"])
    return good.withColumn("code", F.lit(0).cast("long")).unionByName(
        bad.select("id", F.lit(None).cast("long").alias("is_anomaly"), F.col("code").cast("long").alias("code"))
    )


@query("range_response", q.with_ctes(q.EV) + """
  SELECT event_id, replica AS exported_job, ts - ts % 1000000 + 250125 AS ts, value FROM ev WHERE event_type <> 'error'""")
def range_response(spark, d):
    second = F.floor(F.col("ts") / q.SECOND)
    point = F.array(F.concat(second.cast("string"), F.lit(".250125")), F.col("value").cast("string"))
    junk = F.array((second + 1).cast("string"), F.lit("n/a"))
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    series = F.struct(
        F.create_map(F.lit("exported_job"), F.col("replica")).alias("metric"), F.array(point, junk).alias("values")
    )
    body = F.to_json(F.struct(
        status.alias("status"), F.struct(F.lit("matrix").alias("resultType"), F.array(series).alias("result")).alias("data")
    ))
    out = readers.parse_range_response(fx.events(spark, d).select("event_id", body.alias("body")), "body", ["event_id"])
    return out.select("event_id", F.col("labels")["exported_job"].alias("exported_job"), "ts", "value")


@query("parse_log", q.with_ctes(q.EV) + """
  , l AS (SELECT event_id, service, ts, user_id, cents FROM ev WHERE event_id % 4 <> 3)
  SELECT event_id, service, ts, 'avg_prompt_throughput_tokens_per_second' AS metric, (cents // 10) / 10.0e0 AS value FROM l
  UNION ALL SELECT event_id, service, ts, 'avg_generation_throughput_tokens_per_second', (cents // 5) / 10.0e0 FROM l
  UNION ALL SELECT event_id, service, ts, 'running_requests', CAST(user_id AS DOUBLE) FROM l
  UNION ALL SELECT event_id, service, ts, 'swapped_requests', 0.0e0 FROM l
  UNION ALL SELECT event_id, service, ts, 'pending_requests', CAST(event_id % 100 AS DOUBLE) FROM l
  UNION ALL SELECT event_id, service, ts, 'gpu_kv_cache_usage_percent', (cents % 1000) / 10.0e0 FROM l
  UNION ALL SELECT event_id, service, ts, 'cpu_kv_cache_usage_percent', 0.0e0 FROM l""")
def parse_log(spark, d):
    e = fx.events(spark, d)
    tenth = lambda x: F.concat(F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"))
    text = F.concat(
        F.lit("INFO 01-01 metrics.py] Avg prompt throughput: "), tenth(F.floor(F.col("cents") / 10)),
        F.lit(" tokens/s, Avg generation throughput: "), tenth(F.floor(F.col("cents") / 5)),
        F.lit(" tokens/s, Running: "), F.col("user_id").cast("string"), F.lit(" reqs, Swapped: 0 reqs, Pending: "),
        (F.col("event_id") % 100).cast("string"), F.lit(" reqs, GPU KV cache usage: "), tenth(F.col("cents") % 1000),
        F.lit("%, CPU KV cache usage: 0.0%"),
    )
    other = F.concat(F.lit("Avg prompt throughput: "), F.col("cents").cast("string"), F.lit(" tokens/s, all else idle"))
    lines = e.select("event_id", "service", "ts", F.when(F.col("event_id") % 4 == 3, other).otherwise(text).alias("line"))
    return sp.parse_engine_log(lines, ["event_id", "service", "ts"])


@query("request_params", """
  SELECT doc_id AS request_id, ['/generate', '/v1/completions', '/health'][doc_id % 3 + 1] AS path, text AS prompt,
         CAST(NULL AS VARCHAR) AS messages, source AS model FROM documents
  WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 2 AND doc_id % 11 <> 0""")
def request_params(spark, d):
    return sp.extract_request_params(fx.request_log(spark, d))


@query("request_counter", q.with_ctes(q.EV) + """
  , b AS (SELECT service, event_type, ts - ts % 3600000000 + 3600000000 AS ts, count(*) AS n FROM ev GROUP BY ALL)
  SELECT service, event_type, ts, CAST(sum(n) OVER (PARTITION BY service, event_type ORDER BY ts) AS BIGINT) AS requests_total FROM b""")
def request_counter(spark, d):
    return sp.request_counter(fx.events(spark, d), ["service", "event_type"], q.HOUR)


@query("span_red", q.with_ctes(q.EV, q.SPANS) + """
  SELECT service, name, status, start - start % 3600000000 AS ts, count(*) AS calls, round(CAST(sum(cents) AS BIGINT) / 100.0e0, 6) AS duration_ms_sum,
""" + q.duration_counts() + " FROM spans GROUP BY ALL")
def span_red(spark, d):
    out = sp.span_red_metrics(fx.spans(spark, d), width=q.HOUR)
    return out.withColumn("duration_ms_sum", F.round("duration_ms_sum", 6))


@query("span_call_counters", q.with_ctes(q.EV, q.SPANS) + """
  , b AS (SELECT service, name, status, start - start % 3600000000 AS ts, count(*) AS n FROM spans GROUP BY ALL)
  SELECT 'traces_spanmetrics_calls_total' AS metric, service, name, status, ts,
         CAST(sum(n) OVER (PARTITION BY service, name, status ORDER BY ts) AS DOUBLE) AS value FROM b""")
def span_call_counters(spark, d):
    dims = ["service", "name", "status"]
    out = sp.spans_to_samples(sp.span_red_metrics(fx.spans(spark, d), dims, q.HOUR, bounds=()), dims)
    return out.select("metric", *[F.col("labels")[sp.SPAN_LABELS.get(c, c)].alias(c) for c in dims], "ts", "value")


@query("service_graph", q.with_ctes(q.EV, q.SPANS) + """
  SELECT c.service AS client, s.service AS server, count(*) AS calls, count(*) FILTER (s.status = 'error') AS failed,
         round(CAST(sum(s.cents) AS BIGINT) / (100.0e0 * count(*)), 6) AS mean_ms
  FROM spans c JOIN spans s ON s.trace_id = c.trace_id AND s.parent_id = c.span_id
  WHERE c.kind = 'client' AND s.kind = 'server' GROUP BY ALL""")
def service_graph(spark, d):
    return sp.service_graph_edges(fx.spans(spark, d)).withColumn("mean_ms", F.round("mean_ms", 6))


@query("generated_tokens", q.with_ctes(q.EV, q.SPANS) + """
  SELECT service, count(*) AS forward_calls, CAST(sum(coalesce(TRY_CAST(batch_size AS BIGINT), 1)) AS BIGINT) AS tokens
  FROM spans WHERE name LIKE '%.forward' GROUP BY service""")
def generated_tokens(spark, d):
    return sp.generated_tokens(fx.spans(spark, d))


def _config_sql() -> str:
    labels = ", ".join(f"CASE WHEN e % {k + 2} > 0 THEN '{name}-' || CAST(e % {k + 40} AS VARCHAR) END AS {name}" for k, name in enumerate(cat.ENGINE_INIT_LABELS))
    return f"""
  , l AS (SELECT replica AS exported_job, arg_max(event_id, {{'t': ts, 'e': event_id}}) AS e FROM ev WHERE event_type = 'view' GROUP BY 1)
  SELECT exported_job, {labels} FROM l"""


@query("latest_engine_config", q.with_ctes(q.EV) + _config_sql())
def latest_engine_config(spark, d):
    """Configuration samples among those of other metrics, each with its own labels, some of which are missing."""
    event = F.col("event_id")
    entries = [F.when(event % (k + 2) > 0, F.struct(F.lit(name).alias("key"), F.concat(F.lit(f"{name}-"), (event % (k + 40)).cast("string")).alias("value")))
               for k, name in enumerate(cat.ENGINE_INIT_LABELS)]
    metric = F.when(F.col("event_type") == "view", "llm_engine_init_config").otherwise(F.col("event_type"))
    info = fx.events(spark, d).select(
        metric.alias("metric"), F.col("replica").alias("exported_job"), F.map_from_entries(F.array_compact(F.array(*entries))).alias("labels"), "ts")
    return sp.latest_engine_config(info)


@query("trace_export", q.with_ctes(q.EV, q.SPANS) + """
  SELECT trace_id, span_id, parent_id, service, name, kind, status, start, round(duration_ms, 3) AS duration_ms, batch_size FROM spans""")
def trace_export(spark, d):
    s = fx.spans(spark, d)
    attribute = lambda key, value: F.struct(F.lit(key).alias("key"), F.create_map(F.lit("stringValue"), value).alias("value"))
    start = F.col("start") * 1000
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_id", F.lit("")).alias("parentSpanId"),
        "name", F.when(F.col("kind") == "server", 2).otherwise(3).alias("kind"),
        start.cast("string").alias("startTimeUnixNano"),
        (start + F.round(F.col("duration_ms") * 1_000_000).cast("long")).cast("string").alias("endTimeUnixNano"),
        F.struct(F.when(F.col("status") == "error", 2).otherwise(0).alias("code")).alias("status"),
        F.array(attribute("batch_size", F.col("attrs")["batch_size"])).alias("attributes"),
    )
    export = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.array(attribute("service.name", F.col("service"))).alias("attributes")).alias("resource"),
        F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"),
    )).alias("resourceSpans")))
    out = readers.read_spans(s.select(export.alias("body")), "body")
    return out.select(
        "trace_id", "span_id", "parent_id", "service", "name", "kind", "status", "start",
        F.round("duration_ms", 3).alias("duration_ms"), F.col("attrs")["batch_size"].alias("batch_size"),
    )


@query("context_window", """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
  SELECT conv_id, count(*) AS n_messages, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS context
  FROM r WHERE rn <= 5 GROUP BY conv_id""")
def context_window(spark, d):
    out = chat.context_window(fx.table(spark, d, "conversations"))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return out.select("conv_id", F.col("n_messages").cast("long").alias("n_messages"), F.array_join(lines, "\n").alias("context"))


REPORT = """report AS (SELECT l_orderkey AS test_id, l_returnflag <> 'R' AS success, l_extendedprice AS elapsed,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem), summary AS (
  SELECT test_id, count(*) AS total, count(*) FILTER (success) AS success, CAST(sum(cents) AS BIGINT) / (100.0e0 * count(*)) AS elapsed_avg
  FROM report GROUP BY test_id)"""


@query("load_summary", q.with_ctes(REPORT) + "SELECT test_id, total, success, round(elapsed_avg + 1e-7, 4) AS elapsed_avg FROM summary")
def load_summary(spark, d):
    return loadtest.summarise_load_report(fx.load_report(spark, d)).withColumn("elapsed_avg", F.round(F.col("elapsed_avg") + 1e-7, 4))


@query("success_rate", q.with_ctes(REPORT, q.TESTS) + """
  SELECT test_id, CASE WHEN coalesce(total, 0) = 0 THEN 0.0e0 ELSE round(success / CAST(total AS DOUBLE) * 100, 3) END AS success_rate
  FROM tests LEFT JOIN summary USING (test_id)""")
def success_rate(spark, d):
    summary = loadtest.summarise_load_report(fx.load_report(spark, d))
    tests = fx.tests(spark, d).select("test_id").join(summary, "test_id", "left")
    return loadtest.with_success_rate(tests).select("test_id", "success_rate")


@query("robust_avg", q.with_ctes(q.SAMPLES) + """
  , z AS (SELECT metric, service, replica, ts - ts % 86400000000 AS day, CASE WHEN value < 20 THEN 0 ELSE value END AS value FROM samples),
  s AS (SELECT *, max(abs(value)) OVER (PARTITION BY metric, service, replica, day) AS peak FROM z)
  SELECT metric, day, round(coalesce(avg(value) FILTER (peak > 0), 0) + 1e-9, 6) AS robust_avg FROM s GROUP BY metric, day""")
def robust_avg(spark, d):
    rows = fx.samples(spark, d).select(
        "metric", "service", "replica", (F.col("ts") - F.col("ts") % q.DAY).alias("day"),
        F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")).alias("value"),
    )
    out = loadtest.robust_metric_avg(rows, ["metric", "day"], ["service", "replica"])
    return out.withColumn("robust_avg", F.round(F.col("robust_avg") + 1e-9, 6))


WINDOWS = """windows AS (
  SELECT *, created * 1000000 AS w_start, (created + greatest(60, duration * CASE duration_unit WHEN 'hour' THEN 3600 WHEN 'min' THEN 60 ELSE 1 END)) * 1000000 AS w_end
  FROM tests)"""


def throughput_sql(by_job: bool) -> str:
    job = "AND s.replica = w.exported_job" if by_job else ""
    return f"""steps AS (SELECT test_id, exported_job, unnest(range(w_start, w_end + 1, 60000000)) AS t FROM windows
    ), instants AS (
      SELECT w.test_id, w.t, s.metric, s.replica, s.service, arg_max(s.value, s.ts) AS value
      FROM steps w JOIN samples s ON s.ts > w.t - 300000000 AND s.ts <= w.t {job} WHERE s.metric IN ('click', 'purchase') GROUP BY ALL
    ), job_means AS (SELECT test_id, t, metric, replica, avg(value) AS value FROM instants GROUP BY ALL
    ), per_series AS (SELECT test_id, metric, replica, sum(value) AS v, count(*) AS n, max(abs(value)) AS peak FROM job_means GROUP BY ALL
    ), tput AS (
      SELECT test_id, CAST(trunc(round(coalesce(sum(v) FILTER (peak > 0 AND metric = 'click') / sum(n) FILTER (peak > 0 AND metric = 'click'), 0), 9)) AS BIGINT) AS prompt_tps,
        CAST(trunc(round(coalesce(sum(v) FILTER (peak > 0 AND metric = 'purchase') / sum(n) FILTER (peak > 0 AND metric = 'purchase'), 0), 9)) AS BIGINT) AS generation_tps
      FROM per_series GROUP BY test_id
    ), throughput AS (
      SELECT test_id, coalesce(prompt_tps, 0) AS prompt_tps, coalesce(generation_tps, 0) AS generation_tps FROM tests LEFT JOIN tput USING (test_id))"""


def _throughput(spark, d, by_job=False):
    samples = fx.samples(spark, d).withColumnRenamed("replica", "exported_job")
    return loadtest.test_throughput(fx.tests(spark, d), samples, "click", "purchase", by_job)


@query("test_throughput", q.with_ctes(q.SAMPLES, q.TESTS, WINDOWS, throughput_sql(False)) + "SELECT * FROM throughput")
def test_throughput(spark, d):
    return _throughput(spark, d)


@query("test_throughput_by_job", q.with_ctes(q.SAMPLES, q.TESTS, WINDOWS, throughput_sql(True)) + "SELECT * FROM throughput")
def test_throughput_by_job(spark, d):
    return _throughput(spark, d, by_job=True)


@query("series_in_test_window", q.with_ctes(q.SAMPLES, q.TESTS, WINDOWS) + """
  SELECT w.test_id, s.metric, s.replica AS exported_job, round(sum(s.value), 6) AS v_sum, count(*) AS v_n, max(abs(s.value)) AS v_peak
  FROM windows w JOIN samples s ON s.ts BETWEEN w.w_start AND w.w_end GROUP BY ALL""")
def series_in_test_window(spark, d):
    samples = fx.samples(spark, d).withColumnRenamed("replica", "exported_job")
    out = loadtest.series_in_windows(loadtest.test_windows(fx.tests(spark, d)), samples, ["metric", "exported_job"])
    return out.withColumn("v_sum", F.round("v_sum", 6))


@query("finalise_tests", q.with_ctes(q.SAMPLES, q.TESTS, WINDOWS, throughput_sql(False), REPORT) + """
  SELECT test_id, CASE WHEN total IS NULL THEN 'failed' ELSE 'success' END AS test_status, total, success, round(elapsed_avg + 1e-7, 4) AS elapsed_avg,
         prompt_tps, generation_tps FROM tests LEFT JOIN summary USING (test_id) LEFT JOIN throughput USING (test_id)""")
def finalise_tests(spark, d):
    summary = loadtest.summarise_load_report(fx.load_report(spark, d))
    out = loadtest.finalise_tests(fx.tests(spark, d), summary, _throughput(spark, d))
    return out.select(
        "test_id", "test_status", "total", "success", F.round(F.col("elapsed_avg") + 1e-7, 4).alias("elapsed_avg"), "prompt_tps", "generation_tps")


@query("test_query_window", q.with_ctes(q.TESTS) + """
  SELECT test_id, created AS q_start, least(created + CASE duration_unit WHEN 'hour' THEN duration * 3600 WHEN 'min' THEN duration * 60
    WHEN 'sec' THEN duration ELSE 0 END + 180, 1705000000) AS q_end FROM tests""")
def test_query_window(spark, d):
    return loadtest.test_query_window(fx.tests(spark, d), F.lit(1705000000))


@query("render_requests", """
  SELECT o_orderkey AS test_id, doc_id AS prompt_id, CASE WHEN o_orderkey % 2 = 0 THEN '/generate' ELSE '/v1/completions' END AS path,
         CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS model, text AS prompt, CAST(64 << (o_orderkey % 4) AS INTEGER) AS max_tokens, 0.8e0 AS temperature, 0.8e0 AS top_p
  FROM documents JOIN orders ON o_orderkey = doc_id""")
def render_requests(spark, d):
    requests = fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("test_id"), F.col("doc_id").alias("prompt_id"), F.col("text").alias("question")
    )
    key = F.col("o_orderkey")
    tests = fx.table(spark, d, "orders").select(
        key.alias("test_id"), F.when(key % 2 == 0, "normal").otherwise("openai").alias("mode"), F.col("o_orderpriority").alias("model"),
        (F.lit(64) * F.pow(F.lit(2), key % 4)).cast("int").alias("max_tokens"), F.lit(0.8).alias("temperature"), F.lit(0.8).alias("top_p"),
    )
    out = loadtest.render_requests(requests, tests)
    body = F.from_json("body", "model string, prompt string, max_tokens int, temperature double, top_p double")
    return out.withColumn("b", body).select("test_id", "prompt_id", "path", "b.model", "b.prompt", "b.max_tokens", "b.temperature", "b.top_p")


@query("time_scalars", q.with_ctes(q.TESTS) + """
  SELECT test_id, duration * CASE duration_unit WHEN 'hour' THEN 3600 WHEN 'min' THEN 60 WHEN 'sec' THEN 1 END AS seconds,
         created AS from_ms, strftime(make_timestamp(created * 1000000), '%Y-%m-%d %H:%M:%S') AS shown,
         created - 28800 AS utc FROM tests""")
def time_scalars(spark, d):
    t = fx.tests(spark, d)
    shown = ex.epoch_to_text(F.col("created"))
    return t.select(
        "test_id", ex.duration_seconds(F.col("duration"), F.col("duration_unit")).alias("seconds"),
        ex.epoch_to_seconds(F.when(F.col("test_id") % 2 == 0, F.col("created") * 1000 + 7).otherwise(F.col("created"))).alias("from_ms"),
        shown.alias("shown"), ex.local_text_to_epoch(shown, "Asia/Shanghai").alias("utc"),
    )
