"""Registered queries: whole paths from what services emit (range responses, log lines, spans) to the views and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import detect
from fleetlens.operators import ranges as rg
from fleetlens.operators import spans as sp
from fleetlens.operators.chunks import latest
from fleetlens.plans import fleet_queries as fq
from fleetlens.plans import series_queries as sq
from fleetlens.plans import sql as q
from fleetlens.plans.registry import query
from fleetlens.plans.views import BUNDLE_NAMES, BY_NAME, View, run_dashboard, run_view
from fleetlens.sources import fixtures as fx
from fleetlens.sources import readers

LOG_VIEWS = ["detect_pending", "detect_running", "detect_kv_cache"]
LOOK = 300 * q.SECOND * sq.STRETCH


@query("range_json_to_detection", fq.DETECT_SQL)
def range_json_to_detection(spark, d):
    """Range-query responses of ten days of a series each, read back and judged."""
    bundle = fx.replica_bundle(spark, d)
    # Points of a response are in time order; a response is bounded by its days.
    point = F.struct("ts", F.array((F.col("ts") / q.SECOND).cast("string"), F.col("value").cast("string")).alias("p"))
    series = bundle.groupBy("service", "replica", "metric", F.floor(F.col("ts") / (10 * fx.DAY)).alias("part")).agg(F.sort_array(F.collect_list(point)).alias("points"))
    labels = F.create_map(F.lit("service"), F.col("service"), F.lit("replica"), F.col("replica"), F.lit("metric"), F.col("metric"))
    result = F.array(F.struct(labels.alias("metric"), F.transform("points", lambda p: p["p"]).alias("values")))
    body = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("matrix").alias("resultType"), result.alias("result")).alias("data")))
    samples = readers.parse_range_response(series.select(body.alias("body")), "body")
    read = samples.select(*[F.col("labels")[k].alias(k) for k in ("service", "replica", "metric")], "ts", "value")
    return detect.detect_anomaly(read, fx.tasks(spark, d), fq.RUNNING, **fq.RULES)


def _log_sql() -> str:
    arms = " UNION ALL ".join(
        f"SELECT '{BUNDLE_NAMES[v]}' AS metric, replica AS exported_job, ts, event_id, {value} AS value FROM ev WHERE event_id % 4 <> 3"
        for v, value in zip(LOG_VIEWS, ("CAST(event_id % 100 AS DOUBLE)", "CAST(user_id AS DOUBLE)", "(cents % 1000) / 10.0e0")))
    return q.with_ctes(
        q.EV, f"lines AS ({arms})", "src AS (SELECT metric, exported_job, ts, arg_max(value, event_id) AS value FROM lines GROUP BY ALL)",
        q.ticks(60 * q.SECOND * sq.STRETCH), q.instant_cte("x", "src", "metric, exported_job", LOOK),
    ) + "SELECT metric, exported_job AS replica, ts, round(value + 1e-9, 6) AS value FROM x"


@query("logs_to_detection", _log_sql())
def logs_to_detection(spark, d):
    """Engine log lines to three of the detector's series, over lines of other kinds."""
    tenth = lambda x: F.concat(F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"))
    text = F.concat(
        F.lit("Avg prompt throughput: 1.5 tokens/s, Avg generation throughput: 20.0 tokens/s, Running: "), F.col("user_id").cast("string"),
        F.lit(" reqs, Swapped: 0 reqs, Pending: "), (F.col("event_id") % 100).cast("string"),
        F.lit(" reqs, GPU KV cache usage: "), tenth(F.col("cents") % 1000), F.lit("%, CPU KV cache usage: 0.0%"),
    )
    lines = fx.events(spark, d).select(
        F.col("replica").alias("exported_job"), "ts", "event_id", F.when(F.col("event_id") % 4 == 3, "idle").otherwise(text).alias("line"))
    gauges = sp.parse_engine_log(lines, ["exported_job", "ts", "event_id"])
    samples = latest(gauges, ["metric", "exported_job"], "event_id")
    out = run_dashboard([BY_NAME[v] for v in LOG_VIEWS], samples, sq.START, sq.END, sq.STRETCH)
    names = F.create_map(*[F.lit(x) for v in LOG_VIEWS for x in (v, BUNDLE_NAMES[v])])
    return out.select(names[F.col("view")].alias("metric"), F.col("exported_job").alias("replica"), "ts", F.round(F.col("value") + 1e-9, 6).alias("value"))


SPAN_KEYS = "service, span_name, http_status_code"


@query("spans_to_success_rate", q.with_ctes(
    q.EV, q.SPANS, """named AS (
      SELECT service, CASE WHEN name = 'POST /click' THEN 'POST /generate' ELSE name END AS span_name,
             CASE WHEN status = 'error' OR CAST(span_id AS BIGINT) % 9 = 0 THEN '500' ELSE '200' END AS http_status_code, start - start % 3600000000 AS ts FROM spans)""",
    f"binned AS (SELECT {SPAN_KEYS}, ts, count(*) AS n FROM named GROUP BY ALL)",
    f"src AS (SELECT {SPAN_KEYS}, ts, CAST(sum(n) OVER (PARTITION BY {SPAN_KEYS} ORDER BY ts) AS DOUBLE) AS value FROM binned "
    "WHERE span_name = 'POST /generate' AND http_status_code LIKE '2__')",
    q.ticks(60 * q.SECOND * sq.STRETCH), q.rate_cte("x", "src", SPAN_KEYS, 60 * q.SECOND * sq.STRETCH, False),
) + "SELECT service, ts, round(avg(value) + 1e-9, 6) AS value FROM x GROUP BY service, ts")
def spans_to_success_rate(spark, d):
    """Spans of several names and status codes to the detector's count of successful requests."""
    spans = fx.spans(spark, d)
    status = F.when((F.col("status") == "error") | (F.col("span_id").cast("long") % 9 == 0), "500").otherwise("200")
    spans = spans.withColumns({
        "name": F.when(F.col("name") == "POST /click", "POST /generate").otherwise(F.col("name")),
        "attrs": F.create_map(F.lit("http.status_code"), status),
    })
    dims = ["service", "name", "http_status_code"]
    red = sp.span_red_metrics(sp.with_dimensions(spans, ["http.status_code"]), dims, q.HOUR)
    samples = rg.promote_labels(sp.spans_to_samples(red, dims), ["service", "span_name", "http_status_code"])
    out = run_view(BY_NAME["detect_success_requests"], samples, sq.START, sq.END, sq.STRETCH)
    return out.withColumn("value", F.round(F.col("value") + 1e-9, 6))


LATENCY_VIEW = View("span_latency", "rate_ratio", (f"{sp.LATENCY}_sum", f"{sp.LATENCY}_count"), "sum", ("service",), unit="s")


def _latency_sql() -> str:
    keys = "metric, service, span_name"
    both = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, service, name AS span_name, start - start % 3600000000 AS ts, {x} AS a FROM spans"
        for m, x in zip(LATENCY_VIEW.metrics, ("cents / 100000.0e0", "1.0e0")))
    return q.with_ctes(
        q.EV, q.SPANS, f"binned AS (SELECT {keys}, ts, sum(a) AS a FROM ({both}) GROUP BY ALL)",
        f"src AS (SELECT {keys}, ts, sum(a) OVER (PARTITION BY {keys} ORDER BY ts) AS value FROM binned)",
        q.ticks(60 * q.SECOND * sq.STRETCH), q.rate_cte("x", "src", keys, 60 * q.SECOND * sq.STRETCH),
    ) + f"""SELECT service, ts, round(sum(value) FILTER (metric = '{LATENCY_VIEW.metrics[0]}') / sum(value) FILTER (metric = '{LATENCY_VIEW.metrics[1]}') + 1e-9, 6) AS value
      FROM x GROUP BY service, ts HAVING sum(value) FILTER (metric = '{LATENCY_VIEW.metrics[1]}') <> 0"""


@query("spans_to_latency", _latency_sql())
def spans_to_latency(spark, d):
    """Mean latency per service, read by a view from the histogram that spans were turned into."""
    dims = ["service", "name"]
    red = sp.span_red_metrics(fx.spans(spark, d), dims, q.HOUR)
    samples = rg.promote_labels(sp.spans_to_samples(red, dims, sp.DURATION_BOUNDS), ["service", "span_name"])
    out = run_view(LATENCY_VIEW, samples, sq.START, sq.END, sq.STRETCH)
    return out.withColumn("value", F.round(F.col("value") + 1e-9, 6))
