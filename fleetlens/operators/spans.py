"""Spans and requests: derived metrics, service graph, request parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.operators.chunks import running_total, running_totals

# Histogram bounds in milliseconds.
DURATION_BOUNDS = [2, 4, 6, 8, 10, 50, 100, 200, 400, 800, 1000, 1400, 2000, 5000, 10000, 15000]


def span_red_metrics(
    spans: DataFrame, dims: Sequence[str] = ("service", "name", "status"), width: int = cat.MINUTE,
    bounds: Sequence[float] = tuple(DURATION_BOUNDS),
) -> DataFrame:
    """Calls, total duration and cumulative duration histogram per dimension and time bin."""
    bin_start = F.col("start") - F.col("start") % width
    return spans.groupBy(*dims, bin_start.alias("ts")).agg(
        F.count("*").alias("calls"),
        F.sum("duration_ms").alias("duration_ms_sum"),
        *[F.count_if(F.col("duration_ms") <= b).alias(_bucket(b)) for b in bounds],
    )


# Label names of span metrics by the columns of a span; other dimensions keep their name.
SPAN_LABELS = {"name": "span_name", "kind": "span_kind", "status": "status_code"}


def with_dimensions(spans: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Spans with some attributes as columns, dots in their names written as underscores."""
    return spans.withColumns({a.replace(".", "_"): F.col("attrs")[a] for a in attributes})


# Names of the derived metrics.
CALLS, LATENCY = "traces_spanmetrics_calls_total", "traces_spanmetrics_latency"
EDGE_CALLS, EDGE_FAILED = "traces_service_graph_request_total", "traces_service_graph_request_failed_total"
EDGE_LATENCY = "traces_service_graph_request_server_seconds"


def _bucket(bound: float) -> str:
    return f"le_{bound:g}".replace(".", "_")


def _labelled(totals: DataFrame, names: Mapping[str, str], series: Sequence[tuple[str, str | None, Column]], external: Mapping[str, str]) -> DataFrame:
    """One sample per row of totals and series (metric, le, value); `names` gives the label of each column."""
    base = F.map_from_arrays(F.array(*map(F.lit, names.values())), F.array(*[F.col(c).cast("string") for c in names]))
    # A label of the span itself wins over an external one.
    fixed = [x for kv in external.items() if kv[0] not in names.values() for x in kv]
    if fixed:
        base = F.map_concat(base, F.create_map(*map(F.lit, fixed)))
    rows = [
        F.struct(F.lit(metric).alias("metric"), (base if le is None else F.map_concat(base, F.create_map(F.lit("le"), F.lit(le)))).alias("labels"),
                 value.cast("double").alias("value"))
        for metric, le, value in series]
    return totals.select("ts", F.inline(F.array(*rows))).select("metric", "labels", "ts", "value")


def _histogram(metric: str, bounds: Sequence[float]) -> list[tuple[str, str | None, Column]]:
    """Series of a histogram in seconds, out of columns in milliseconds; each bucket holds those below it."""
    buckets = [(f"{metric}_bucket", f"{b / 1000:g}", F.col(_bucket(b))) for b in bounds]
    return [*buckets, (f"{metric}_bucket", "+Inf", F.col("calls")), (f"{metric}_sum", None, F.col("duration_ms_sum") / 1000), (f"{metric}_count", None, F.col("calls"))]


def spans_to_samples(red: DataFrame, dims: Sequence[str], bounds: Sequence[float] = (), external: Mapping[str, str] | None = None) -> DataFrame:
    """Cumulative series of span metrics, ready to append to the samples table: calls per dimension set, and the duration
    histogram if `bounds` are given, which `red` must hold.

    Labels have the names that the views match: a span's name becomes `span_name`. `external` labels are added to all.
    """
    amounts = ["calls", *(["duration_ms_sum", *map(_bucket, bounds)] if bounds else [])]
    totals = running_totals(red, dims, amounts, "ts", cat.DAY)
    series = [(CALLS, None, F.col("calls")), *(_histogram(LATENCY, bounds) if bounds else [])]
    return _labelled(totals, {d: SPAN_LABELS.get(d, d) for d in dims}, series, external or {})


def edges_to_samples(
    spans: DataFrame, dims: Sequence[str] = (), width: int = cat.MINUTE, bounds: Sequence[float] = tuple(DURATION_BOUNDS),
    external: Mapping[str, str] | None = None,
) -> DataFrame:
    """Cumulative series of the service graph: requests, failures and the server's time per client, server and dimensions of
    the server span, by the time bin in which the server span starts."""
    keys = [*dims, "client", "server"]
    bins = graph_bins(spans, dims, width, bounds).withColumnRenamed("bin", "ts")
    totals = running_totals(bins, keys, ["calls", "failed", "duration_ms_sum", *map(_bucket, bounds)], "ts", cat.DAY)
    series = [(EDGE_CALLS, None, F.col("calls")), (EDGE_FAILED, None, F.col("failed")), *_histogram(EDGE_LATENCY, bounds)]
    return _labelled(totals, {k: SPAN_LABELS.get(k, k) for k in keys}, series, external or {})


def graph_bins(spans: DataFrame, dims: Sequence[str] = (), width: int = cat.MINUTE, bounds: Sequence[float] = ()) -> DataFrame:
    """Requests, failures, time and histogram of each edge of the service graph and time bin.

    Server spans are first counted per (trace, parent, service, bin), so a parent with very many children meets the join
    as a few rows.
    """
    counts = ["calls", "failed", "duration_ms_sum", *map(_bucket, bounds)]
    start = F.col("start") - F.col("start") % width
    server = spans.filter((F.col("kind") == "server") & F.col("parent_id").isNotNull()).groupBy(
        *dims, "trace_id", "parent_id", F.col("service").alias("server"), start.alias("bin")
    ).agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("failed"), F.sum("duration_ms").alias("duration_ms_sum"),
        *[F.count_if(F.col("duration_ms") <= b).alias(_bucket(b)) for b in bounds])
    client = spans.filter(F.col("kind") == "client").select("trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("client"))
    return client.join(server, ["trace_id", "parent_id"]).groupBy(*dims, "client", "server", "bin").agg(*[F.sum(c).alias(c) for c in counts])


def service_graph_edges(spans: DataFrame) -> DataFrame:
    """Client to server edges: calls, failures and mean server time per service pair.

    Server spans are first counted per (trace, parent, service), so a parent with very many children
    meets the join as a few rows.
    """
    server = spans.filter((F.col("kind") == "server") & F.col("parent_id").isNotNull()).groupBy(
        "trace_id", "parent_id", F.col("service").alias("server")
    ).agg(
        F.count("*").alias("_calls"),
        F.count_if(F.col("status") == "error").alias("_failed"),
        F.sum("duration_ms").alias("_ms"),
    )
    client = spans.filter(F.col("kind") == "client").select(
        "trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("client")
    )
    return client.join(server, ["trace_id", "parent_id"]).groupBy("client", "server").agg(
        F.sum("_calls").alias("calls"),
        F.sum("_failed").alias("failed"),
        (F.sum("_ms") / F.sum("_calls")).alias("mean_ms"),
    )


def generated_tokens(spans: DataFrame, by: Sequence[str] = ("service",), suffix: str = ".forward") -> DataFrame:
    """Tokens produced by forward calls, which are the spans named `*.forward`: the batch size of each call, 1 where
    it is unknown."""
    return spans.filter(F.col("name").endswith(suffix)).groupBy(*by).agg(
        F.count("*").alias("forward_calls"),
        F.sum(F.coalesce(F.col("attrs")["batch_size"].try_cast("bigint"), F.lit(1))).alias("tokens"),
    )


def request_counter(requests: DataFrame, labels: Sequence[str], width: int = cat.MINUTE) -> DataFrame:
    """Cumulative request counter per label set at the end of each time bin that has requests."""
    binned = requests.groupBy(*labels, (F.col("ts") - F.col("ts") % width + width).alias("ts")).agg(
        F.count("*").alias("_n")
    )
    totals = running_total(binned, labels, "_n", "ts", cat.DAY)
    return totals.select(*labels, "ts", F.col("running").alias("requests_total"))


def extract_request_params(requests: DataFrame) -> DataFrame:
    """prompt, messages and model out of the JSON bodies of generation requests; unreadable bodies are dropped."""
    posted = requests.filter((F.col("method") == "POST") & F.col("path").isin(*cat.GENERATION_PATHS))
    # One parse per body; the extra field holds bodies that are no JSON object.
    parsed = F.from_json("body", "prompt string, messages string, model string, _corrupt_record string")
    readable = posted.withColumn("_p", parsed).filter(F.col("_p").isNotNull() & F.col("_p._corrupt_record").isNull())
    return readable.select(
        *[c for c in requests.columns if c not in ("body", "method")], "_p.prompt", "_p.messages", "_p.model"
    )


def parse_engine_log(lines: DataFrame, keys: Sequence[str] = ("service", "ts")) -> DataFrame:
    """Seven gauges out of each matching engine log line, as long samples; other lines are ignored.

    The pattern runs once over a line: the line is replaced by its groups, or stays if it doesn't match.
    """
    count = len(cat.ENGINE_LOG_METRICS)
    groups = " ".join(f"${i}" for i in range(1, count + 1))
    replaced = F.regexp_replace("line", f"^(?s:.*?){cat.ENGINE_LOG_PATTERN}(?s:.*)$", f"\u0001{groups}")
    found = lines.select(*keys, replaced.alias("_g")).filter(F.col("_g").startswith("\u0001"))
    values = F.split(F.substring("_g", 2, 1 << 20), " ")
    pairs = F.arrays_zip(F.array(*map(F.lit, cat.ENGINE_LOG_METRICS)).alias("metric"), values.alias("text"))
    gauges = found.select(*keys, F.explode(pairs).alias("_p"))
    return gauges.select(*keys, F.col("_p.metric").alias("metric"), F.col("_p.text").try_cast("double").alias("value"))


def latest_engine_config(info: DataFrame) -> DataFrame:
    """Engine configuration per job from the newest sample of the info metric."""
    newest = info.filter(F.col("metric") == "llm_engine_init_config").groupBy("exported_job").agg(
        F.max_by("labels", "ts").alias("labels")
    )
    return newest.select("exported_job", *[F.col("labels")[name].alias(name) for name in cat.ENGINE_INIT_LABELS])
