"""Catalogue of the metric views: detector inputs, instance charts and cluster dashboard.

A view names its metrics, label matchers, window and grouping; ``run_view`` turns it into one DataFrame
plan. Durations are those of the dashboards; `stretch` multiplies them all for sparser series.
A view states them in seconds; times of samples, ranges and results are in microseconds.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.functions.expressions import display_value, ratio
from fleetlens.operators import ranges as rg
from fleetlens.operators.inventory import adaptive_unit

def series_keys(samples: DataFrame) -> list[str]:
    """All columns but time and value: together they identify a series."""
    if "labels" in samples.columns:
        raise ValueError("promote the labels map to columns first, see ranges.promote_labels")
    return [c for c in samples.columns if c not in ("ts", "value")]


@dataclass(frozen=True)
class View:
    """One named view.

    `shape`: gauge (latest sample), mean (windowed mean), rate, increase, rate_ratio (ratio of summed
    rates), rate_ratio_mean (mean of per-series ratios), occupancy, memory_share or positive_count.
    """

    name: str
    shape: str
    metrics: tuple[str, ...]
    func: str | None = None
    by: tuple[str, ...] = ()
    window: int = 60
    step: int = 60
    scale: float = 1.0
    matchers: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    top_matchers: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    unit: str = ""
    back: int = 3600
    needs_job: bool = False

    @property
    def counters(self) -> set[str]:
        return set(self.metrics) if self.shape in ("rate", "increase", "rate_ratio", "rate_ratio_mean") else set()


JOB = ("exported_job",)
DEVICE = ("device",)
OK_STATUS = {"http_status_code": ("=~", "2..")}
GENERATE_OK = {"span_name": ("=", "POST /generate"), **OK_STATUS}
DETECT = {"back": 10800, "needs_job": True}
RESPONSES = "http_server_response_size_bytes_count"

VIEWS = [
    # Detector inputs, three hours back.
    View("detect_pending", "gauge", ("pending_requests",), "avg", JOB, **DETECT),
    View("detect_active", "gauge", ("http_server_active_requests",), "avg", JOB, **DETECT),
    View("detect_running", "gauge", ("running_requests",), "avg", JOB, **DETECT),
    View("detect_kv_cache", "gauge", ("gpu_kv_cache_usage_percent",), "avg", JOB, **DETECT),
    View("detect_new_requests", "rate", ("http_server_requests_total",), "sum", JOB, scale=60.0, **DETECT),
    View("detect_success_requests", "increase", ("traces_spanmetrics_calls_total",), "avg", ("service",),
         matchers=GENERATE_OK, **DETECT),
    View("throughput_probe", "gauge", ("avg_prompt_throughput_tokens_per_second",), "avg", JOB, back=1800),
    # Load-test windows.
    View("test_generation_tps", "gauge", ("avg_generation_throughput_tokens_per_second",), "avg", JOB),
    View("test_prompt_tps", "gauge", ("avg_prompt_throughput_tokens_per_second",), "avg", JOB),
    # Instance page: API.
    View("api_request_rate", "rate", ("http_server_requests_total",), "sum", JOB),
    View("api_executed_rate", "rate", (RESPONSES,), "sum", JOB),
    View("api_success_rate_abs", "rate", (RESPONSES,), "sum", JOB, matchers=OK_STATUS),
    View("api_success_percent", "rate_ratio", (RESPONSES, RESPONSES), "sum", JOB, scale=100.0, top_matchers=OK_STATUS, unit="%"),
    View("api_active", "gauge", ("http_server_active_requests",), "sum", JOB),
    View("api_mean_duration", "rate_ratio", ("http_server_duration_milliseconds_sum", "http_server_duration_milliseconds_count"),
         "sum", JOB, unit="s"),
    View("api_response_bytes", "rate", ("http_server_response_size_bytes_sum",), "sum", JOB, unit="MB/s"),
    View("api_request_bytes", "rate", ("http_server_request_size_bytes_sum",), "sum", JOB, unit="MB/s"),
    # Instance page: engine.
    View("llm_prompt_tps", "gauge", ("vllm:avg_prompt_throughput_toks_per_s",), "sum", JOB, unit="tokens/s"),
    View("llm_generation_tps", "gauge", ("vllm:avg_generation_throughput_toks_per_s",), "sum", JOB, unit="tokens/s"),
    View("llm_running", "gauge", ("vllm:num_requests_running",), "sum", JOB),
    View("llm_waiting", "gauge", ("vllm:num_requests_waiting",), "sum", JOB),
    View("llm_kv", "gauge", ("vllm:gpu_cache_usage_perc",), "sum", JOB, unit="%"),
    View("llm_ttft", "rate_ratio", ("vllm:time_to_first_token_seconds_sum", "vllm:time_to_first_token_seconds_count"),
         "sum", JOB, unit="ms"),
    View("llm_tpot", "rate_ratio", ("vllm:time_per_output_token_seconds_sum", "vllm:time_per_output_token_seconds_count"),
         "sum", JOB, unit="ms"),
    # Instance page: hardware.
    View("gpu_util", "gauge", ("DCGM_FI_DEV_GPU_UTIL",), unit="%"),
    View("gpu_mem_copy", "gauge", ("DCGM_FI_DEV_MEM_COPY_UTIL",), unit="%"),
    # Framebuffer samples are MiB; the view shows GiB.
    View("gpu_fb_used", "gauge", ("DCGM_FI_DEV_FB_USED",), scale=1 / 1024, unit="GiB"),
    View("gpu_sm_clock", "gauge", ("DCGM_FI_DEV_SM_CLOCK",), scale=1e6, unit="MHz"),
    View("gpu_mem_clock", "gauge", ("DCGM_FI_DEV_MEM_CLOCK",), scale=1e6, unit="MHz"),
    View("gpu_mem_temp", "gauge", ("DCGM_FI_DEV_MEMORY_TEMP",), "avg", DEVICE, unit="C"),
    View("gpu_temp", "gauge", ("DCGM_FI_DEV_GPU_TEMP",), "avg", DEVICE, unit="C"),
    View("gpu_power", "gauge", ("DCGM_FI_DEV_POWER_USAGE",), unit="W"),
    View("gpu_xid_errors", "positive_count", ("DCGM_FI_DEV_XID_ERRORS",), "count", step=15),
    # Cluster dashboard.
    View("cluster_gpu_occupancy", "occupancy", ("DCGM_FI_DEV_FB_USED", "DCGM_FI_DEV_FB_FREE"), window=300),
    View("cluster_gpu_util", "mean", ("DCGM_FI_DEV_GPU_UTIL",), "avg", window=300),
    View("cluster_gpu_mem", "memory_share", ("DCGM_FI_DEV_FB_USED", "DCGM_FI_DEV_FB_FREE"), window=300, scale=100.0),
    View("svc_new_rps", "rate", (RESPONSES,), "sum", JOB, window=300),
    View("svc_success_rps", "rate", (RESPONSES,), "sum", JOB, window=300, matchers=OK_STATUS),
    View("svc_exec_time", "rate_ratio", ("http_server_duration_milliseconds_sum", "http_server_duration_milliseconds_count"),
         "sum", JOB, window=300, scale=1 / 1000),
    View("svc_ttft", "rate_ratio_mean", ("vllm:time_to_first_token_seconds_sum", "vllm:time_to_first_token_seconds_count"),
         "avg", JOB, window=300),
    View("svc_tpot", "rate_ratio_mean", ("vllm:time_per_output_token_seconds_sum", "vllm:time_per_output_token_seconds_count"),
         "avg", JOB, window=300),
    View("svc_prompt_tps", "mean", ("vllm:avg_prompt_throughput_toks_per_s",), "avg", JOB, window=300),
    View("svc_generation_tps", "mean", ("vllm:avg_generation_throughput_toks_per_s",), "avg", JOB, window=300),
]
BY_NAME = {v.name: v for v in VIEWS}


def run_view(
    view: View,
    samples: DataFrame,
    start: int,
    end: int,
    stretch: int = 1,
    job: str | None = None,
    offset: int = 0,
) -> DataFrame:
    """Evaluate a view over `start..end`; `job` restricts it to one service, `offset` shifts it back in time.

    With an offset the result carries the timestamps of the current period, so that both can be overlaid.
    """
    start, end = start - offset, end - offset
    step, window, lookback = (x * stretch for x in (view.step * cat.SECOND, view.window * cat.SECOND, cat.LOOKBACK))
    keys = series_keys(samples)
    chosen = samples.filter(F.col("metric").isin(*dict.fromkeys(view.metrics)))
    if job is not None:
        chosen = rg.label_match(chosen, {view.by[0] if view.by else "exported_job": ("=~", f"{job}.*")})
    chosen = rg.label_match(chosen, view.matchers)
    result = _evaluate(view, chosen, keys, start, end, step, window, lookback)
    if view.scale != 1.0:
        result = result.withColumn("value", F.col("value") * view.scale)
    return result.withColumn("ts", F.col("ts") + offset) if offset else result


def _evaluate(view, chosen, keys, start, end, step, window, lookback) -> DataFrame:
    by = list(view.by)
    if view.shape == "gauge":
        vector = rg.instant_at_step(chosen, keys, start, end, step, lookback)
        return rg.agg_by(vector, view.func, by) if view.func else vector.select(
            *[k for k in keys if k != "metric"], "ts", "value"
        )
    if view.shape == "mean":
        return rg.agg_by(rg.avg_over_time(chosen, keys, window, start, end, step), view.func, by)
    if view.shape == "rate":
        return rg.agg_by(rg.rate(chosen, keys, window, start, end, step), view.func, by)
    if view.shape == "increase":
        return rg.agg_by(rg.increase(chosen, keys, window, start, end, step), view.func, by)
    if view.shape == "positive_count":
        vector = rg.instant_at_step(chosen, keys, start, end, step, lookback)
        return rg.agg_by(rg.compare_filter(vector, ">", 0), "count", by)
    # The remaining shapes combine two metrics of one table: conditional aggregation over a single pass.
    top, bottom = view.metrics
    is_top, is_bottom = F.col("metric") == top, F.col("metric") == bottom
    for label, (op, wanted) in view.top_matchers.items():
        assert op == "=~"
        is_top = is_top & F.col(label).rlike(rg.regex_anchored(wanted))
    value = F.col("value")
    if view.shape == "rate_ratio":
        rates = rg.rate(chosen, keys, window, start, end, step)
        sums = rates.groupBy(*by, "ts").agg(
            F.sum(F.when(is_top, value)).alias("_t"), F.sum(F.when(is_bottom, value)).alias("_b")
        )
        return sums.select(*by, "ts", ratio(F.col("_t"), F.col("_b")).alias("value")).filter("value IS NOT NULL")
    series = [k for k in keys if k != "metric"]
    if view.shape == "rate_ratio_mean":
        rates = rg.rate(chosen, keys, window, start, end, step)
        pairs = rates.groupBy(*series, "ts").agg(
            F.max(F.when(is_top, value)).alias("_t"), F.max(F.when(is_bottom, value)).alias("_b")
        )
        ratios = pairs.select(*by, "ts", ratio(F.col("_t"), F.col("_b")).alias("value")).filter("value IS NOT NULL")
        return rg.agg_by(ratios, view.func, by)
    means = rg.avg_over_time(chosen, keys, window, start, end, step)
    if view.shape == "memory_share":
        sums = means.groupBy("ts").agg(
            F.sum(F.when(is_top, value)).alias("_t"), F.sum(F.when(is_bottom, value)).alias("_b")
        )
        return sums.select("ts", ratio(F.col("_t"), F.col("_t") + F.col("_b")).alias("value")).filter("value IS NOT NULL")
    if view.shape == "occupancy":
        pairs = means.groupBy(*series, "ts").agg(
            F.max(F.when(is_top, value)).alias("_t"), F.max(F.when(is_bottom, value)).alias("_b")
        )
        share = ratio(F.col("_t"), F.col("_t") + F.col("_b"))
        busy = pairs.groupBy("ts").agg(F.count_if(share > 0.01).cast("double").alias("_busy")).filter("_busy > 0")
        cards = rg.agg_by(rg.instant_at_step(chosen.filter(F.col("metric") == top), keys, start, end, step, lookback), "count")
        return rg.vector_op(
            busy.select("ts", F.col("_busy").alias("value")), cards, [], "/"
        )
    raise ValueError(f"unknown view shape {view.shape}")


def displayed(view: View, rows: DataFrame) -> DataFrame:
    """A view's result as a chart shows it: view, its labels, ts, unit and shown (three decimals).

    Throughputs in MB/s are shown in the unit that suits the chart: by the sum of its values per series, from B/s to TB/s. This
    unit is found first, as one row.
    """
    labels = [c for c in rows.columns if c not in ("ts", "value")]
    named = rows.withColumn("view", F.lit(view.name))
    if view.unit == "MB/s":
        size = adaptive_unit(named, ["view"], labels).first()
        # An empty chart keeps megabytes.
        unit, factor = (size["unit"], size["factor"]) if size else (view.unit, float(1024**2))
        named = named.withColumn("unit", F.lit(unit))
        shown = display_value(F.col("value"), F.lit(view.unit), F.lit(factor))
    else:
        named = named.withColumn("unit", F.lit(view.unit))
        shown = display_value(F.col("value"), F.col("unit"))
    return named.select("view", *labels, "ts", "unit", shown.alias("shown"))


VECTOR_OF_SHAPE = {"gauge": "instant", "mean": "mean", "rate": "rate", "rate_ratio": "rate", "increase": "increase"}


def _vector(kind, chosen, keys, start, end, step, window, lookback) -> DataFrame:
    if kind == "instant":
        return rg.instant_at_step(chosen, keys, start, end, step, lookback)
    over = {"mean": rg.avg_over_time, "rate": rg.rate, "increase": rg.increase}[kind]
    return over(chosen, keys, window, start, end, step)


def _shared(v: View) -> bool:
    return v.shape in VECTOR_OF_SHAPE and v.func in ("sum", "avg") and v.by in (JOB, DEVICE, (), ("service",))


def _matches(matchers: Mapping[str, tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for label, (op, wanted) in matchers.items():
        value = F.coalesce(F.col(label), F.lit(""))
        cond = cond & (value == wanted if op == "=" else value.rlike(rg.regex_anchored(wanted)))
    return cond


def run_dashboard(
    views: Iterable[View], samples: DataFrame, start: int, end: int, stretch: int = 1, job: str | None = None
) -> DataFrame:
    """Several views as one long table: view, exported_job, device, series, ts, value.

    `series` holds all labels of a series, as JSON, in the rows of views without grouping; it is NULL elsewhere.

    Views that share a vector function, window and step are evaluated together: samples are read and
    shuffled once, every (series, tick) value is handed to the views it feeds, and one aggregation keyed by
    (view, label, tick) finishes all of them. The remaining views run one by one.
    """
    views = list(views)
    if job is not None:
        samples = rg.label_match(samples, {"exported_job": ("=~", f"{job}.*")})
    groups: dict[tuple, list[View]] = {}
    parts: list[DataFrame] = []
    for v in views:
        if _shared(v):
            window = v.window if VECTOR_OF_SHAPE[v.shape] != "instant" else 0
            groups.setdefault((VECTOR_OF_SHAPE[v.shape], window, v.step), []).append(v)
        else:
            parts.append(_as_long(v, run_view(v, samples, start, end, stretch)))
    keys = series_keys(samples)
    for (kind, window, step), members in groups.items():
        metrics = sorted({m for v in members for m in v.metrics})
        vector = _vector(
            kind, samples.filter(F.col("metric").isin(*metrics)), keys, start, end,
            step * stretch * cat.SECOND, window * stretch * cat.SECOND, cat.LOOKBACK * stretch,
        )
        parts.append(_finish_shared(vector, members))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _finish_shared(vector: DataFrame, members: Sequence[View]) -> DataFrame:
    null = F.lit(None).cast("string")
    feeds = []
    for v in members:
        job = F.col(v.by[0]) if v.by in (JOB, ("service",)) else null
        device = F.col("device") if v.by == DEVICE else null
        base = _matches(v.matchers)
        top = base & (F.col("metric") == v.metrics[0]) & _matches(v.top_matchers)
        roles = [(top, 0)] if v.shape != "rate_ratio" else [(top, 0), (base & (F.col("metric") == v.metrics[1]), 1)]
        for cond, role in roles:
            feeds.append(F.when(cond, F.struct(
                F.lit(v.name).alias("view"), F.lit(role).alias("role"), job.alias("job"), device.alias("dev")
            )))
    fed = vector.select("ts", "value", F.explode(F.array_compact(F.array(*feeds))).alias("f"))
    value, role = F.col("value"), F.col("f.role")
    sums = fed.groupBy("f.view", "f.job", "f.dev", "ts").agg(
        F.sum(F.when(role == 0, value)).alias("_t"), F.sum(F.when(role == 1, value)).alias("_b"),
        F.count(F.when(role == 0, value)).alias("_n"),
    )
    result = None
    for v in members:
        x = {"rate_ratio": ratio(F.col("_t"), F.col("_b"))}.get(v.shape, ratio(F.col("_t"), F.col("_n")) if v.func == "avg" else F.col("_t"))
        scaled = x * v.scale if v.scale != 1.0 else x
        branch = F.col("view") == v.name
        result = F.when(branch, scaled) if result is None else result.when(branch, scaled)
    return sums.select(
        "view", F.col("job").alias("exported_job"), F.col("dev").alias("device"), null.alias("series"), "ts", result.alias("value")
    ).filter("value IS NOT NULL")


def _as_long(v: View, rows: DataFrame) -> DataFrame:
    label = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    job = F.col("service") if "service" in rows.columns else label("exported_job")
    labels = [c for c in rows.columns if c not in ("ts", "value")]
    series = F.to_json(F.struct(*labels)) if v.shape == "gauge" and not v.func and labels else F.lit(None).cast("string")
    return rows.select(
        F.lit(v.name).alias("view"), job.alias("exported_job"), label("device").alias("device"), series.alias("series"), "ts", "value")


def comparison_offset(name: str) -> int:
    """One of the offsets offered for charts: hour, day, week or month."""
    return cat.COMPARE_MINUTES[name] * cat.MINUTE


# Detector view -> metric name in the replica bundle.
BUNDLE_NAMES = {
    "detect_pending": "pending", "detect_active": "active", "detect_running": "running", "detect_kv_cache": "kv_cache",
    "detect_new_requests": "server_new", "detect_success_requests": "server_success",
}


def replica_metrics(samples: DataFrame, start: int, end: int, stretch: int = 1, job: str | None = None) -> DataFrame:
    """The six detector series of every replica of every service: service, replica, metric, ts, value.

    The service is the part of the replica name before `-replica`.
    """
    long = run_dashboard([BY_NAME[n] for n in BUNDLE_NAMES], samples, start, end, stretch, job)
    names = F.create_map(*[F.lit(x) for kv in BUNDLE_NAMES.items() for x in kv])
    return long.select(
        F.regexp_replace("exported_job", "-replica.*$", "").alias("service"),
        F.col("exported_job").alias("replica"),
        names[F.col("view")].alias("metric"),
        "ts",
        "value",
    )
