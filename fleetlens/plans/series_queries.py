"""Registered queries: series regularisation, detection inputs, range functions and metric views."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import ranges as rg
from fleetlens.operators import series as sr
from fleetlens.plans import sql as q
from fleetlens.plans.registry import query
from fleetlens.plans.views import BUNDLE_NAMES, BY_NAME, VIEWS, View, comparison_offset, displayed, replica_metrics, run_dashboard, run_view
from fleetlens.sources import fixtures as fx

DAY = fx.DAY
START, END = q.STEP0, q.STEP1
KEYS = ["service", "replica", "metric"]
SKEYS = "metric, service, replica"
# The daily fixture holds one row per series and day: bounded series.
BOUNDED = None


def _six(c):
    """Six digits; means of two-decimal values often end in a 5 at the cut, so both engines are nudged alike."""
    return F.round(F.col(c) + 1e-9, 6)


def _round(df, *cols):
    return df.withColumns({c: _six(c) for c in cols})


@query("sampling_interval", q.with_ctes(q.BUNDLE, q.intervals("bundle")) +
       "SELECT service, replica, metric, points, last_ts, freq FROM stats")
def sampling_interval(spark, d):
    return sr.sampling_interval(fx.replica_bundle(spark, d), KEYS, chunk=BOUNDED)


@query("sampling_interval_raw", q.with_ctes(q.SAMPLES, q.intervals("samples", share=0.002)) +
       "SELECT service, replica, metric, points, last_ts, freq FROM stats")
def sampling_interval_raw(spark, d):
    return sr.sampling_interval(fx.samples(spark, d), KEYS, share=0.002)


@query("sample_gap", q.with_ctes(q.SAMPLES) + f"""
  SELECT metric, service, replica, ts, ts - lag(ts) OVER (PARTITION BY {SKEYS} ORDER BY ts) AS gap FROM samples""")
def sample_gap(spark, d):
    from fleetlens.operators.chunks import with_previous

    gaps = with_previous(fx.samples(spark, d).select(*KEYS, "ts"), KEYS, ["ts"], width=DAY)
    return gaps.select(*KEYS, "ts", (F.col("ts") - F.col("prev_ts")).alias("gap"))


REGULAR_SQL = q.with_ctes(q.BUNDLE, q.regular("bundle")) + (
    "SELECT service, replica, metric, ts, freq, round(value + 1e-9, 6) AS value FROM reg"
)


@query("regularise", REGULAR_SQL)
def regularise(spark, d):
    reg = sr.regularise(fx.replica_bundle(spark, d), KEYS, unit=DAY, chunk=BOUNDED)
    return _round(reg.filter("freq IS NOT NULL").drop("starts"), "value")


@query("regularise_chunked", REGULAR_SQL)
def regularise_chunked(spark, d):
    reg = sr.regularise(fx.replica_bundle(spark, d), KEYS, unit=DAY, chunk=7 * DAY)
    return _round(reg.filter("freq IS NOT NULL").drop("starts"), "value")


@query("sum_replicas", q.with_ctes(q.BUNDLE, q.regular("bundle"), q.SUMMED) +
       "SELECT service, metric, ts, round(value + 1e-9, 6) AS value, n_valid FROM summed")
def sum_replicas(spark, d):
    reg = sr.regularise(fx.replica_bundle(spark, d), KEYS, unit=DAY, chunk=BOUNDED, keep_irregular=False)
    return _round(sr.sum_replicas(reg, ["service", "metric"]), "value")


@query("resample_2d", q.with_ctes(q.BUNDLE, q.regular("bundle"), q.SUMMED, q.resampled(2 * DAY)) +
       "SELECT service, metric, ts, round(total + 1e-9, 6) AS total, round(mean + 1e-9, 6) AS mean, n_valid FROM resampled")
def resample_2d(spark, d):
    reg = sr.regularise(fx.replica_bundle(spark, d), KEYS, unit=DAY, chunk=BOUNDED, keep_irregular=False)
    out = sr.resample(sr.sum_replicas(reg, ["service", "metric"]), ["service", "metric"], 2 * DAY, extra=["n_valid"])
    return _round(out, "total", "mean")


@query("resample_1h", q.with_ctes(q.SAMPLES) + f"""
  , bins AS (SELECT {SKEYS}, ts - ts % {q.HOUR} AS ts, sum(value) AS s, avg(value) AS a FROM samples GROUP BY ALL),
  grid AS (SELECT {SKEYS}, unnest(range(min(ts), max(ts) + 1, {q.HOUR})) AS ts FROM bins GROUP BY {SKEYS})
  SELECT g.metric, g.service, g.replica, g.ts, round(coalesce(s, 0.0e0) + 1e-9, 6) AS total, round(a + 1e-9, 6) AS mean
  FROM grid g LEFT JOIN bins b ON b.metric = g.metric AND b.service = g.service AND b.replica = g.replica AND b.ts = g.ts""")
def resample_1h(spark, d):
    return _round(sr.resample(fx.samples(spark, d), KEYS, q.HOUR), "total", "mean")


@query("last_m_points", q.with_ctes(q.SAMPLES) + f"""
  SELECT metric, service, replica, ts, value FROM samples
  QUALIFY row_number() OVER (PARTITION BY {SKEYS} ORDER BY ts DESC) <= 3""")
def last_m_points(spark, d):
    return sr.last_points(fx.samples(spark, d), KEYS, 3).select(*KEYS, "ts", "value")


@query("tail_all", q.with_ctes(q.SAMPLES) + f"""
  , t AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY {SKEYS} ORDER BY ts DESC) <= 3)
  SELECT metric, service, replica, bool_and(value >= 20) AS all_true FROM t GROUP BY {SKEYS}""")
def tail_all(spark, d):
    return sr.tail_all(fx.samples(spark, d), KEYS, 3, F.col("value") >= 20)


@query("tail_percentile", q.with_ctes(q.SAMPLES) + f"""
  , t AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY {SKEYS} ORDER BY ts DESC) <= 3)
  SELECT metric, service, replica, round(quantile_cont(value, 0.9) + 1e-9, 6) AS pct FROM t GROUP BY {SKEYS}""")
def tail_percentile(spark, d):
    return _round(sr.tail_percentile(fx.samples(spark, d), KEYS, 3, 0.9), "pct")


@query("reporting_replicas", q.with_ctes(q.BUNDLE, q.intervals("bundle")) + """
  SELECT service, metric, count(freq) AS n_valid, count(*) AS n_replicas FROM stats GROUP BY service, metric""")
def reporting_replicas(spark, d):
    stats = sr.sampling_interval(fx.replica_bundle(spark, d), KEYS, chunk=BOUNDED)
    return sr.reporting_replicas(stats, ["service", "metric"])


@query("replica_pivot", q.with_ctes(q.DAYS) + """
  SELECT service, replica, ts, active, running, round(pending + 1e-9, 6) AS pending, server_new, server_success,
         round(kv_cache + 1e-9, 6) AS kv_cache FROM days""")
def replica_pivot(spark, d):
    return _round(sr.pivot_replicas(fx.replica_bundle(spark, d), ["service", "replica"]), "pending", "kv_cache")


@query("stale_reset", q.with_ctes(q.SAMPLES) + f"""
  , n AS (SELECT *, lead(ts) OVER (PARTITION BY {SKEYS} ORDER BY ts) AS nx FROM samples)
  SELECT metric, service, replica, ts, value, false AS stale FROM n
  UNION ALL SELECT metric, service, replica, ts + {900 * q.SECOND}, 0.0e0, true FROM n WHERE nx IS NULL OR nx - ts > {900 * q.SECOND}""")
def stale_reset(spark, d):
    return sr.reset_stale(fx.samples(spark, d), KEYS, timeout=900 * q.SECOND, chunk=DAY)


@query("previous_period", q.with_ctes(q.DAYS) + f"""
  , s AS (SELECT service, replica, ts, pending AS value FROM days)
  SELECT service, replica, ts, round(a.value + 1e-9, 6) AS current, round(b.value + 1e-9, 6) AS previous
  FROM s a FULL JOIN (SELECT service, replica, ts + {7 * DAY} AS ts, value FROM s) b USING (service, replica, ts)""")
def previous_period(spark, d):
    series = fx.replica_days(spark, d).select("service", "replica", "ts", F.col("pending").alias("value"))
    return _round(sr.previous_period(series, ["service", "replica"], 7 * DAY), "current", "previous")


@query("overlay", q.with_ctes(q.DAYS) + f"""
  SELECT service, replica, ts, round(pending + 1e-9, 6) AS value, 'current' AS period FROM days
  WHERE ts BETWEEN {START + 14 * DAY} AND {END}
  UNION ALL SELECT service, replica, ts + {7 * DAY}, round(pending + 1e-9, 6), 'previous' FROM days
  WHERE ts BETWEEN {START + 7 * DAY} AND {END - 7 * DAY}""")
def overlay(spark, d):
    series = fx.replica_days(spark, d).select("service", "replica", "ts", _six("pending").alias("value"))
    return sr.overlay(series, 7 * DAY, START + 14 * DAY, END)


# Range functions over raw series: hourly ticks.
HOUR = q.HOUR


@query("instant_at_step", q.with_ctes(q.SAMPLES) + f"""
  , ticks AS (SELECT unnest(range({START}, {END} + 1, {HOUR})) AS t),
  grid AS (SELECT DISTINCT metric, service, replica, t FROM samples, ticks)
  SELECT g.metric, g.service, g.replica, g.t AS ts, s.value
  FROM grid g ASOF JOIN samples s
    ON g.metric = s.metric AND g.service = s.service AND g.replica = s.replica AND g.t >= s.ts
  WHERE s.ts > g.t - {6 * HOUR}""")
def instant_at_step(spark, d):
    return rg.instant_at_step(fx.samples(spark, d), KEYS, START, END, HOUR, 6 * HOUR)


@query("rate", q.with_ctes(q.COUNTERS, q.ticks(HOUR), q.rate_cte("r", "counters", SKEYS, 6 * HOUR)) +
       "SELECT metric, service, replica, ts, round(value + 1e-9, 6) AS value FROM r")
def rate(spark, d):
    return _round(rg.rate(fx.counters(spark, d), KEYS, 6 * HOUR, START, END, HOUR), "value")


@query("increase", q.with_ctes(q.COUNTERS, q.ticks(HOUR), q.rate_cte("r", "counters", SKEYS, 6 * HOUR, False)) +
       "SELECT metric, service, replica, ts, round(value + 1e-9, 6) AS value FROM r")
def increase(spark, d):
    return _round(rg.increase(fx.counters(spark, d), KEYS, 6 * HOUR, START, END, HOUR), "value")


@query("avg_over_time", q.with_ctes(q.SAMPLES, q.ticks(HOUR), q.mean_cte("m", "samples", SKEYS, 6 * HOUR)) +
       "SELECT metric, service, replica, ts, round(value + 1e-9, 6) AS value FROM m")
def avg_over_time(spark, d):
    return _round(rg.avg_over_time(fx.samples(spark, d), KEYS, 6 * HOUR, START, END, HOUR), "value")


@query("agg_by_service", q.with_ctes(q.SAMPLES, q.ticks(HOUR), q.instant_cte("i", "samples", SKEYS, 6 * HOUR)) + """
  SELECT metric, service, ts, round(sum(value) + 1e-9, 6) AS total, round(avg(value) + 1e-9, 6) AS mean, count(*) AS n
  FROM i GROUP BY metric, service, ts""")
def agg_by_service(spark, d):
    vector = rg.instant_at_step(fx.samples(spark, d), KEYS, START, END, HOUR, 6 * HOUR)
    return vector.groupBy("metric", "service", "ts").agg(
        F.round(F.sum("value") + 1e-9, 6).alias("total"), F.round(F.avg("value") + 1e-9, 6).alias("mean"), F.count("*").alias("n")
    )


@query("vector_ratio", q.with_ctes(q.SAMPLES, q.ticks(HOUR), q.instant_cte("i", "samples", SKEYS, 6 * HOUR)) + """
  , t AS (SELECT metric, service, ts, sum(value) AS v FROM i GROUP BY ALL)
  SELECT a.service, a.ts, round(a.v / b.v + 1e-9, 6) AS value FROM t a JOIN t b ON a.service = b.service AND a.ts = b.ts
  WHERE a.metric = 'error' AND b.metric = 'view' AND b.v <> 0""")
def vector_ratio(spark, d):
    picked = fx.samples(spark, d).filter(F.col("metric").isin("error", "view"))
    totals = rg.agg_by(rg.instant_at_step(picked, KEYS, START, END, HOUR, 6 * HOUR), "sum", ["metric", "service"])
    left, right = totals.filter("metric = 'error'"), totals.filter("metric = 'view'")
    return _round(rg.vector_op(left, right, ["service"], "/"), "value")


LABELLED = q.EV + """, labelled AS (
  SELECT event_id, event_type AS metric, ts, value, replica AS exported_job,
         CASE WHEN user_id % 5 = 0 THEN '500' ELSE '200' END AS http_status_code, 'host-' || CAST(user_id % 4 AS VARCHAR) AS host
  FROM ev)"""


def _labelled(spark, d):
    labels = F.create_map(
        F.lit("exported_job"), F.col("replica"),
        F.lit("http_status_code"), F.when(F.col("user_id") % 5 == 0, "500").otherwise("200"),
        F.lit("http.host"), F.concat(F.lit("host-"), (F.col("user_id") % 4).cast("string")),
    )
    return fx.events(spark, d).select(
        "event_id", F.col("event_type").alias("metric"), labels.alias("labels"), "ts", "value"
    )


@query("label_match", q.with_ctes(LABELLED) + """
  SELECT event_id, metric, ts, value FROM labelled
  WHERE regexp_full_match(exported_job, 'svc-1-replica.*') AND regexp_full_match(http_status_code, '2..')
    AND host = 'host-2'""")
def label_match(spark, d):
    found = rg.label_match(_labelled(spark, d), {
        "exported_job": ("=~", "svc-1-replica.*"), "http_status_code": ("=~", "2.."), "http.host": ("=", "host-2"),
    })
    return found.select("event_id", "metric", "ts", "value")


@query("label_edit", q.with_ctes(LABELLED) + """
  SELECT event_id, 'c1' AS cluster_id, CAST(NULL AS VARCHAR) AS host, exported_job || '-x' AS exported_job, 2 AS n_rest
  FROM labelled""")
def label_edit(spark, d):
    out = rg.drop_labels(_labelled(spark, d), ["http.server_name", "http.host"])
    out = rg.add_label(rg.add_label(out, "cluster_id", "c1"), "cluster_id", "c2")
    out = rg.tag_service(out, F.concat(F.col("labels")["exported_job"], F.lit("-x")))
    return out.select(
        "event_id",
        F.col("labels")["cluster_id"].alias("cluster_id"),
        F.col("labels")["http.host"].alias("host"),
        F.col("labels")["exported_job"].alias("exported_job"),
        (F.size("labels") - 1).alias("n_rest"),
    )


@query("filter_service_series", q.with_ctes(q.SAMPLES) +
       "SELECT metric, replica, ts, value FROM samples WHERE contains(replica, 'svc-2')")
def filter_service_series(spark, d):
    rows = fx.samples(spark, d).select("metric", "replica", "ts", "value")
    return rg.filter_service_series(rows, "svc-2", "replica")


@query("adaptive_unit", q.with_ctes(q.SAMPLES) + """
  , s AS (SELECT metric, service, replica, sum(value) AS v FROM samples GROUP BY ALL),
  a AS (SELECT metric, sum(v) / count(*) AS average FROM s GROUP BY metric),
  k AS (SELECT *, CASE WHEN average >= 1 THEN least(CAST(floor(log10(average) / 3) AS INTEGER), 4) ELSE 0 END AS i FROM a)
  SELECT metric, round(average + 1e-9, 6) AS average, ['B/s', 'KB/s', 'MB/s', 'GB/s', 'TB/s'][i + 1] AS unit, pow(1024.0e0, i) AS factor
  FROM k""")
def adaptive_unit(spark, d):
    from fleetlens.operators.inventory import adaptive_unit as unit_of

    return _round(unit_of(fx.samples(spark, d), ["metric"], ["service", "replica"]), "average")


@query("display_scaling", q.with_ctes(q.SAMPLES) + """
  SELECT metric, service, replica, ts, CASE metric WHEN 'click' THEN 's' WHEN 'error' THEN 'GB' WHEN 'view' THEN 'MB/s' ELSE '' END AS unit,
    round(value * 1000000 / CASE metric WHEN 'click' THEN 1000.0e0 WHEN 'error' THEN 1073741824.0e0 WHEN 'view' THEN 1048576.0e0
      ELSE 1.0e0 END, 3) AS shown FROM samples""")
def display_scaling(spark, d):
    from fleetlens.functions.expressions import display_value

    unit = F.when(F.col("metric") == "click", "s").when(F.col("metric") == "error", "GB").when(
        F.col("metric") == "view", "MB/s").otherwise("")
    rows = fx.samples(spark, d).withColumn("unit", unit)
    return rows.select(*KEYS, "ts", "unit", display_value(F.col("value") * 1000000, F.col("unit")).alias("shown"))


# Metric views. The events are sparse, so a minute of the dashboards stands for a day here.
STRETCH = 1440
VIEW_KEYS = "metric, exported_job, device, http_status_code"
JOB_PATTERN = "svc-1-replica"


ALL_METRICS = sorted({m for v in VIEWS for m in v.metrics})
ALL_COUNTERS = {m for v in VIEWS for m in v.counters}


def all_view_samples(spark, d, *views: View):
    """The one table of samples that all views read; of named views, the samples of their metrics."""
    return fx.view_samples(spark, d, ALL_METRICS, ALL_COUNTERS, {m for v in views for m in v.metrics} or None)


def _view_sql(v: View, one_job: bool = True) -> str:
    own = ", ".join(f"('{m}', {k})" for k, m in enumerate(ALL_METRICS) if m in v.metrics)
    job = f" AND regexp_full_match(replica, '{JOB_PATTERN}.*')" if v.needs_job and one_job else ""
    status = " AND user_id % 5 <> 0" if "http_status_code" in v.matchers else ""
    base = f"""base AS (
      SELECT m.metric, replica AS exported_job, 'gpu' || CAST((user_id // 6) % 2 AS VARCHAR) AS device,
             CASE WHEN user_id % 5 = 0 THEN '500' ELSE '200' END AS http_status_code, ts, event_id, value + m.k AS value, cents + 100 * m.k AS cents
      FROM ev, (VALUES {own}) AS m(metric, k) WHERE true{job}{status})"""
    if v.counters:
        src = f"""steps AS (SELECT {VIEW_KEYS}, ts, sum(cents) AS c FROM base GROUP BY ALL), src AS (
          SELECT {VIEW_KEYS}, ts,
                 CAST(sum(c) OVER (PARTITION BY {VIEW_KEYS}, ts // {q.RESET} ORDER BY ts) AS BIGINT) / 100.0e0 AS value FROM steps)"""
    else:
        src = f"src AS (SELECT {VIEW_KEYS}, ts, arg_max(value, event_id) AS value FROM base GROUP BY ALL)"
    step, window, look = (x * STRETCH * q.SECOND for x in (v.step, v.window, 300))
    parts = [q.EV, base, src, q.ticks(step)]
    by = ", ".join("exported_job AS service" if b == "service" else b for b in v.by)
    by_prefix = by + ", " if by else ""
    group = ", ".join(["exported_job" if b == "service" else b for b in v.by] + ["ts"])
    value = f"round(CAST({{}} AS DOUBLE) * {v.scale!r}e0 + 1e-9, 6) AS value".replace("e0e0", "e0") if "e" not in repr(v.scale) \
        else f"round(CAST({{}} AS DOUBLE) * {v.scale!r} + 1e-9, 6) AS value"
    top, bottom = v.metrics[0], v.metrics[-1]
    top_cond = f"metric = '{top}'" + (" AND http_status_code LIKE '2__'" if v.top_matchers else "")
    t = f"sum(value) FILTER ({top_cond})"
    b = f"sum(value) FILTER (metric = '{bottom}')"
    pair = "exported_job, device, http_status_code"
    if v.shape in ("gauge", "positive_count"):
        parts.append(q.instant_cte("x", "src", VIEW_KEYS, look))
    elif v.shape in ("mean", "memory_share", "occupancy"):
        parts.append(q.mean_cte("x", "src", VIEW_KEYS, window))
    else:
        parts.append(q.rate_cte("x", "src", VIEW_KEYS, window, v.shape != "increase"))
    if v.shape in ("gauge", "mean", "rate", "increase"):
        if v.func is None:
            tail = ("SELECT exported_job, device, http_status_code, exported_job AS service, 'POST /generate' AS span_name, ts, "
                    f"{value.format('value')} FROM x")
        else:
            tail = f"SELECT {by_prefix}ts, {value.format(f'{v.func}(value)')} FROM x GROUP BY {group}"
    elif v.shape == "positive_count":
        tail = f"SELECT ts, {value.format('count(*)')} FROM x WHERE value > 0 GROUP BY ts"
    elif v.shape == "rate_ratio":
        parts.append(f"y AS (SELECT {by_prefix}ts, {t} AS t, {b} AS b FROM x GROUP BY {group})")
        tail = f"SELECT {group}, {value.format('t / b')} FROM y WHERE t IS NOT NULL AND b <> 0"
    elif v.shape == "memory_share":
        parts.append(f"y AS (SELECT ts, {t} AS t, {b} AS b FROM x GROUP BY ts)")
        tail = f"SELECT ts, {value.format('t / (t + b)')} FROM y WHERE t + b <> 0"
    elif v.shape == "rate_ratio_mean":
        parts.append(f"y AS (SELECT {pair}, ts, {t} AS t, {b} AS b FROM x GROUP BY ALL)")
        tail = f"SELECT {by_prefix}ts, {value.format('avg(t / b)')} FROM y WHERE t IS NOT NULL AND b <> 0 GROUP BY {group}"
    else:
        parts.append(f"y AS (SELECT {pair}, ts, {t} AS t, {b} AS b FROM x GROUP BY ALL)")
        parts.append("busy AS (SELECT ts, count(*) FILTER (t / (t + b) > 0.01) AS n FROM y GROUP BY ts)")
        parts.append(q.instant_cte("z", f"(SELECT * FROM src WHERE metric = '{top}')", VIEW_KEYS, look))
        parts.append("cards AS (SELECT ts, count(*) AS n FROM z GROUP BY ts)")
        tail = f"SELECT ts, {value.format('b.n / CAST(c.n AS DOUBLE)')} FROM busy b JOIN cards c USING (ts) WHERE b.n > 0"
    return q.with_ctes(*parts) + tail


def _view_query(v: View):
    def run(spark, d):
        samples = all_view_samples(spark, d, v)
        out = run_view(v, samples, START, END, STRETCH, JOB_PATTERN if v.needs_job else None)
        return _round(out, "value")

    run.__name__ = f"view_{v.name}"
    return run


for _v in VIEWS:
    query(f"view_{_v.name}", _view_sql(_v))(_view_query(_v))


API_VIEWS = [v for v in VIEWS if v.name in ("api_executed_rate", "api_success_rate_abs", "api_success_percent", "api_active",
                                            "api_mean_duration", "svc_ttft", "gpu_temp")]


def _dashboard_sql(views) -> str:
    arms = []
    for v in views:
        job = "exported_job" if v.by == ("exported_job",) else "service" if v.by == ("service",) else "CAST(NULL AS VARCHAR)"
        device = "device" if v.by == ("device",) else "CAST(NULL AS VARCHAR)"
        arms.append(f"SELECT '{v.name}' AS view, {job} AS exported_job, {device} AS device, CAST(NULL AS VARCHAR) AS series, ts, value FROM ({_view_sql(v, False)})")
    return " UNION ALL ".join(arms)


@query("dashboard", _dashboard_sql(API_VIEWS))
def dashboard(spark, d):
    """Panels of three pages at once: one pass per vector function and window."""
    out = run_dashboard(API_VIEWS, all_view_samples(spark, d, *API_VIEWS), START, END, STRETCH)
    return _round(out, "value")


WEEK = comparison_offset("week")
COMPARED = BY_NAME["svc_new_rps"]
_CURRENT_SQL, _EARLIER_SQL = (
    _view_sql(COMPARED).replace(q.ticks(STRETCH * 60 * q.SECOND), q.ticks(STRETCH * 60 * q.SECOND, START + 14 * DAY - shift, END - shift))
    for shift in (0, WEEK)
)


@query("chart_comparison", f"""SELECT exported_job, ts, value, 'current' AS period FROM ({_CURRENT_SQL})
  UNION ALL SELECT exported_job, ts + {WEEK}, value, 'previous' FROM ({_EARLIER_SQL})""")
def chart_comparison(spark, d):
    """A chart with the week before laid over it."""
    samples = all_view_samples(spark, d, COMPARED)
    current = run_view(COMPARED, samples, START + 14 * DAY, END, STRETCH).withColumn("period", F.lit("current"))
    earlier = run_view(COMPARED, samples, START + 14 * DAY, END, STRETCH, offset=WEEK).withColumn("period", F.lit("previous"))
    return _round(current.unionByName(earlier), "value")


BUNDLE_SQL = f"""
  SELECT regexp_replace(exported_job, '-replica.*$', '') AS service, exported_job AS replica,
         CASE view {" ".join(f"WHEN '{k}' THEN '{m}'" for k, m in BUNDLE_NAMES.items())} END AS metric, ts, value
  FROM ({_dashboard_sql([BY_NAME[n] for n in BUNDLE_NAMES])})"""


def bundle_from_samples(spark, d):
    return _round(replica_metrics(all_view_samples(spark, d, *[BY_NAME[n] for n in BUNDLE_NAMES]), START, END, STRETCH), "value")


@query("replica_metrics", BUNDLE_SQL)
def replica_metrics_query(spark, d):
    return bundle_from_samples(spark, d)


@query("compare_filter", q.with_ctes(q.SAMPLES, q.ticks(HOUR), q.instant_cte("i", "samples", SKEYS, 6 * HOUR)) +
       "SELECT metric, service, replica, ts, value FROM i WHERE value > 40")
def compare_filter(spark, d):
    vector = rg.instant_at_step(fx.samples(spark, d), KEYS, START, END, HOUR, 6 * HOUR)
    return rg.compare_filter(vector, ">", 40)


SHOWN = [BY_NAME[n] for n in ("api_request_bytes", "api_mean_duration", "gpu_temp", "llm_kv")]


def _shown_sql() -> str:
    arms = []
    for v in SHOWN:
        labels = ", ".join(c if c in v.by else f"CAST(NULL AS VARCHAR) AS {c}" for c in ("exported_job", "device"))
        unit, factor = f"'{v.unit}'", "1000.0e0" if v.unit == "s" else "1.0e0"
        if v.unit == "MB/s":
            unit, factor = "['B/s', 'KB/s', 'MB/s', 'GB/s', 'TB/s'][i + 1]", "pow(1024.0e0, i)"
        arms.append(f"""SELECT '{v.name}' AS view, {labels}, ts, {unit} AS unit, round(value / {factor}, 3) AS shown FROM ({_view_sql(v)}),
          (SELECT CASE WHEN a >= 1 THEN least(CAST(floor(log10(a) / 3) AS INTEGER), 4) ELSE 0 END AS i
           FROM (SELECT sum(value) / count(DISTINCT ({', '.join(v.by)})) AS a FROM ({_view_sql(v)})))""")
    return " UNION ALL ".join(arms)


@query("displayed_views", _shown_sql())
def displayed_views(spark, d):
    """Views as charts show them, throughput in the unit that suits its size."""
    samples = all_view_samples(spark, d, *SHOWN)
    out = None
    for v in SHOWN:
        rows = displayed(v, _round(run_view(v, samples, START, END, STRETCH), "value"))
        rows = rows.select("view", *[F.col(c) if c in v.by else F.lit(None).cast("string").alias(c) for c in ("exported_job", "device")], "ts", "unit", "shown")
        out = rows if out is None else out.unionByName(rows)
    return out
