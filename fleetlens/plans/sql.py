"""SQL twins of the fixture views and of the series operators, as common table expressions."""

from __future__ import annotations

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
RESET = 10 * HOUR
STEP0, STEP1 = 1704067200 * SECOND, 1706659200 * SECOND  # 2024-01-01 and 2024-01-31, the span of the events
SERIES = "metric, service, replica"

EV = """ev AS (
  SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props,
         CAST(round(value * 100) AS BIGINT) AS cents,
         'svc-' || CAST(user_id % 3 AS VARCHAR) AS service,
         'svc-' || CAST(user_id % 3 AS VARCHAR) || '-replica' || CAST((user_id % 6) // 3 AS VARCHAR) AS replica
  FROM events)"""

SAMPLES = EV + """, samples AS (
  SELECT event_type AS metric, service, replica, ts, arg_max(value, event_id) AS value
  FROM ev GROUP BY ALL)"""

COUNTERS = EV + f""", steps AS (
  SELECT event_type AS metric, service, replica, ts, sum(cents) AS c FROM ev GROUP BY ALL
), counters AS (
  SELECT metric, service, replica, ts,
         CAST(sum(c) OVER (PARTITION BY metric, service, replica, ts // {RESET} ORDER BY ts) AS BIGINT) / 100.0e0 AS value
  FROM steps)"""

DAYS = EV + f""", days AS (
  SELECT service, replica, ts - ts % {DAY} AS ts,
         CAST(count(DISTINCT user_id) AS DOUBLE) AS active, CAST(count(*) AS DOUBLE) AS running,
         CAST(sum(cents) AS BIGINT) / 100.0e0 AS pending, CAST(count(*) AS DOUBLE) AS server_new,
         CAST(count(*) FILTER (event_type <> 'error') AS DOUBLE) AS server_success,
         CAST(sum(cents) AS BIGINT) / (count(*) * 100.0e0) AS kv_cache
  FROM ev GROUP BY ALL)"""

BUNDLE = DAYS + """, bundle AS (
  SELECT service, replica, ts, 'active' AS metric, active AS value FROM days
  UNION ALL SELECT service, replica, ts, 'running', running FROM days
  UNION ALL SELECT service, replica, ts, 'pending', pending FROM days
  UNION ALL SELECT service, replica, ts, 'server_new', server_new FROM days
  UNION ALL SELECT service, replica, ts, 'server_success', server_success FROM days
  UNION ALL SELECT service, replica, ts, 'kv_cache', kv_cache FROM days)"""

TASKS = """tasks AS (
  SELECT service, CAST(substr(service, 5) AS INTEGER) AS k,
         ['mistral', 'llama', 'unknown'][CAST(substr(service, 5) AS INTEGER) + 1] AS framework, 7.0e0 AS param,
         24 AS gpu_spec, 8 AS gpu_num, CAST(64 << (2 - CAST(substr(service, 5) AS INTEGER)) AS INTEGER) AS max_num_seqs,
         1 AS tensor_parallel_size, 0.9e0 AS gpu_memory_utilization,
         CAST(count(DISTINCT replica) AS INTEGER) AS replicas, count(*) AS n_events
  FROM ev GROUP BY service)"""


def intervals(src: str, keys: str = "service, replica, metric", share: float = 0.8) -> str:
    """CTE `stats`: points, last_ts and freq per series of `src`."""
    return f"""gaps AS (
  SELECT {keys}, ts, ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts) AS gap FROM {src}
), gap_counts AS (
  SELECT {keys}, gap, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY ALL
), tops AS (
  SELECT {keys}, max(n) AS top, sum(n) AS total, arg_max(gap, {{'n': n, 'g': -gap}}) AS gap FROM gap_counts GROUP BY {keys}
), sizes AS (
  SELECT {keys}, count(*) AS points, max(ts) AS last_ts FROM {src} GROUP BY {keys}
), stats AS (
  SELECT s.*, CASE WHEN points >= 5 AND CAST(top AS DOUBLE) / total > {share}e0 THEN gap END AS freq
  FROM sizes s LEFT JOIN tops USING ({keys}))"""


def regular(src: str, unit: int = DAY, n: int = 30) -> str:
    """CTEs `stats` and `reg` (series with an interval on their grid)."""
    return intervals(src) + f""", reg AS (
  SELECT g.service, g.replica, g.metric, g.ts, g.freq, coalesce(s.value, 0.0e0) AS value
  FROM (SELECT service, replica, metric, freq,
               unnest(range(last_ts - {n - 1} * {unit}, last_ts + 1, freq)) AS ts
        FROM stats WHERE freq IS NOT NULL) g
  LEFT JOIN {src} s ON s.service = g.service AND s.replica = g.replica AND s.metric = g.metric AND s.ts = g.ts)"""


SUMMED = """members AS (
  SELECT service, metric, count(DISTINCT replica) AS n_valid, min(replica) AS first_replica FROM reg GROUP BY ALL
), summed AS (
  SELECT r.service, r.metric, r.ts, any_value(n_valid) AS n_valid,
         CASE WHEN count(value) = any_value(n_valid) THEN sum(value) END AS value
  FROM reg r JOIN members m ON r.service = m.service AND r.metric = m.metric
  GROUP BY r.service, r.metric, r.ts
  HAVING min(r.replica) = any_value(first_replica))"""


def resampled(width: int) -> str:
    return f"""bins AS (
  SELECT service, metric, ts - ts % {width} AS ts, sum(value) AS total, avg(value) AS mean, any_value(n_valid) AS n_valid
  FROM summed GROUP BY ALL
), spans_ AS (
  SELECT service, metric, unnest(range(min(ts), max(ts) + 1, {width})) AS ts, max(n_valid) AS n_valid
  FROM bins GROUP BY service, metric
), resampled AS (
  SELECT s.service, s.metric, s.ts, coalesce(b.total, 0.0e0) AS total, b.mean, s.n_valid
  FROM spans_ s LEFT JOIN bins b ON s.service = b.service AND s.metric = b.metric AND s.ts = b.ts)"""


def tails(m: int, pending: float, kv: float) -> str:
    """CTE `rules`: one row per service with the rule inputs."""
    return f"""pts AS (
  SELECT service, metric, ts, n_valid, CASE WHEN metric = 'pending' THEN total ELSE mean / n_valid END AS value
  FROM resampled WHERE metric IN ('pending', 'kv_cache', 'running')
  UNION ALL
  SELECT service, metric, ts, n_valid, value FROM summed WHERE metric IN ('server_new', 'server_success')
), tail AS (
  SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY service, metric ORDER BY ts DESC) <= {m}
), pct AS (
  SELECT service, metric, max(n_valid) AS n_valid,
         CASE WHEN count(value) = count(*) THEN quantile_cont(value, 0.9) END AS p90,
         bool_and(coalesce(value >= {pending}e0, false)) AS high,
         bool_and(coalesce(value <= {kv}e0, false)) AS low,
         max(value) AS peak, count(*) - count(value) AS missing
  FROM tail GROUP BY service, metric
), rules AS (
  SELECT service,
    coalesce(max(n_valid) FILTER (metric = 'pending'), 0) AS n_pending,
    coalesce(max(n_valid) FILTER (metric = 'kv_cache'), 0) AS n_kv,
    coalesce(max(n_valid) FILTER (metric = 'running'), 0) AS n_running,
    coalesce(max(n_valid) FILTER (metric = 'server_new'), 0) AS n_new,
    coalesce(max(n_valid) FILTER (metric = 'server_success'), 0) AS n_success,
    coalesce(bool_and(high) FILTER (metric = 'pending'), false) AS pending_high,
    coalesce(bool_and(low) FILTER (metric = 'kv_cache'), false) AS kv_low,
    max(peak) FILTER (metric = 'running') AS running_peak,
    coalesce(max(missing) FILTER (metric = 'running'), 0) AS running_missing,
    max(p90) FILTER (metric = 'running') AS p90_running, max(p90) FILTER (metric = 'kv_cache') AS p90_kv,
    max(p90) FILTER (metric = 'server_new') AS p90_new, max(p90) FILTER (metric = 'server_success') AS p90_success
  FROM pct GROUP BY service)"""


CATALOG = """catalog AS (
  SELECT * FROM (VALUES
    ('baichuan', 7.0e0, 7505707008, 262144, 32, 4096), ('baichuan', 13.0e0, 13896253440, 409600, 40, 8192),
    ('chatglm', 6.0e0, 6243221504, 86016, 32, 8192), ('gemma', 2.0e0, 2506096640, 9216, 8, 8192),
    ('gemma', 7.0e0, 8537505792, 262144, 16, 8192), ('llama', 7.0e0, 6607077376, 262144, 32, 4096),
    ('llama', 13.0e0, 12851609600, 409600, 40, 4096), ('mistral', 7.0e0, 7110393856, 65536, 32, 32768),
    ('qwen', 7.0e0, 7720665088, 262144, 32, 8192), ('qwen', 14.0e0, 14166261760, 409600, 40, 8192)
  ) t(framework, param, ps, ts_, nh, sl)
), defaults AS (
  SELECT * FROM (VALUES (7.0e0, 262144, 8192), (13.0e0, 409600, 8192), (70.0e0, 1310720, 8192)) t(pk, dts, dsl))"""


def matched(src: str) -> str:
    """CTE `matched`: `src` with the catalogue columns."""
    return CATALOG + f""", matched AS (
  SELECT s.*, coalesce(CAST(c.ps AS DOUBLE), s.param * 1073741824e0) AS param_size,
         CAST(coalesce(c.ts_, d.dts) AS BIGINT) AS token_size, coalesce(c.nh, 8) AS n_head, CAST(coalesce(c.sl, d.dsl) AS BIGINT) AS seq_length,
         c.ps IS NOT NULL AS in_catalog
  FROM {src} s LEFT JOIN catalog c ON c.framework = s.framework AND c.param = s.param
  LEFT JOIN defaults d ON d.pk = CASE WHEN abs(7 - s.param) <= abs(13 - s.param) AND abs(7 - s.param) <= abs(70 - s.param) THEN 7
                                      WHEN abs(13 - s.param) <= abs(70 - s.param) THEN 13 ELSE 70 END)"""


def nearest_batch(param_size: str) -> str:
    return (
        f"list_sort(list_transform([8, 16, 32, 64, 128, 256, 512, 1024], lambda b: "
        f"{{'d': abs(b - 1924145348608e0 / {param_size}), 'b': b}}))[1].b"
    )


def first_tp(mem: str) -> str:
    return (
        f"list_min(list_filter(range(1, n_head + 1), lambda d: n_head % d = 0 AND d <= gpu_num "
        f"AND d * (gpu_spec * 0.9e0) * 1073741824e0 * 0.9e0 > {mem}))"
    )


def first_util(mem: str, tp: str) -> str:
    return (
        f"list_min(list_filter([0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0], "
        f"lambda u: u * {tp} * (gpu_spec * 0.9e0) * 1073741824e0 > {mem}))"
    )


def ticks(step: int, start: int = STEP0, end: int = STEP1) -> str:
    return f"ticks AS (SELECT unnest(range({start}, {end} + 1, {step})) AS t)"


def rate_cte(name: str, src: str, keys: str, window: int, per_second: bool = True) -> str:
    """CTE with extrapolated rate (or increase) per series and tick, by a range join."""
    divide = f" / {window / SECOND!r}e0" if per_second else ""
    return f"""{name}_w AS (
  SELECT {keys}, k.t, s.ts, s.value, lag(s.value) OVER (PARTITION BY {keys}, k.t ORDER BY s.ts) AS prev
  FROM {src} s JOIN ticks k ON s.ts > k.t - {window} AND s.ts <= k.t
), {name}_f AS (
  SELECT {keys}, t, count(*) AS n, min(ts) AS t0, max(ts) AS t1, arg_min(value, ts) AS v0, arg_max(value, ts) AS v1,
         coalesce(sum(prev) FILTER (value < prev), 0) AS resets
  FROM {name}_w GROUP BY ALL HAVING count(*) >= 2
), {name}_s AS (
  SELECT *, v1 - v0 + resets AS inc, CAST(t1 - t0 AS DOUBLE) AS si, (t1 - t0) / CAST(n - 1 AS DOUBLE) AS av,
         CAST(t0 - (t - {window}) AS DOUBLE) AS ds0, CAST(t - t1 AS DOUBLE) AS de0 FROM {name}_f
), {name}_d AS (
  SELECT *, CASE WHEN ds0 >= av * 1.1e0 THEN av / 2 ELSE ds0 END AS ds1,
         CASE WHEN de0 >= av * 1.1e0 THEN av / 2 ELSE de0 END AS de FROM {name}_s
), {name} AS (
  SELECT {keys}, t AS ts,
         inc * (si + CASE WHEN inc > 0 AND v0 >= 0 THEN least(ds1, si * v0 / inc) ELSE ds1 END + de) / si{divide} AS value
  FROM {name}_d)"""


def instant_cte(name: str, src: str, keys: str, lookback: int) -> str:
    return f"""{name} AS (
  SELECT {keys}, k.t AS ts, arg_max(s.value, s.ts) AS value
  FROM {src} s JOIN ticks k ON s.ts > k.t - {lookback} AND s.ts <= k.t GROUP BY {keys}, k.t)"""


def mean_cte(name: str, src: str, keys: str, window: int) -> str:
    return f"""{name} AS (
  SELECT {keys}, k.t AS ts, avg(s.value) AS value
  FROM {src} s JOIN ticks k ON s.ts > k.t - {window} AND s.ts <= k.t GROUP BY {keys}, k.t)"""


HISTORY = """history AS (
  SELECT 'task-' || CAST(o_custkey // 3 AS VARCHAR) AS task, epoch_us(o_orderdate) // 1000 AS timestamp, o_orderkey AS seq,
         o_orderstatus = 'F' AS is_anomaly,
         CAST(8 << ((o_orderkey + 1) % 7) AS INTEGER) AS r_seqs, CAST(1 << ((o_orderkey + 1) % 3) AS INTEGER) AS r_tp,
         ((o_orderkey + 1) % 6 + 4) / 10.0e0 AS r_util, CAST((o_orderkey + 1) % 5 + 1 AS INTEGER) AS r_rep,
         CAST(8 << (o_orderkey % 7) AS INTEGER) AS c_seqs, CAST(1 << (o_orderkey % 3) AS INTEGER) AS c_tp,
         (o_orderkey % 6 + 4) / 10.0e0 AS c_util, CAST(o_orderkey % 5 + 1 AS INTEGER) AS c_rep
  FROM orders)"""

TESTS = """tests AS (
  SELECT o_orderkey AS test_id, o_custkey AS instance_id, o_orderpriority AS data_set,
         CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS test_status,
         CAST(1704067200 + (o_orderkey % 720) * 3600 + o_orderkey % 61 AS BIGINT) AS created,
         o_orderkey % 4 + 1 AS duration, ['hour', 'min', 'sec'][o_orderkey % 3 + 1] AS duration_unit,
         'svc-' || CAST(o_orderkey % 3 AS VARCHAR) || '-replica0' AS exported_job, o_totalprice AS cost
  FROM orders)"""

INSTANCES = """instances AS (
  SELECT c_custkey AS instance_id, c_name AS instance_name,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'running' WHEN 'BUILDING' THEN 'pending' WHEN 'FURNITURE' THEN 'failed'
              WHEN 'HOUSEHOLD' THEN 'finished' ELSE 'unknown' END AS deploy_status,
         CAST(1704067200 + c_custkey * 60 AS BIGINT) AS create_time,
         CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS is_deleted, c_acctbal AS balance
  FROM customer), statuses AS (
  SELECT * FROM (VALUES ('running', 'Running'), ('pending', 'Pending'), ('failed', 'Failed'), ('finished', 'Finished'))
    t(status, status_text))"""

REQUESTS = """pairs AS (SELECT DISTINCT l_partkey AS model_id, l_suppkey AS gpu_id FROM lineitem), requests AS (
  SELECT model_id, gpu_id,
         ['baichuan', 'chatglm', 'gemma', 'llama', 'mistral', 'qwen', 'unknown'][model_id % 7 + 1] AS framework,
         [2.0e0, 6.0e0, 7.0e0, 13.0e0, 14.0e0, 70.0e0, 10.0e0][(model_id // 7) % 7 + 1] AS param,
         [16, 24, 40, 80][gpu_id % 4 + 1] AS gpu_spec, CAST((gpu_id // 4) % 8 + 1 AS INTEGER) AS gpu_num
  FROM pairs)"""

SPANS = """spans AS (
  SELECT CAST(event_id // 2 AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS span_id,
         CASE WHEN event_id % 2 = 1 THEN CAST(event_id - 1 AS VARCHAR) END AS parent_id, service,
         CASE WHEN event_type = 'view' THEN 'LlamaForCausalLM.forward' ELSE 'POST /' || event_type END AS name, CASE WHEN event_id % 2 = 1 THEN 'server' ELSE 'client' END AS kind,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, ts AS start, value AS duration_ms, cents,
         CASE WHEN user_id % 4 <> 0 THEN json_extract_string(props, '$.k') END AS batch_size
  FROM ev)"""


def duration_counts() -> str:
    """Cumulative histogram columns of spans."""
    from fleetlens.operators.spans import DURATION_BOUNDS

    return ", ".join(f"count(*) FILTER (duration_ms <= {b}) AS le_{b}" for b in DURATION_BOUNDS)


def with_ctes(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
