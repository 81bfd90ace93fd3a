"""Fixed values that results depend on, stated as plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIB = 1024**3

# Timestamps and durations of samples are whole microseconds.
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Known models as (framework, param in billions, param_size, token_size, n_head, seq_length).
MODEL_CATALOG = [
    ("baichuan", 7.0, 7505707008, 262144, 32, 4096),
    ("baichuan", 13.0, 13896253440, 409600, 40, 8192),
    ("chatglm", 6.0, 6243221504, 86016, 32, 8192),
    ("gemma", 2.0, 2506096640, 9216, 8, 8192),
    ("gemma", 7.0, 8537505792, 262144, 16, 8192),
    ("llama", 7.0, 6607077376, 262144, 32, 4096),
    ("llama", 13.0, 12851609600, 409600, 40, 4096),
    ("mistral", 7.0, 7110393856, 65536, 32, 32768),
    ("qwen", 7.0, 7720665088, 262144, 32, 8192),
    ("qwen", 14.0, 14166261760, 409600, 40, 8192),
]

# Fallback by model size as (param in billions, token_size, seq_length).
DEFAULT_MODELS = [
    (7.0, 262144, 8192),
    (13.0, 409600, 8192),
    (70.0, 1310720, 8192),
]
DEFAULT_N_HEAD = 8

# Recommendation ladders and limits.
BATCH_LADDER = [8, 16, 32, 64, 128, 256, 512, 1024]
UTILISATION_LADDER = [0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
BATCH_BASELINE = 256 * 7 * GIB
SAFE_GPU_SHARE = 0.9
DTYPE_SIZE = 2
ACTIVATION_GIB = 3
ACTIVATION_GIB_LARGE = 5
LARGE_ACTIVATION_FRAMEWORK = "mistral"

# Detection rules.
DETECT_POINTS = 3
PENDING_THRESHOLD = 50.0
KV_CACHE_THRESHOLD = 10.0
RUNNING_THRESHOLD = 0.1

# Series regularisation.
GRID_MINUTES = 30
INTERVAL_SHARE = 0.8
MIN_POINTS = 5
LOOKBACK = 300 * SECOND
STALE = 15 * SECOND

# The six metrics of one serving replica.
REPLICA_METRICS = ["active", "running", "pending", "server_new", "server_success", "kv_cache"]

# Byte magnitudes as (decimal symbol, decimal name, binary symbol, binary name),
# in rising powers of 1000 and 1024.
SIZE_UNITS = [
    ("K", "kilo", "Ki", "kibi"),
    ("M", "mega", "Mi", "mebi"),
    ("G", "giga", "Gi", "gibi"),
    ("T", "tera", "Ti", "tebi"),
    ("P", "peta", "Pi", "pebi"),
    ("E", "exa", "Ei", "exbi"),
    ("Z", "zetta", "Zi", "zebi"),
    ("Y", "yotta", "Yi", "yobi"),
    ("B", "bronto", "Bi", "brobi"),
]

# Seconds per duration unit.
DURATION_UNITS = {"sec": 1, "min": 60, "hour": 3600, "day": 86400, "week": 604800}

# Comparison offsets offered for charts, in minutes.
COMPARE_MINUTES = {"hour": 60, "day": 1440, "week": 10080, "month": 43200}

# Request paths whose bodies carry generation parameters.
GENERATION_PATHS = ["/generate", "/v1/completions", "/v1/chat/completions"]
REQUEST_PATH_BY_MODE = {"normal": "/generate", "openai": "/v1/completions"}

# Records kept per task (newest first); a limit of 10 keeps 11.
HISTORY_LIMIT = 10

# Messages passed on as chat context.
CONTEXT_MESSAGES = 5

# Statuses that block a new deployment, or a new load test.
BLOCKING_DEPLOY_STATUSES = ["running", "pending", "failed", "unknown"]
BLOCKING_TEST_STATUSES = ["init", "running", "unknown"]

# Labels of the engine start-up info metric.
ENGINE_INIT_LABELS = [
    "model", "tokenizer", "tokenizer_mode", "revision", "tokenizer_revision", "trust_remote_code",
    "dtype", "max_seq_len", "download_dir", "load_format", "tensor_parallel_size",
    "disable_custom_all_reduce", "quantization", "enforce_eager", "kv_cache_dtype", "seed",
    "max_num_batched_tokens", "max_num_seqs", "max_paddings", "pipeline_parallel_size",
    "worker_use_ray", "max_parallel_loading_workers",
]

# Gauges of one engine log line, in the order of the pattern's groups, named as the exporter
# names them (with their units), which is what the views read.
ENGINE_LOG_METRICS = [
    "avg_prompt_throughput_tokens_per_second", "avg_generation_throughput_tokens_per_second", "running_requests", "swapped_requests",
    "pending_requests", "gpu_kv_cache_usage_percent", "cpu_kv_cache_usage_percent",
]
# Fixed value: the text of an engine's log line.
ENGINE_LOG_PATTERN = (
    r"Avg prompt throughput: (\d+\.\d+) tokens/s, "
    r"Avg generation throughput: (\d+\.\d+) tokens/s, "
    r"Running: (\d+) reqs, "
    r"Swapped: (\d+) reqs, "
    r"Pending: (\d+) reqs, "
    r"GPU KV cache usage: (\d+\.\d+)%, "
    r"CPU KV cache usage: (\d+\.\d+)%"
)


def literal_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A few fixed rows as a local relation, so that the optimizer knows their size."""
    cells = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    typed = [f"CAST({name} AS {kind}) AS {name}" for name, kind in columns.items()]
    return spark.sql(f"SELECT {', '.join(typed)} FROM VALUES {cells} AS t({', '.join(columns)})")


def model_catalog(spark: SparkSession) -> DataFrame:
    """Ten fixed rows; safe to broadcast."""
    return literal_table(spark, MODEL_CATALOG, {
        "framework": "string", "param": "double", "param_size": "bigint", "token_size": "bigint", "n_head": "int",
        "seq_length": "bigint",
    })
