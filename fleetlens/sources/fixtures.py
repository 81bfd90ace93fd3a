"""Telemetry-shaped views over the driver's tables.

Each view is a projection or aggregation of whole tables, so its size grows with them. The SQL twin of
every view is in ``fleetlens.plans.sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.catalog import literal_table
from fleetlens.operators.chunks import latest

DAY = cat.DAY
SERIES = ["metric", "service", "replica"]
# Counters of the fixture start again every ten hours.
RESET = 10 * cat.HOUR

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch(ts: str) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    service = F.concat(F.lit("svc-"), (user % 3).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        epoch("ts").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        service.alias("service"),
        F.concat(service, F.lit("-replica"), F.floor((user % 6) / 3).cast("string")).alias("replica"),
        "props",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge samples: metric = event type, one value per series and timestamp."""
    raw = events(spark, sf_dir).withColumnRenamed("event_type", "metric")
    return latest(raw, SERIES, "event_id")


def _life_order(keys: list[str]) -> Window:
    # A partition holds what a series reports in a life of ten hours.
    return Window.partitionBy(*keys, "_life").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples: running sum of the values per series, starting again every ten hours."""
    raw = events(spark, sf_dir).withColumnRenamed("event_type", "metric")
    steps = raw.groupBy(*SERIES, "ts").agg(F.sum("cents").alias("_cents"))
    spans = steps.withColumn("_life", F.floor(F.col("ts") / RESET))
    return spans.select(*SERIES, "ts", (F.sum("_cents").over(_life_order(SERIES)) / 100.0).alias("value"))


def replica_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six metrics per replica and day, wide."""
    day = F.col("ts") - F.col("ts") % DAY
    rows = events(spark, sf_dir).select("service", "replica", day.alias("ts"), "user_id", "event_type", "cents")
    # Distinct users come from a first aggregation per user, so no group is ever held as a set.
    per_user = rows.groupBy("service", "replica", "ts", "user_id").agg(
        F.sum("cents").alias("_c"), F.count("*").alias("_n"), F.count_if(F.col("event_type") != "error").alias("_ok")
    )
    return per_user.groupBy("service", "replica", "ts").agg(
        F.count("*").cast("double").alias("active"),
        F.sum("_n").cast("double").alias("running"),
        (F.sum("_c") / 100.0).alias("pending"),
        F.sum("_n").cast("double").alias("server_new"),
        F.sum("_ok").cast("double").alias("server_success"),
        (F.sum("_c") / (F.sum("_n") * 100.0)).alias("kv_cache"),
    )


def replica_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics as long samples."""
    names = ["active", "running", "pending", "server_new", "server_success", "kv_cache"]
    return replica_days(spark, sf_dir).unpivot(["service", "replica", "ts"], names, "metric", "value")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One serving task per service of the events table."""
    k = F.substring("service", 5, 10).cast("int")
    seen = events(spark, sf_dir).groupBy("service", "replica").agg(F.count("*").alias("_n"))
    per_service = seen.groupBy("service").agg(F.count("*").cast("int").alias("replicas"), F.sum("_n").alias("n_events"))
    frameworks = F.array(F.lit("mistral"), F.lit("llama"), F.lit("unknown"))
    return per_service.select(
        "service",
        F.element_at(frameworks, k + 1).alias("framework"),
        F.lit(7.0).alias("param"),
        F.lit(24).alias("gpu_spec"),
        F.lit(8).alias("gpu_num"),
        (F.lit(64) * F.pow(F.lit(2), 2 - k)).cast("int").alias("max_num_seqs"),
        F.lit(1).alias("tensor_parallel_size"),
        F.lit(0.9).alias("gpu_memory_utilization"),
        "replicas",
        F.when(k == 1, "manual").otherwise("auto").alias("strategy"),
        "n_events",
    )


def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("test_id"),
        (F.col("l_returnflag") != "R").alias("success"),
        F.col("l_extendedprice").alias("elapsed"),
    )


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load tests out of orders, created in January 2024 as the events are."""
    key = F.col("o_orderkey")
    created = F.lit(1704067200) + (key % 720) * 3600 + (key % 61)
    status = (
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("test_id"),
        F.col("o_custkey").alias("instance_id"),
        F.col("o_orderpriority").alias("data_set"),
        status.alias("test_status"),
        created.cast("long").alias("created"),
        (key % 4 + 1).alias("duration"),
        F.element_at(F.array(F.lit("hour"), F.lit("min"), F.lit("sec")), (key % 3 + 1).cast("int")).alias("duration_unit"),
        F.concat(F.lit("svc-"), (key % 3).cast("string"), F.lit("-replica0")).alias("exported_job"),
        F.col("o_totalprice").alias("cost"),
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = F.create_map(*[F.lit(x) for kv in SEGMENT_STATUS.items() for x in kv])
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("instance_id"),
        F.col("c_name").alias("instance_name"),
        F.coalesce(statuses[F.col("c_mktsegment")], F.lit("unknown")).alias("deploy_status"),
        (F.lit(1704067200) + F.col("c_custkey") * 60).cast("long").alias("create_time"),
        F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0).alias("is_deleted"),
        F.col("c_acctbal").alias("balance"),
    )


# Fixture status by market segment, and the display text of each status.
SEGMENT_STATUS = {
    "AUTOMOBILE": "running", "BUILDING": "pending", "FURNITURE": "failed", "HOUSEHOLD": "finished", "MACHINERY": "unknown",
}
STATUS_TEXT = [("running", "Running"), ("pending", "Pending"), ("failed", "Failed"), ("finished", "Finished")]


def statuses(spark: SparkSession) -> DataFrame:
    return literal_table(spark, STATUS_TEXT, {"status": "string", "status_text": "string"})


# Frameworks and sizes dealt out to fixture models.
FRAMEWORKS = ["baichuan", "chatglm", "gemma", "llama", "mistral", "qwen", "unknown"]
PARAMS = [2.0, 6.0, 7.0, 13.0, 14.0, 70.0, 10.0]
GPU_GB = [16, 24, 40, 80]


def deploy_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (part, supplier) pairs as model-on-GPU deployment requests.

    Nearly all pairs are distinct, so they are shuffled at once, to the session's number of partitions: adaptive execution
    would merge these until a task of a join holds millions of pairs.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("model_id"), F.col("l_suppkey").alias("gpu_id")
    ).repartition(parts, "model_id", "gpu_id").distinct()
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    return pairs.select(
        "model_id",
        "gpu_id",
        pick(FRAMEWORKS, F.col("model_id") % 7).alias("framework"),
        pick(PARAMS, F.floor(F.col("model_id") / 7) % 7).alias("param"),
        pick(GPU_GB, F.col("gpu_id") % 4).alias("gpu_spec"),
        (F.floor(F.col("gpu_id") / 4) % 8 + 1).cast("int").alias("gpu_num"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation records out of orders; several tasks hold more than the kept number."""
    key = F.col("o_orderkey")
    config = lambda shift: F.struct(
        (F.lit(8) * F.pow(F.lit(2), (key + shift) % 7)).cast("int").alias("max_num_seqs"),
        F.pow(F.lit(2), (key + shift) % 3).cast("int").alias("tensor_parallel_size"),
        (((key + shift) % 6 + 4) / 10.0).alias("gpu_memory_utilization"),
        ((key + shift) % 5 + 1).cast("int").alias("replicas"),
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("task-"), F.floor(F.col("o_custkey") / 3).cast("string")).alias("task"),
        (epoch("o_orderdate") / 1000).cast("long").alias("timestamp"),
        key.alias("seq"),
        (F.col("o_orderstatus") == "F").alias("is_anomaly"),
        config(1).alias("recommended"),
        config(0).alias("current"),
    )


def span_name(event_type: Column) -> Column:
    """Views are forward calls of a model, other events requests."""
    return F.when(event_type == "view", "LlamaForCausalLM.forward").otherwise(F.concat(F.lit("POST /"), event_type))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans out of events: even events are client spans, odd ones serve the client span before them."""
    e = events(spark, sf_dir)
    event = F.col("event_id")
    odd = event % 2 == 1
    return e.select(
        F.floor(event / 2).cast("string").alias("trace_id"),
        event.cast("string").alias("span_id"),
        F.when(odd, (event - 1).cast("string")).alias("parent_id"),
        "service",
        span_name(F.col("event_type")).alias("name"),
        F.when(odd, "server").otherwise("client").alias("kind"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("ts").alias("start"),
        F.col("value").alias("duration_ms"),
        F.create_map(
            F.lit("batch_size"),
            F.when(F.col("user_id") % 4 != 0, F.get_json_object("props", "$.k")),
        ).alias("attrs"),
    )


def task_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicas out of suppliers: task = nation, list position = supplier key."""
    k = F.col("s_suppkey")
    state = F.when(k % 5 <= 2, "running").when(k % 5 == 3, "exited").otherwise("created")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("task-"), F.col("s_nationkey").cast("string")).alias("task"),
        k.alias("idx"),
        F.concat(F.lit("c-"), k.cast("string")).alias("container"),
        state.alias("state"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP requests out of documents: the body is JSON for most, and unreadable for the rest."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    body = F.when(doc % 11 == 0, F.lit("not json")).otherwise(
        F.to_json(F.struct(F.col("text").alias("prompt"), F.col("source").alias("model"), F.col("lang").alias("lang")))
    )
    paths = F.array(F.lit("/generate"), F.lit("/v1/completions"), F.lit("/health"))
    return d.select(
        doc.alias("request_id"),
        F.element_at(paths, (doc % 3 + 1).cast("int")).alias("path"),
        F.when(doc % 5 == 0, "GET").otherwise("POST").alias("method"),
        body.alias("body"),
    )


def view_samples(spark: SparkSession, sf_dir: str, metrics: list[str], counter: set[str], only: set[str] | None = None) -> DataFrame:
    """Samples of all view metrics in one table: every event gives one to each metric, as gauge or counter.

    The k-th metric has the event's value plus k. Labels are promoted to columns; a series is one
    (metric, exported_job, device, http_status_code). `only` names the metrics that the reader will use, all of them by
    default: every event is read either way, but gives no samples that nobody looks at.
    """
    keys = ["metric", "exported_job", "device", "http_status_code"]
    chosen = {m: k for k, m in enumerate(metrics) if only is None or m in only}
    counter = counter & chosen.keys()
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k")) for m, k in chosen.items()]))
    e = events(spark, sf_dir).withColumn("_m", named)
    e = e.withColumns({"value": F.col("value") + F.col("_m.k"), "cents": F.col("cents") + 100 * F.col("_m.k")})
    labelled = e.select(
        F.col("_m.metric").alias("metric"),
        F.col("replica").alias("exported_job"),
        F.concat(F.lit("gpu"), (F.floor(F.col("user_id") / 6) % 2).cast("string")).alias("device"),
        F.when(F.col("user_id") % 5 == 0, "500").otherwise("200").alias("http_status_code"),
        "ts", "event_id", "value", "cents",
    )
    is_counter = F.col("metric").isin(*counter) if counter else F.lit(False)
    parts = []
    if chosen.keys() - counter:
        parts.append(latest(labelled.filter(~is_counter), keys, "event_id").select(*keys, "ts", "value"))
    if counter:
        steps = labelled.filter(is_counter).groupBy(*keys, "ts").agg(F.sum("cents").alias("_cents"))
        lives = steps.withColumn("_life", F.floor(F.col("ts") / RESET))
        parts.append(lives.select(*keys, "ts", (F.sum("_cents").over(_life_order(keys)) / 100.0).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("service", F.col("exported_job")).withColumn("span_name", F.lit("POST /generate"))
