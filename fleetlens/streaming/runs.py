"""Driving streams: change-log tables, and the detection loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from fleetlens import catalog as cat
from fleetlens.operators.chunks import latest
from fleetlens.operators.history import decode_history, encode_history
from fleetlens.plans.detection import current_tasks, detection_pass
from fleetlens.plans.views import View, run_dashboard
from fleetlens.streaming import stores


def changelog_writer(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", interval: str | None = None) -> DataStreamWriter:
    """Write every micro-batch to its own folder of a change-log table.

    A repeated batch overwrites its folder, so results stay exact when a driver or executor is lost.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def read_changelog(spark: SparkSession, path: str, keys: Sequence[str], schema: str | None = None) -> DataFrame:
    """Newest version of each key of a change-log table."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return latest.select(*keys, "_r.*")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> str:
    """Process everything available, then stop; returns the table path."""
    changelog_writer(stream, path, checkpoint, mode).start().awaitTermination()
    return path


def _recent(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], since: int, newest: int) -> DataFrame:
    """Stored samples of `(since, newest]`, the last ingested per series and timestamp; only these days are listed."""
    rows = stores.read_days(spark, path, schema, since // cat.DAY, newest // cat.DAY)
    rows = rows.filter((F.col("ts") > since) & (F.col("ts") <= newest))
    return latest(rows, keys, F.struct("batch", "value"))


def _compact_at(spark: SparkSession, path: str, schema: T.StructType, batch_id: int, every: int) -> None:
    # The batch itself may be repeated, so it is left out.
    if batch_id and batch_id % every == 0:
        stores.compact(spark, path, schema, batch_id - 1)


def detection_stream(
    stream: DataFrame,
    tasks: DataFrame | Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    lookback: int = 3 * cat.HOUR,
    interval: str | None = None,
    status: Callable[[], DataFrame] | None = None,
    compact_every: int = 100,
    **rules,
) -> DataStreamWriter:
    """Detection loop over a sample stream (service, replica, metric, ts TIMESTAMP, value).

    Each micro-batch is stored first, so late rows are never lost; then the trailing `lookback` of
    all services are judged, recommendations go to the history table and the task table moves on. All three
    tables under `path` hold one partition per batch, so a repeated batch replaces its own output, and a
    tick lists only the days it looks back on and the task table of the tick before it. `tasks`, a table or
    a function asked at every tick, says which services there are: those deployed later are judged from then on, removed
    ones no longer; what was recommended before is laid over it. `status`, asked at every tick too, gives the
    current task states and limits the tick to running tasks under automatic scaling. A tick is judged at the newest
    time seen so far, so a batch of late rows neither turns the clock back nor judges an old window again. Every
    `compact_every` batches the stored samples are merged, so a day holds at most so many folders.
    """
    spark = stream.sparkSession
    samples_path, history_path, tasks_path, clock_path = f"{path}/samples", f"{path}/history", f"{path}/tasks", f"{path}/clock"
    keys = ["service", "replica", "metric"]
    stream = stream.select(*keys, "ts", "value")

    def step(batch: DataFrame, batch_id: int) -> None:
        newest = stores.store_batch(batch, batch_id, samples_path)
        current, seen = tasks() if callable(tasks) else tasks, None
        if batch_id > 0:
            before = spark.read.schema(current.schema).parquet(f"{tasks_path}/batch={batch_id - 1}")
            current = _overlaid(current, before)
            (seen,) = spark.read.schema("seen bigint").parquet(f"{clock_path}/batch={batch_id - 1}").first()
        late = newest is not None and seen is not None and newest <= seen
        seen = max([t for t in (newest, seen) if t is not None], default=None)
        spark.createDataFrame([(seen,)], "seen bigint").write.mode("overwrite").parquet(f"{clock_path}/batch={batch_id}")
        records = None
        if newest is not None and not late:
            recent = _recent(spark, samples_path, stream.schema, keys, newest - lookback, newest)
            records = detection_pass(recent, current, F.lit(newest // 1000), status=status() if status else None, **rules)
        target = f"{history_path}/batch={batch_id}"
        if records is None:
            spark.createDataFrame([], RECORD_SCHEMA).write.mode("overwrite").parquet(target)
        else:
            encode_history(records).write.mode("overwrite").parquet(target)
        kept = decode_history(spark.read.schema(RECORD_SCHEMA).parquet(target).drop("timestamp"))
        current_tasks(current, kept).write.mode("overwrite").parquet(f"{tasks_path}/batch={batch_id}")
        _compact_at(spark, samples_path, stream.schema, batch_id, compact_every)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


CONFIG_FIELDS = ["max_num_seqs", "tensor_parallel_size", "gpu_memory_utilization", "replicas"]


def _overlaid(tasks: DataFrame, before: DataFrame) -> DataFrame:
    """The tasks there are now, with the configuration that the tick before left them."""
    kept = before.select("service", *[F.col(f).alias(f"_{f}") for f in CONFIG_FIELDS], F.lit(True).alias("_kept"))
    joined = tasks.join(kept, "service", "left")
    changed = {f: F.when(F.col("_kept"), F.col(f"_{f}")).otherwise(F.col(f)).cast(tasks.schema[f].dataType) for f in CONFIG_FIELDS}
    return joined.select(*[changed[c].alias(c) if c in changed else c for c in tasks.columns])


def view_stream(
    stream: DataFrame,
    views: Sequence[View],
    path: str,
    checkpoint: str,
    first_tick: int,
    stretch: int = 1,
    lateness: int = cat.LOOKBACK,
    interval: str | None = None,
    compact_every: int = 100,
) -> DataStreamWriter:
    """Keep metric views up to date over a sample stream (metric, label columns, ts TIMESTAMP, value).

    Every tick is evaluated once, when samples `lateness` newer have arrived, from the stored
    samples its windows reach back to. Extrapolated rates need this; sums and means over fixed windows can
    also run as plain streaming aggregations. All views must share one step. Samples of metrics that no view
    reads move the clock, but are not stored.
    """
    spark = stream.sparkSession
    samples_path, values_path, ticks_path = f"{path}/samples", f"{path}/values", f"{path}/ticks"
    tick = views[0].step * stretch * cat.SECOND
    assert all(v.step == views[0].step for v in views)
    reach = max([cat.LOOKBACK, *[v.window * cat.SECOND for v in views]]) * stretch
    keys = [c for c in stream.columns if c not in ("ts", "value")]
    read = F.col("metric").isin(*{m: None for v in views for m in v.metrics})

    def step(batch: DataFrame, batch_id: int) -> None:
        newest = stores.store_batch(batch, batch_id, samples_path, read)
        done, seen = first_tick - tick, None
        if batch_id > 0:
            done, seen = spark.read.schema(TICK_SCHEMA).parquet(f"{ticks_path}/batch={batch_id - 1}").first()
        known = [t for t in (newest, seen) if t is not None]
        seen = max(known) if known else None
        upto = done if seen is None else max(done, first_tick + (seen - lateness - first_tick) // tick * tick)
        if upto > done:
            recent = _recent(spark, samples_path, stream.schema, keys, done + tick - reach, upto)
            values = run_dashboard(views, recent, done + tick, upto, stretch)
            values.write.mode("overwrite").parquet(f"{values_path}/batch={batch_id}")
        spark.createDataFrame([(upto, seen)], TICK_SCHEMA).write.mode("overwrite").parquet(f"{ticks_path}/batch={batch_id}")
        _compact_at(spark, samples_path, stream.schema, batch_id, compact_every)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


TICK_SCHEMA = "done bigint, seen bigint"
RECORD_SCHEMA = "task string, timestamp bigint, record string"


def detection_history(spark: SparkSession, path: str) -> DataFrame:
    """Records written by ``detection_stream``."""
    raw = spark.read.schema(f"{RECORD_SCHEMA}, batch bigint").parquet(f"{path}/history")
    return decode_history(raw.drop("timestamp"))
