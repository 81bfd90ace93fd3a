"""Live tables that late rows correct instead of being dropped: windowed sums, counters, the service graph.

Micro-batches write parts that can be added up, each to a folder of its own, so a repeated batch replaces itself and
a row counts however late it comes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from fleetlens import catalog as cat
from fleetlens.operators.spans import DURATION_BOUNDS


def _writer(stream: DataFrame, checkpoint: str, step, interval: str | None) -> DataStreamWriter:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def _with_fields(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(k, t) for k, t in kinds.items()]])


def window_stream(
    stream: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], path: str, checkpoint: str, width: int = cat.MINUTE,
    slide: int | None = None, interval: str | None = None,
) -> DataStreamWriter:
    """Sums per key and tumbling (or, with `slide`, sliding) window over a stream with a TIMESTAMP `ts`.

    `sums` names columns that are added up. A batch writes its own sums per window, by day, and then, to the change log, the
    new totals of the windows that it touched: of these days only, all parts are read. So a batch that comes hours late changes
    exactly its windows. There is no watermark and no state to hold.
    """
    spark, slide = stream.sparkSession, slide or width
    parts_path, changes_path = f"{path}/parts", f"{path}/changes"

    def step(batch: DataFrame, batch_id: int) -> None:
        ts = F.unix_micros("ts")
        # The first window that still holds the row, then every `slide` up to the one that starts last.
        last = (ts - F.pmod(ts, F.lit(slide))).cast("long")
        first = last - (-(-width // slide) - 1) * slide
        rows = batch.select(*keys, ts.alias("_at"), F.explode(F.sequence(first, last, F.lit(slide).cast("long"))).alias("w_start"), *[c.alias(k) for k, c in sums.items()])
        parts = rows.filter(F.col("w_start") + width > F.col("_at")).groupBy(*keys, "w_start").agg(*[F.sum(k).alias(k) for k in sums])
        dated = parts.withColumn("day", F.floor(F.col("w_start") / cat.DAY)).withColumn("batch", F.lit(batch_id).cast("long"))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(parts_path)
        schema = _with_fields(parts.schema, day=T.LongType(), batch=T.LongType())
        stored = spark.read.schema(schema).parquet(parts_path).filter(F.col("batch") <= batch_id)
        own = stored.filter(F.col("batch") == batch_id)
        days = [r["day"] for r in own.select("day").distinct().collect()]
        touched = own.select(*keys, "w_start")
        same = [stored[k].eqNullSafe(touched[k]) for k in (*keys, "w_start")]
        totals = stored.filter(F.col("day").isin(days)).join(touched, same, "left_semi").groupBy(*keys, "w_start").agg(*[F.sum(k).alias(k) for k in sums])
        totals.withColumn("w_end", F.col("w_start") + width).write.mode("overwrite").parquet(f"{changes_path}/batch={batch_id}")

    return _writer(stream, checkpoint, step, interval)


def counter_stream(
    stream: DataFrame, labels: Sequence[str], sums: Mapping[str, Column], path: str, checkpoint: str, expiry: int | None = None,
    interval: str | None = None,
) -> DataStreamWriter:
    """Cumulative counters per label set over a stream with a TIMESTAMP `ts`.

    A batch adds its sums to the totals of the batch before it. The totals lie in two folders that take turns, each
    with the number of its batch: the one is read while the other is written, so a repeated batch starts from the same totals, and
    storage doesn't grow. Each touched label set also gives a sample at its newest time (`samples`, a folder per batch); neither the
    value nor the time of a counter falls. A label set that `expiry` passes without an event (by the newest time seen) is
    dropped from the totals and starts again from zero.
    """
    spark = stream.sparkSession
    names = list(sums)

    def step(batch: DataFrame, batch_id: int) -> None:
        added = batch.groupBy(*labels).agg(*[F.sum(c).alias(k) for k, c in sums.items()], F.unix_micros(F.max("ts")).alias("ts"))
        moved = added.withColumn("_new", F.lit(True))
        if batch_id > 0:
            before = _totals(spark, f"{path}/totals", _with_fields(added.schema, batch=T.LongType()), batch_id - 1)
            moved = moved.unionByName(before.withColumn("_new", F.lit(False)))
        merged = moved.groupBy(*labels).agg(*[F.sum(k).alias(k) for k in names], F.max("ts").alias("ts"), F.bool_or("_new").alias("_new"))
        target = f"{path}/totals/slot={batch_id % 2}"
        merged.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{target}/all")
        stored = spark.read.parquet(f"{target}/all")
        stored.filter("_new").select(*labels, "ts", *names).write.mode("overwrite").parquet(f"{path}/samples/batch={batch_id}")
        live = stored
        if expiry is not None:
            (newest,) = stored.agg(F.max("ts")).first()
            live = stored.filter(F.col("ts") + expiry > F.lit(newest).cast("long"))
        live.drop("_new").write.mode("overwrite").parquet(f"{target}/live")

    return _writer(stream, checkpoint, step, interval)


def _totals(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """Totals after a batch."""
    rows = spark.read.schema(schema).parquet(f"{path}/slot={batch_id % 2}/live")
    return rows.filter(F.col("batch") == batch_id).drop("batch")


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the newest batch: of the two folders the one with the higher number. To be read while no batch runs;
    `samples` can be read at any time."""
    rows = spark.read.option("basePath", f"{path}/totals").parquet(f"{path}/totals/slot=*/live").drop("slot")
    (newest,) = rows.agg(F.max("batch")).first()
    return rows.filter(F.col("batch") == F.lit(newest).cast("long")).drop("batch")


def graph_stream(
    spans: DataFrame, path: str, checkpoint: str, reach: str = "5 minutes", bounds: Sequence[float] = tuple(DURATION_BOUNDS), interval: str | None = None,
) -> DataStreamWriter:
    """The service graph over a stream of spans with a TIMESTAMP `ts`: client spans meet the server spans below them.

    Both sides wait for each other as long as their times lie within `reach`. Edges are written as sums per batch, client and
    server (`edges`); spans whose partner didn't come go to a side table (`unmatched`).
    """
    client = spans.filter("kind = 'client'").select(
        F.col("trace_id").alias("c_trace"), F.col("span_id").alias("c_span"), F.col("service").alias("client"), F.col("ts").alias("c_ts")).withWatermark("c_ts", reach)
    server = spans.filter("kind = 'server' AND parent_id IS NOT NULL").select(
        F.col("trace_id").alias("s_trace"), F.col("parent_id").alias("s_parent"), F.col("span_id").alias("s_span"), F.col("service").alias("server"),
        "status", "duration_ms", F.col("ts").alias("s_ts")).withWatermark("s_ts", reach)
    met = client.join(server, F.expr(
        f"c_trace = s_trace AND c_span = s_parent AND s_ts >= c_ts - INTERVAL {reach} AND s_ts <= c_ts + INTERVAL {reach}"), "full_outer")

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = f"{path}/met/slot={batch_id % 2}"
        batch.write.mode("overwrite").parquet(rows)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(rows)
        edges = stored.filter("c_span IS NOT NULL AND s_span IS NOT NULL").groupBy("client", "server").agg(
            F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("failed"), F.sum("duration_ms").alias("duration_ms_sum"),
            *[F.count_if(F.col("duration_ms") <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds])
        edges.write.mode("overwrite").parquet(f"{path}/edges/batch={batch_id}")
        alone = stored.filter("c_span IS NULL OR s_span IS NULL").select(
            F.coalesce("c_trace", "s_trace").alias("trace_id"), F.coalesce("c_span", "s_span").alias("span_id"),
            F.when(F.col("c_span").isNotNull(), "client").otherwise("server").alias("kind"), F.coalesce("client", "server").alias("service"),
            F.unix_micros(F.coalesce("c_ts", "s_ts")).alias("ts"))
        alone.write.mode("overwrite").parquet(f"{path}/unmatched/batch={batch_id}")

    return _writer(met, checkpoint, step, interval)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of the service graph so far: calls, failures, mean server time and histogram per client and server."""
    rows = spark.read.parquet(f"{path}/edges")
    sums = [c for c in rows.columns if c not in ("client", "server", "batch")]
    totals = rows.groupBy("client", "server").agg(*[F.sum(c).alias(c) for c in sums])
    return totals.withColumn("mean_ms", F.col("duration_ms_sum") / F.col("calls"))
