"""Samples that a stream has stored, and their compaction.

A micro-batch is a folder per day, so a repeated one replaces itself. Compaction merges the folders of a day into one
file set in time order under a version of its own; a manifest per version, written last, says which days are merged, in which
version and up to which batch. Only then are the merged folders removed. A compaction that is killed at any moment loses
nothing: without its manifest the folders count, with it the merged files do, whatever folders are left.

    <path>/day=<d>/batch=<n>/...              rows of a batch
    <path>-merged/data/version=<v>/day=<d>/...   merged rows, with their batch as a column
    <path>-merged/manifest/version=<v>/...    day, data_version, upto
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import catalog as cat

MANIFEST = "day bigint, data_version bigint, upto bigint"


def store_batch(batch: DataFrame, batch_id: int, path: str, wanted: Column | None = None) -> int | None:
    """Write a micro-batch of samples by day and batch; returns its newest time, None if it is empty.

    The newest time is observed during the write, not in a second pass. Only `wanted` samples are stored, by default all, but
    each counts for the newest time.
    """
    seen = Observation()
    rows = batch.withColumn("ts", F.unix_micros("ts")).withColumn("day", F.floor(F.col("ts") / cat.DAY)).withColumn(
        "batch", F.lit(batch_id).cast("long")
    ).observe(seen, F.max("ts").alias("newest"))
    stored = rows if wanted is None else rows.filter(wanted)
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    return seen.get["newest"]


def read_days(spark: SparkSession, path: str, schema: T.StructType, first: int, last: int) -> DataFrame:
    """Stored samples of the days first..last, with their batch; only these days are listed."""
    merged, upto = _manifest(spark, path)
    fields = [f if f.name != "ts" else T.StructField("ts", T.LongType()) for f in schema.fields]
    columns = [*[f.name for f in fields], "batch"]
    batch = T.StructField("batch", T.LongType())
    days = ",".join(map(str, range(first, last + 1)))
    rows = spark.createDataFrame([], T.StructType([*fields, batch]))
    if _matches(spark, f"{path}/day={{{days}}}"):
        stored = T.StructType([*fields, T.StructField("day", T.LongType()), batch])
        raw = spark.read.schema(stored).option("basePath", path).parquet(f"{path}/day={{{days}}}")
        rows = raw.filter(F.col("batch") > upto).select(*columns)
    folders = [f"{path}-merged/data/version={v}/day={d}" for d, v in sorted(merged.items()) if first <= d <= last]
    if folders:
        rows = rows.unionByName(spark.read.schema(T.StructType([*fields, batch])).parquet(*folders).select(*columns))
    return rows


def compact(spark: SparkSession, path: str, schema: T.StructType, upto: int) -> int:
    """Merge all batches up to `upto`, day by day; returns how many days changed. To be called between two batches."""
    merged, before = _manifest(spark, path)
    if upto <= before or not _matches(spark, f"{path}/day=*"):
        return 0
    new = spark.read.option("basePath", path).schema("day bigint, batch bigint").parquet(f"{path}/day=*")
    days = sorted(r[0] for r in new.filter((F.col("batch") > before) & (F.col("batch") <= upto)).select("day").distinct().collect())
    for day in days:
        rows = read_days(spark, path, schema, day, day).filter(F.col("batch") <= upto)
        # The newest version never reads what it writes, as its folder is new.
        rows.repartitionByRange("ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(f"{path}-merged/data/version={upto}/day={day}")
    entries = [(d, v, upto) for d, v in ({**merged, **dict.fromkeys(days, upto)}).items()]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}-merged/manifest/version={upto}")
    clean(spark, path)
    return len(days)


def clean(spark: SparkSession, path: str) -> None:
    """Remove what the newest manifest doesn't need: merged batches, and earlier versions of merged days."""
    merged, upto = _manifest(spark, path)
    for folder in _matches(spark, f"{path}/day=*/batch=*"):
        if int(folder.rsplit("batch=", 1)[1]) <= upto:
            _remove(spark, folder)
    for folder in _matches(spark, f"{path}/day=*"):
        if not _matches(spark, f"{folder}/batch=*"):
            _remove(spark, folder)
    for folder in _matches(spark, f"{path}-merged/data/version=*/day=*"):
        version, day = (int(part.split("=")[1]) for part in folder.rstrip("/").split("/")[-2:])
        if merged.get(day) != version and version <= upto:
            _remove(spark, folder)


def _manifest(spark: SparkSession, path: str) -> tuple[dict[int, int], int]:
    """Version of each merged day, and the batch up to which days are merged (-1 without any)."""
    finished = [f.rsplit("/", 1)[0] for f in _matches(spark, f"{path}-merged/manifest/version=*/_SUCCESS")]
    if not finished:
        return {}, -1
    newest = max(finished, key=lambda f: int(f.rsplit("version=", 1)[1]))
    rows = spark.read.schema(MANIFEST).parquet(newest).collect()
    return {r["day"]: r["data_version"] for r in rows}, max((r["upto"] for r in rows), default=-1)


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths of a pattern."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [str(f.getPath()) for f in found or []]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
