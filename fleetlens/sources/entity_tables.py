"""Entity tables whose merges rewrite only the buckets that they touch.

A table is dealt into buckets by a hash of its key. A merge reads the buckets of the changed keys and writes them
anew under the next version; a manifest per version says which version of each bucket counts, and is written last. Files of
earlier versions are never touched, so a merge that is killed, or meets another one, leaves the table as it was, and
readers see one version throughout.

    <path>/data/version=<v>/bucket=<b>/...    rows
    <path>/manifest/version=<v>/...           bucket, data_version, buckets, columns
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import entities

MANIFEST = "bucket int, data_version bigint, buckets int, columns string"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_table(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Version 0 of a table. `keys` must be given again to every merge."""
    _write_version(rows, path, keys, buckets, 0, {})


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the one named."""
    manifest = _manifest(spark, path, version)
    return _read_buckets(spark, path, manifest, manifest["versions"])


def merge_table(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Apply `merge(rows, changes)` to the buckets of the changed keys; returns the new version.

    The driver gets the numbers of these buckets, at most as many as the table has. Without changes nothing is written.
    """
    manifest = _manifest(spark, path)
    number = bucket_of(keys, manifest["buckets"])
    touched = {r[0] for r in changes.select(number).distinct().collect()}
    if not touched:
        return manifest["version"]
    old = {b: v for b, v in manifest["versions"].items() if b in touched}
    merged = merge(_read_buckets(spark, path, manifest, old), changes)
    kept = {b: v for b, v in manifest["versions"].items() if b not in touched}
    _write_version(merged, path, keys, manifest["buckets"], manifest["version"] + 1, kept)
    return manifest["version"] + 1


def upsert_table(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], order: str | None = None) -> int:
    return merge_table(spark, path, changes, keys, lambda rows, new: entities.upsert(rows, new, keys, order=order))


def soft_delete_table(spark: SparkSession, path: str, gone: DataFrame, keys: Sequence[str]) -> int:
    return merge_table(spark, path, gone, keys, lambda rows, new: entities.soft_delete(rows, new, keys))


def hard_delete_table(spark: SparkSession, path: str, gone: DataFrame, keys: Sequence[str]) -> int:
    return merge_table(spark, path, gone, keys, lambda rows, new: entities.hard_delete(rows, new, keys))


def _write_version(rows: DataFrame, path: str, keys: Sequence[str], buckets: int, version: int, kept: dict[int, int]) -> None:
    spark, target = rows.sparkSession, f"{path}/data/version={version}"
    # A bucket is written by one task. Left-overs of a killed merge of this version are replaced; a finished one has a manifest.
    dealt = rows.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(target)
    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])
    written = spark.read.schema(schema).parquet(target).select("bucket").distinct().collect()
    entries = [*kept.items(), *((r[0], version) for r in written)]
    columns = rows.schema.json()
    # A row without bucket keeps the manifest of an empty table.
    listed = spark.createDataFrame([(b, v, buckets, columns) for b, v in entries] or [(None, version, buckets, columns)], MANIFEST)
    listed.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version}")


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    rows = spark.read.schema(f"{MANIFEST}, version bigint").parquet(f"{path}/manifest")
    if version is None:
        (version,) = rows.agg(F.max("version")).first()
    listed = rows.filter(F.col("version") == F.lit(version).cast("long")).collect()
    if not listed:
        raise ValueError(f"no version {version} of the table at {path}")
    return {"version": version, "buckets": listed[0]["buckets"], "columns": listed[0]["columns"],
            "versions": {r["bucket"]: r["data_version"] for r in listed if r["bucket"] is not None}}


def _read_buckets(spark: SparkSession, path: str, manifest: dict, versions: dict[int, int]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(manifest["columns"]))
    if not versions:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*folders)
