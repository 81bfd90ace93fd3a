"""Hosts, models and metric dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expressions import format_size, parameter_count, parse_size, throughput_unit_index, RATE_UNITS


def normalise_inventory(hosts: DataFrame, size_column: str = "size_text", binary: bool = True) -> DataFrame:
    """Add the size in bytes and as normal text; unreadable sizes give NULL."""
    return hosts.withColumn("size_bytes", parse_size(F.col(size_column), binary)).withColumn(
        "size_normal", F.when(F.col("size_bytes").isNotNull(), format_size(F.col("size_bytes"), binary))
    )


def dominant_gpu(cards: DataFrame) -> DataFrame:
    """Most frequent card model per host; ties go to the first name, then the smaller memory."""
    counted = cards.groupBy("host", "product", "memory").agg(F.count("*").alias("card_amount"))
    best = F.struct((-F.col("card_amount")).alias("_c"), "product", "memory")
    return counted.groupBy("host").agg(F.min(best).alias("_b")).select(
        "host", F.col("_b.product").alias("product"), F.col("_b.memory").alias("memory"),
        (-F.col("_b._c")).alias("card_amount"),
    )


def params_from_shapes(weights: DataFrame) -> DataFrame:
    """Parameter count per model from its weight shapes."""
    elements = F.aggregate("shape", F.lit(1).cast("long"), lambda acc, d: acc * d.cast("long"))
    return weights.groupBy("model").agg(F.sum(elements).alias("params"))


def estimate_params(configs: DataFrame) -> DataFrame:
    """Parameter count and billions (half to even) from model configurations."""
    c = F.col
    params = parameter_count(c("model_type"), c("vocab_size"), c("hidden_size"), c("num_hidden_layers"), c("num_layers"))
    return configs.withColumn("params_size", params).withColumn(
        "param", F.bround(F.col("params_size") / 1e9, 0).cast("long")
    )


def enabled_fields(dictionary: DataFrame) -> DataFrame:
    """Dictionary fields that are collected: everything but labels."""
    return dictionary.filter(F.col("type") != "label")


def enabled_fields_only(samples: DataFrame, dictionary: DataFrame) -> DataFrame:
    fields = enabled_fields(dictionary).select(F.col("field").alias("metric")).distinct()
    return samples.join(fields, "metric", "left_semi")


def dictionary_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Enabled fields present in one dictionary only, with the side they are on. One aggregation."""
    sided = (
        enabled_fields(left).select("field", "type", F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(enabled_fields(right).select("field", "type", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    )
    return (
        sided.groupBy("field", "type").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
        .filter("_l + _r = 1")
        .select("field", "type", F.when(F.col("_l") == 1, "left").otherwise("right").alias("side"))
    )


def adaptive_unit(series: DataFrame, chart: list[str], keys: list[str]) -> DataFrame:
    """Display unit per chart: the sum of all values over the number of series picks the step."""
    per_series = series.groupBy(*chart, *keys).agg(F.sum(F.nanvl("value", F.lit(0.0))).alias("_s"))
    step = throughput_unit_index(F.col("average"))
    units = F.array(*[F.lit(u) for u in RATE_UNITS])
    return per_series.groupBy(*chart).agg((F.sum("_s") / F.count("*")).alias("average")).select(
        *chart, "average", F.element_at(units, step + 1).alias("unit"), F.pow(F.lit(1024.0), step).alias("factor")
    )
