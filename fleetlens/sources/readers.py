"""Readers: every input becomes a DataFrame with a declared schema."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import catalog as cat
from fleetlens import schemas
from fleetlens.operators.spans import parse_engine_log

__all__ = [
    "parse_dictionary", "parse_engine_log", "parse_range_response", "read_entity_table", "read_load_report",
    "read_metric_dictionary", "read_prompt_dataset", "read_spans", "read_telemetry_stream", "unwrap_envelope",
]


def parse_range_response(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Samples out of range-query responses; unsuccessful responses and unreadable points are skipped.

    Times in a response are seconds with a fraction; `ts` is in microseconds, as all operators take it.
    """
    parsed = df.select(*keep, F.from_json(column, schemas.RANGE_RESPONSE).alias("r")).filter("r.status = 'success'")
    points = parsed.select(*keep, F.explode("r.data.result").alias("s")).select(
        *keep, F.col("s.metric").alias("labels"), F.explode("s.values").alias("p")
    )
    return points.select(
        *keep,
        "labels",
        F.get("p", F.lit(0)).try_cast("double").alias("_at"),
        F.get("p", F.lit(1)).try_cast("double").alias("value"),
    ).filter("_at IS NOT NULL AND value IS NOT NULL").select(
        *keep, "labels", F.round(F.col("_at") * cat.SECOND).cast("long").alias("ts"), "value"
    )


def parse_dictionary(lines: DataFrame, column: str = "value") -> DataFrame:
    """Metric dictionary lines `field, type, help` (the help text may hold commas); comments are dropped."""
    text = F.trim(column)
    parts = F.split(text, ",", 3)
    return lines.filter((text != "") & ~text.startswith("#") & (F.size(parts) >= 2)).select(
        *[F.trim(F.get(parts, F.lit(i))).alias(name) for i, name in enumerate(("field", "type", "help"))]
    )


def read_metric_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return parse_dictionary(spark.read.text(path))


def read_load_report(spark: SparkSession, path: str) -> DataFrame:
    """Load-generator result logs; the test id is the name of the folder that holds the log's folder.

    Logs lie at `<test_id>/report/<file>`. Columns are found by the names in each file's header, in any order; a quoted message may
    span lines.
    """
    rows = _by_header(spark, path, schemas.LOAD_REPORT)
    test_id = F.regexp_extract("_file", r"([^/]+)/(?:folder=)?report/[^/]+$", 1)
    return rows.select(test_id.alias("test_id"), "success", "elapsed")


def _by_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The named columns of CSV files, and `_file`; unreadable cells and columns that a file lacks are NULL.

    Every file is read by its own header, whatever the order of its columns. A first pass over the lines finds each file's
    first line, and whether a quoted cell goes on in the next line: only such files are read by one task each, all
    others are split. The driver gets the names of the files, as it does when it lists them.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    )
    found = _first_lines(lines).collect()
    firsts = spark.createDataFrame(found, "file string, id bigint, open boolean")
    # The texts are those of a second pass: an aggregation that carries texts would sort all lines. A byte order mark is no part of the first name.
    header = F.regexp_replace("value", "^\ufeff", "")
    headers = lines.filter("start = 0").join(F.broadcast(firsts), ["id", "file"]).select("file", "open", header.alias("header"))
    groups = headers.groupBy("header", "open").agg(F.collect_list("file").alias("files")).collect()
    if sum(len(g["files"]) for g in groups) != len(found):
        raise ValueError(f"files changed while they were read: {path}")
    # File paths come as URIs, in which a plus sign is itself.
    decoded = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    fields = T.StructType.fromDDL(schema).fields
    out = spark.createDataFrame([], T.StructType([*fields, T.StructField("_file", T.StringType())]))
    for group in sorted(groups, key=lambda g: (g["header"], g["open"])):
        names = [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(f)) for f in sorted(group["files"])]
        rows = spark.read.csv(names, header=True, enforceSchema=False, quote='"', escape='"', multiLine=group["open"])
        cell = lambda f, have=rows.columns: F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast("string")
        out = out.unionByName(rows.select(*[cell(f).try_cast(f.dataType).alias(f.name) for f in fields], decoded.alias("_file")))
    return out


def _first_lines(lines: DataFrame) -> DataFrame:
    """Per file the id of its first line and whether a line of it has an open quote. Numbers only, so that lines are
    hashed by their file and never sorted."""
    text = F.col("value")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return lines.groupBy("file").agg(F.min(F.when(F.col("start") == 0, F.col("id"))).alias("id"), F.bool_or(quotes % 2 == 1).alias("open"))


def read_prompt_dataset(spark: SparkSession, path: str, schema: str = "question string") -> DataFrame:
    """Prompt CSV: the header names the variables. Quoted cells may span lines; files without such cells are split
    between tasks."""
    return _by_header(spark, path, schema).drop("_file")


def attributes_map(attributes: str | Column) -> Column:
    """Trace attributes (key and typed value) as a string map."""
    return F.map_from_entries(
        F.transform(
            attributes,
            lambda a: F.struct(a["key"].alias("key"), F.element_at(F.map_values(a["value"]), 1).alias("value")),
        )
    )


# Span kinds by number.
SPAN_KINDS = {1: "internal", 2: "server", 3: "client", 4: "producer", 5: "consumer"}


def read_spans(df: DataFrame, column: str) -> DataFrame:
    """Flat spans out of nested trace export JSON; `start` is in microseconds."""
    traces = df.select(F.from_json(column, schemas.OTLP_TRACES).alias("t"))
    resources = traces.select(F.explode("t.resourceSpans").alias("r")).select(
        attributes_map("r.resource.attributes")["service.name"].alias("service"), F.explode("r.scopeSpans").alias("sc")
    )
    spans = resources.select("service", F.explode("sc.spans").alias("s"))
    kinds = F.create_map(*[F.lit(x) for kv in SPAN_KINDS.items() for x in kv])
    start, end = F.col("s.startTimeUnixNano").try_cast("long"), F.col("s.endTimeUnixNano").try_cast("long")
    return spans.select(
        F.col("s.traceId").alias("trace_id"),
        F.col("s.spanId").alias("span_id"),
        F.nullif(F.col("s.parentSpanId"), F.lit("")).alias("parent_id"),
        "service",
        F.col("s.name").alias("name"),
        F.coalesce(kinds[F.col("s.kind")], F.lit("unspecified")).alias("kind"),
        F.when(F.col("s.status.code") == 2, "error").otherwise("ok").alias("status"),
        F.call_function("div", start, F.lit(1000)).alias("start"),
        ((end - start) / 1e6).alias("duration_ms"),
        attributes_map("s.attributes").alias("attrs"),
    )


def split_records(raw: DataFrame, column: str, schema: str, time_column: str = "ts") -> tuple[DataFrame, DataFrame]:
    """JSON records that can be read and have a time, and the texts of the others, for a side table."""
    text = F.col(column).cast("string")
    parsed = raw.select(text.alias("raw"), F.from_json(text, schema).alias("r"))
    good = F.coalesce(F.col("r").isNotNull() & F.col(f"r.{time_column}").isNotNull(), F.lit(False))
    return parsed.filter(good).select("r.*"), parsed.filter(~good).select("raw")


def read_telemetry_stream(
    spark: SparkSession,
    schema: str,
    path: str | None = None,
    brokers: str | None = None,
    topic: str | None = None,
    options: Mapping[str, str] | None = None,
    time_column: str = "ts",
) -> DataFrame:
    """Telemetry as a stream: a Kafka topic of JSON records, or a folder of parquet files.

    The time column becomes a TIMESTAMP, as watermarks need. Unreadable records of a topic are left out;
    ``split_records`` over the same topic gives them.
    """
    if brokers:
        raw = (
            spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
            .options(**(options or {})).load()
        )
        rows, _ = split_records(raw, "value", schema, time_column)
    else:
        rows = spark.readStream.schema(schema).options(**(options or {})).parquet(path)
    return rows.withColumn(time_column, F.col(time_column).cast("timestamp"))


def read_entity_table(rows: DataFrame, json_columns: Mapping[str, str]) -> DataFrame:
    """Decode the JSON text columns of a table; bad JSON reads as NULL."""
    decoded = {}
    for name, ddl in json_columns.items():
        if name in rows.columns:
            parsed = F.from_json(F.col(name), ddl)
            decoded[name] = F.when(F.get_json_object(name, "$").isNotNull(), parsed)
    return rows.withColumns(decoded)


def unwrap_envelope(df: DataFrame, column: str, result_schema: str, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Results of API envelopes with code 0, and the rejected rows."""
    opened = df.select(*keep, F.from_json(column, schemas.ENVELOPE).alias("e"), F.col(column).alias("raw"))
    accepted = F.coalesce(F.col("e.code") == 0, F.lit(False))
    good = opened.filter(accepted).select(*keep, F.from_json("e.result", result_schema).alias("result"))
    bad = opened.filter(~accepted).select(*keep, "raw", F.col("e.code").alias("code"), F.col("e.message").alias("message"))
    return good.select(*keep, "result.*"), bad
