"""List queries over the instance and test tables: filters, joins, paging, upserts."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)

PAGING_ARGS = {"page", "size", "order_by", "order_type"}
MAX_PAGE, MAX_SIZE = 1000, 200


def where_equal(df: DataFrame, column: str, value, ignore_case: bool = False) -> DataFrame:
    if ignore_case:
        return df.filter(F.lower(column) == str(value).lower())
    return df.filter(F.col(column) == value)


def where_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(*values))


def where_time_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Both ends inclusive; an end that is None is open."""
    out = df if start is None else df.filter(F.col(column) >= start)
    return out if end is None else out.filter(F.col(column) <= end)


def where_fuzzy(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Case-insensitive substring in any of the columns; `%` and `_` act as wildcards."""
    return df.filter(reduce(or_, [F.col(c).ilike(f"%{text}%") for c in columns]))


def apply_filters(
    df: DataFrame,
    args: Mapping,
    start_column: str = "start_time",
    end_column: str = "end_time",
    fuzzy_columns: Sequence[str] = (),
    ignore_case: Sequence[str] = (),
) -> DataFrame:
    """Apply list arguments; None values and unknown columns are skipped, the latter with a warning."""
    out = df
    for key, value in args.items():
        if key in PAGING_ARGS or value is None:
            continue
        if key == "start_time":
            out = where_time_range(out, start_column, start=value)
        elif key == "end_time":
            out = where_time_range(out, end_column, end=value)
        elif key == "fuzzy" and fuzzy_columns:
            out = where_fuzzy(out, fuzzy_columns, value)
        elif key not in df.columns:
            LOG.warning("ignoring unknown filter column %s", key)
        elif isinstance(value, (list, set, tuple)):
            out = where_in(out, key, list(value))
        else:
            out = where_equal(out, key, value, key in ignore_case)
    return out


def ordered(df: DataFrame, key: Sequence[str], order_by: str | None = None, order_type: str | None = None) -> list[Column]:
    """Sort columns: the requested one if both parts are given, then the key to make pages stable."""
    first = []
    if order_by and order_type:
        if order_by not in df.columns or order_type not in ("asc", "desc"):
            raise ValueError(f"cannot order by {order_by} {order_type}")
        first = [F.col(order_by).desc() if order_type == "desc" else F.col(order_by).asc()]
    return first + [F.col(k).asc() for k in key]


def paginate(
    df: DataFrame,
    key: Sequence[str],
    page: int = 1,
    size: int = 10,
    order_by: str | None = None,
    order_type: str | None = None,
) -> DataFrame:
    """One page; Spark plans it as a bounded top-k, not a full sort."""
    if not (1 <= page <= MAX_PAGE and 1 <= size <= MAX_SIZE):
        raise ValueError(f"page must be 1..{MAX_PAGE} and size 1..{MAX_SIZE}")
    return df.orderBy(*ordered(df, key, order_by, order_type)).offset(size * (page - 1)).limit(size)


def page_summary(df: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """One row with the page envelope's counts, from a single count over the filtered set."""
    before = size * (page - 1)
    return df.agg(F.count("*").alias("total_num")).select(
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        "total_num",
        F.ceil(F.col("total_num") / size).cast("long").alias("total_page"),
        F.greatest(F.least(F.col("total_num") - before, F.lit(size)), F.lit(0)).cast("long").alias("num"),
    )


def list_rows(df: DataFrame, args: Mapping, key: Sequence[str], **filters) -> tuple[DataFrame, DataFrame]:
    """Filtered page and its summary row."""
    page, size = args.get("page", 1), args.get("size", 10)
    found = apply_filters(df, args, **filters)
    rows = paginate(found, key, page, size, args.get("order_by"), args.get("order_type"))
    return rows, page_summary(found, page, size)


def list_with_join(
    base: DataFrame, related: Sequence[tuple[str, DataFrame, str, str]]
) -> DataFrame:
    """Left join related tables, each nested as a struct named after it; NULL where nothing matches.

    `related` holds (name, table, base column, related column). The size of each side decides the join
    at run time; a hot base key is split by adaptive execution because the related side can be repeated.
    """
    out = base
    for name, table, base_column, related_column in related:
        nested = table.select(
            F.col(related_column).alias(f"_{name}_key"), F.struct(*[F.col(c) for c in table.columns]).alias(name)
        )
        out = out.join(nested, F.col(base_column) == F.col(f"_{name}_key"), "left").drop(f"_{name}_key")
    return out


def newest_instances(instances: DataFrame) -> DataFrame:
    """Live instances, newest first."""
    return instances.filter("is_deleted = 0").orderBy(F.col("create_time").desc(), F.col("instance_id").asc())


def search_instances(instances: DataFrame, statuses: DataFrame, text: str) -> DataFrame:
    """Substring of the name or of the status display text, ignoring case; empty text keeps everything."""
    shown = instances.join(statuses.withColumnRenamed("status", "deploy_status"), "deploy_status", "left")
    if not text:
        return shown
    wanted = F.lit(text.lower())
    in_name = F.contains(F.lower("instance_name"), wanted)
    in_status = F.coalesce(F.contains(F.lower("status_text"), wanted), F.lit(False))
    return shown.filter(in_name | in_status)


def distinct_statuses(rows: DataFrame, statuses: DataFrame, column: str = "deploy_status") -> DataFrame:
    """Distinct status values with their display text, the value itself where there is none."""
    return (
        rows.select(F.col(column).alias("status")).distinct()
        .join(statuses, "status", "left")
        .select("status", F.coalesce("status_text", "status").alias("status_text"))
    )


def label_instances(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """Instance name by id, the id itself where the instance is unknown."""
    names = instances.select("instance_id", "instance_name")
    return rows.join(names, "instance_id", "left").withColumn(
        "instance_name", F.coalesce("instance_name", F.col("instance_id").cast("string"))
    )


def mask_unfinished(tests: DataFrame, columns: Sequence[str], status: str = "test_status") -> DataFrame:
    """Result columns are shown for successful tests only."""
    return tests.withColumns({c: F.when(F.col(status) == "success", F.col(c)) for c in columns})


def active_count(rows: DataFrame, column: str, blocking: Sequence[str], live_only: bool = False) -> DataFrame:
    """One row: how many rows block a new start, and whether one may start."""
    cond = F.col(column).isin(*blocking)
    if live_only:
        cond = cond & (F.col("is_deleted") == 0)
    return rows.agg(F.count_if(cond).alias("active")).withColumn("may_start", F.col("active") == 0)


def exists_check(wanted: DataFrame, table: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Wanted keys that exist, and those that do not."""
    return wanted.join(table, list(key), "left_semi"), wanted.join(table, list(key), "left_anti")


def upsert(
    target: DataFrame, changes: DataFrame, key: Sequence[str], insert: bool = True, order: str | None = None
) -> DataFrame:
    """Merge by key: a non-NULL changed field replaces the old one, NULL leaves it; new keys are added.

    `changes` holds one row per key, or several numbered by `order`: then the last non-NULL value of each
    field counts, found by a partial aggregation before the join.
    """
    if order is not None:
        changed = [c for c in changes.columns if c not in (*key, order)]
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in changed]
        changes = changes.groupBy(*key).agg(*last)
    old, new = target.alias("old"), changes.alias("new")
    fields = [c for c in target.columns if c not in key]
    merged = old.join(new, list(key), "full" if insert else "left")
    picked = [
        F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) if c in changes.columns else F.col(f"old.{c}").alias(c)
        for c in fields
    ]
    return merged.select(*key, *picked)


def soft_delete(target: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mark the rows whose key is listed."""
    marked = keys.select(*key).distinct().withColumn("_gone", F.lit(1))
    return (
        target.join(marked, list(key), "left")
        .withColumn("is_deleted", F.when(F.col("_gone") == 1, F.lit(1)).otherwise(F.col("is_deleted")))
        .drop("_gone")
    )


def hard_delete(target: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*key), list(key), "left_anti")


def project_engine_args(tasks: DataFrame) -> DataFrame:
    """Start-up arguments shown for an instance; the model length stands in for a missing sequence length.

    `max_num_batched_tokens` belongs to the task, not to its engine arguments; tasks without that column have none.
    """
    args = F.col("engine_args")
    # The arguments that are shown.
    names = ["dtype", "load_format", "max_num_seqs", "max_paddings", "model", "tokenizer",
             "pipeline_parallel_size", "tensor_parallel_size", "quantization"]
    length = F.when(F.coalesce(args["max_seq_len"], F.lit("0")).isin("0", ""), args["max_model_len"]).otherwise(
        args["max_seq_len"]
    )
    return tasks.select(
        "task",
        F.col("exporter_service_name").alias("exported_job"),
        *[args[n].alias(n) for n in names],
        length.alias("max_seq_len"),
        (F.col("max_num_batched_tokens") if "max_num_batched_tokens" in tasks.columns else F.lit(None)).cast("string").alias("max_num_batched_tokens"),
        "engine_args",
    )
