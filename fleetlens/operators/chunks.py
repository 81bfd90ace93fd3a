"""Time chunking, so that one hot series never becomes one task.

A window over a whole series puts that series into a single task. A (series, time chunk) partition holds what a
series reports in five minutes, however many rows it has in total; a million samples an hour make 83,000 rows of a
chunk. Neighbouring rows that a chunk needs from outside are brought in either as a halo (bounded reach) or as one carried
row per chunk (unbounded reach). Timestamps and widths are in the same unit, microseconds by default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import catalog as cat

CHUNK = 5 * cat.MINUTE


def chunk_of(ts: str | Column, width: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(ts / F.lit(width)).cast("long")


def latest(samples: DataFrame, keys: Sequence[str], order: str | Column, ts: str = "ts") -> DataFrame:
    """Keep the last ingested value where a series holds several for one and the same timestamp."""
    return samples.groupBy(*keys, ts).agg(F.max_by("value", order).alias("value"))


def with_halo(df: DataFrame, width: int, back: int = 0, ahead: int = 0, ts: str = "ts") -> DataFrame:
    """Copy each row to the chunks that look up to `back` / `ahead` over their edge.

    Adds ``_chunk`` and ``_own`` (true on the one copy that belongs to the chunk).
    """
    copies = F.sequence(chunk_of(F.col(ts) - ahead, width), chunk_of(F.col(ts) + back, width))
    return (
        df.withColumn("_chunk", F.explode(copies))
        .withColumn("_own", F.col("_chunk") == chunk_of(ts, width))
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], ts: str = "ts", width: int | None = CHUNK
) -> DataFrame:
    """Add ``prev_<col>`` from the previous row of the series, however far back it lies.

    Inside a chunk it is an ordinary lag; the first row of a chunk takes the last row of the nearest
    earlier chunk, found over one summary row per chunk. `width=None` is for series that are bounded
    already, such as range-query results or daily rollups: one plain window.
    """
    state = F.struct(*[F.col(c).alias(c) for c in cols])
    if width is None:
        plain = df.withColumn("_prev", F.lag(state).over(Window.partitionBy(*keys).orderBy(ts)))
        return plain.withColumns({f"prev_{c}": F.col("_prev")[c] for c in cols}).drop("_prev")
    chunked = df.withColumn("_chunk", chunk_of(ts, width))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    edges = (
        chunked.groupBy(*keys, "_chunk").agg(F.max_by(state, ts).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")))
        .drop("_last")
    )
    joined = chunked.withColumn("_prev", F.lag(state).over(inside)).join(edges, [*keys, "_chunk"], "left")
    prev = F.coalesce("_prev", "_carry")
    return joined.withColumns({f"prev_{c}": prev[c] for c in cols}).drop("_chunk", "_prev", "_carry")


def running_total(
    df: DataFrame, keys: Sequence[str], amount: str, order: str, width: int = CHUNK
) -> DataFrame:
    """Add ``running``: inclusive running sum of `amount` per key in `order`, in bounded partitions."""
    chunked = df.withColumn("_chunk", chunk_of(order, width))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk").agg(F.sum(amount).alias("_part"))
        .withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0)))
        .drop("_part")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumn("_inside", F.sum(amount).over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn("running", F.col("_inside") + F.col("_before"))
        .drop("_chunk", "_inside", "_before")
    )


def running_totals(df: DataFrame, keys: Sequence[str], amounts: Sequence[str], order: str, width: int = CHUNK) -> DataFrame:
    """The same for several columns at once, each replaced by its running sum; other columns but the keys and `order` go."""
    chunked = df.select(*keys, order, *amounts).withColumn("_chunk", chunk_of(order, width))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(a).alias(a) for a in amounts])
    offsets = parts.select(*keys, "_chunk", *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"_before_{k}") for k, a in enumerate(amounts)])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = chunked.select(*keys, order, "_chunk", *[F.sum(a).over(inside).alias(a) for a in amounts]).join(offsets, [*keys, "_chunk"])
    return summed.select(*keys, order, *[(F.col(a) + F.col(f"_before_{k}")).alias(a) for k, a in enumerate(amounts)])


def split_rank(df: DataFrame, keys: Sequence[str], order: str, width: int = 4096) -> DataFrame:
    """Add ``rank`` (1-based, by a unique whole-number `order`) without sorting a whole group in one task."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_total(ones, keys, "_one", order, width).withColumnRenamed("running", "rank").drop("_one")


def explode_steps(df: DataFrame, name: str, lo: str, hi: str, step: int, block: int = 4096) -> DataFrame:
    """One row per `lo, lo + step, ... <= hi`, exploded in two levels so that a long span never becomes one long array."""
    wide = step * block
    blocks = df.withColumn("_from", F.explode(F.sequence(lo, hi, F.lit(wide).cast("long"))))
    stop = F.least(F.col(hi), F.col("_from") + wide - step)
    return blocks.withColumn(name, F.explode(F.sequence("_from", stop, F.lit(step).cast("long")))).drop("_from")
