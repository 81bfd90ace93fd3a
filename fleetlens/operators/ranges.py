"""Range-vector functions over a tick grid, and aggregation by label.

Times, windows and steps are in microseconds, as `ts`. Ticks lie at `start + k * step`. A sample at `ts` belongs to the window `(t - w, t]` of every tick t
with `ts <= t < ts + w`, so samples are fanned out to their ticks (at most w / step copies) instead of
range-joining ticks to samples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.functions.expressions import ratio


def _tick_bounds(ts: Column, start: int, end: int, step: int, reach: int) -> tuple[Column, Column]:
    last_tick = (end - start) // step
    first = F.greatest(F.ceil((ts - start) / step), F.lit(0)).cast("long")
    last = F.least(F.ceil((ts + reach - start) / step) - 1, F.lit(last_tick)).cast("long")
    return first, last


def _in_reach(samples: DataFrame, start: int, end: int, step: int, reach: int) -> DataFrame:
    """Samples that fall into the window of at least one tick, with their first and last tick."""
    first, last = _tick_bounds(F.col("ts"), start, end, step, reach)
    near = samples.filter((F.col("ts") > start - reach) & (F.col("ts") <= end))
    return near.withColumns({"_k0": first, "_k1": last}).filter("_k0 <= _k1")


def _ticks_per_chunk(step: int, reach: int) -> int:
    """Ticks of one chunk: ten minutes or four times the reach, so that few samples are seen by two chunks."""
    return max(1, -(-max(10 * cat.MINUTE, 4 * reach) // step))


def _to_chunks(rows: DataFrame, per_chunk: int) -> DataFrame:
    """Copy each row to the one or two tick chunks it is seen by."""
    lo, hi = F.floor(F.col("_k0") / per_chunk), F.floor(F.col("_k1") / per_chunk)
    return rows.withColumn("_chunk", F.explode(F.sequence(lo, hi)))


def _fan_out(rows: DataFrame, per_chunk: int, last: Column | None = None) -> DataFrame:
    """One row per tick of its own chunk that sees the row (up to `last`, by default all)."""
    first = F.greatest(F.col("_k0"), F.col("_chunk") * per_chunk)
    stop = F.least(F.col("_k1") if last is None else last, F.col("_chunk") * per_chunk + per_chunk - 1)
    return rows.filter(first <= stop).withColumn("_k", F.explode(F.sequence(first, stop)))


def instant_at_step(
    samples: DataFrame, keys: Sequence[str], start: int, end: int, step: int, lookback: int = cat.LOOKBACK
) -> DataFrame:
    """Latest sample within the lookback at each tick.

    Samples that share their first tick are cut to the latest one on the map side. The rest is laid out by
    (series, chunk), where a sample holds from its first tick until the next sample takes over.
    """
    thinned = (
        _in_reach(samples.select(*keys, "ts", "value"), start, end, step, lookback)
        .groupBy(*keys, "_k0")
        .agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    )
    _, last = _tick_bounds(F.col("ts"), start, end, step, lookback)
    per_chunk = _ticks_per_chunk(step, lookback)
    chunked = _to_chunks(thinned.withColumn("_k1", last).filter("_k0 <= _k1"), per_chunk)
    following = F.lead("_k0").over(Window.partitionBy(*keys, "_chunk").orderBy("_k0"))
    held = chunked.withColumn("_next", following)
    ticks = _fan_out(held, per_chunk, F.least(F.col("_k1"), F.col("_next") - 1))
    return ticks.select(*keys, (F.lit(start) + F.col("_k") * step).cast("long").alias("ts"), "value")


def avg_over_time(
    samples: DataFrame, keys: Sequence[str], window: int, start: int, end: int, step: int
) -> DataFrame:
    """Mean of the samples in the window of each tick.

    Samples seen by the same ticks are summed on the map side; the sums are laid out by (series, chunk) and
    fanned out there, so the fan-out itself is never shuffled.
    """
    condensed = (
        _in_reach(samples.select(*keys, "ts", "value"), start, end, step, window)
        .groupBy(*keys, "_k0", "_k1")
        .agg(F.sum("value").alias("_sum"), F.count("value").alias("_n"))
    )
    per_chunk = _ticks_per_chunk(step, window)
    placed = _to_chunks(condensed, per_chunk).repartition(*[F.col(k) for k in keys], F.col("_chunk"))
    ticks = _fan_out(placed, per_chunk).groupBy(*keys, "_chunk", "_k").agg(
        ratio(F.sum("_sum"), F.sum("_n")).alias("value")
    )
    return ticks.select(*keys, (F.lit(start) + F.col("_k") * step).cast("long").alias("ts"), "value")


def increase(
    samples: DataFrame, keys: Sequence[str], window: int, start: int, end: int, step: int
) -> DataFrame:
    """Reset-corrected, extrapolated growth of a counter over the window of each tick.

    One shuffle: ticks are grouped into chunks, a sample is copied to the one or two chunks whose ticks
    see it, and lag, fan-out and aggregation all run inside the (series, chunk) partition.
    """
    per_chunk = _ticks_per_chunk(step, window)
    near = _in_reach(samples.select(*keys, "ts", "value"), start, end, step, window)
    chunked = _to_chunks(near, per_chunk)
    order = Window.partitionBy(*keys, "_chunk").orderBy("ts")
    prev = F.lag("value").over(order)
    resets = chunked.withColumn("_prev", prev).withColumn(
        "_reset", F.when(F.col("value") < F.col("_prev"), F.col("_prev")).otherwise(F.lit(0.0))
    )
    # Samples seen by the same ticks are condensed before the fan-out; partitioning by (series, chunk) still holds.
    condensed = resets.groupBy(*keys, "_chunk", "_k0", "_k1").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("t_first"),
        F.max("ts").alias("t_last"),
        F.min_by("value", "ts").alias("v_first"),
        F.max_by("value", "ts").alias("v_last"),
        F.sum("_reset").alias("resets"),
        F.min_by("_reset", "ts").alias("reset_first"),
    )
    ticks = _fan_out(condensed, per_chunk)
    # The first sample of a window has no predecessor inside it, so its own reset does not count.
    facts = ticks.groupBy(*keys, "_chunk", "_k").agg(
        F.sum("n").alias("n"),
        F.min("t_first").alias("t_first"),
        F.max("t_last").alias("t_last"),
        F.min_by("v_first", "t_first").alias("v_first"),
        F.max_by("v_last", "t_last").alias("v_last"),
        (F.sum("resets") - F.min_by("reset_first", "t_first")).alias("resets"),
    )
    t = F.lit(start) + F.col("_k") * step
    shaped = facts.filter("n >= 2").select(
        *keys,
        t.cast("long").alias("ts"),
        (F.col("v_last") - F.col("v_first") + F.col("resets")).alias("_inc"),
        (F.col("t_last") - F.col("t_first")).cast("double").alias("_si"),
        ratio(F.col("t_last") - F.col("t_first"), F.col("n") - 1).alias("_avg"),
        (F.col("t_first") - (t - window)).cast("double").alias("_ds"),
        (t - F.col("t_last")).cast("double").alias("_de"),
        "v_first",
    )
    limit = F.col("_avg") * 1.1
    before = F.when(F.col("_ds") >= limit, F.col("_avg") / 2).otherwise(F.col("_ds"))
    to_zero = ratio(F.col("_si") * F.col("v_first"), F.col("_inc"))
    before = F.when((F.col("_inc") > 0) & (F.col("v_first") >= 0), F.least(before, to_zero)).otherwise(before)
    after = F.when(F.col("_de") >= limit, F.col("_avg") / 2).otherwise(F.col("_de"))
    grown = ratio(F.col("_inc") * (F.col("_si") + before + after), F.col("_si"))
    return shaped.select(*keys, "ts", grown.alias("value"))


def rate(samples: DataFrame, keys: Sequence[str], window: int, start: int, end: int, step: int) -> DataFrame:
    """Per-second increase."""
    grown = increase(samples, keys, window, start, end, step)
    return grown.withColumn("value", F.col("value") * cat.SECOND / window)


def agg_by(vector: DataFrame, func: str, by: Sequence[str] = ()) -> DataFrame:
    """sum, avg or count of a tick vector by labels (all series when `by` is empty)."""
    agg = {"sum": F.sum, "avg": F.avg, "count": F.count}[func]
    return vector.groupBy(*by, "ts").agg(agg("value").cast("double").alias("value"))


def compare_filter(vector: DataFrame, op: str, threshold: float) -> DataFrame:
    """Drop samples that fail the comparison; keep the value of the rest."""
    value, bound = F.col("value"), F.lit(float(threshold))
    cond = {
        ">": value > bound, ">=": value >= bound, "<": value < bound,
        "<=": value <= bound, "==": value == bound, "!=": value != bound,
    }[op]
    return vector.filter(cond)


def vector_op(left: DataFrame, right: DataFrame, keys: Sequence[str], op: str) -> DataFrame:
    """One-to-one arithmetic of two tick vectors on equal labels and tick; unmatched ticks drop out.

    Vectors hold one value per (labels, tick), so the match is one aggregation of both sides keyed by
    (labels, tick) rather than a join that scans and sorts each side.
    """
    sides = left.select(*keys, "ts", F.col("value").alias("_l"), F.lit(None).cast("double").alias("_r")).unionByName(
        right.select(*keys, "ts", F.lit(None).cast("double").alias("_l"), F.col("value").alias("_r"))
    )
    met = sides.groupBy(*keys, "ts").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    l, r = F.col("_l"), F.col("_r")
    value = {"+": l + r, "-": l - r, "*": l * r, "/": ratio(l, r)}[op]
    return met.filter(l.isNotNull() & r.isNotNull()).select(*keys, "ts", value.alias("value")).filter("value IS NOT NULL")


def regex_anchored(pattern: str) -> str:
    return f"^(?:{pattern})$"


def label_match(samples: DataFrame, matchers: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Filter by label matchers (`=`, `!=`, `=~`, `!~`); regular expressions match the whole value.

    A label is a promoted column where the table has one, else an entry of the `labels` map. An absent
    label reads as the empty string.
    """
    out = samples
    for label, (op, wanted) in matchers.items():
        source = F.col(label) if label in samples.columns else F.col("labels")[label]
        value = source if op == "=" and wanted != "" else F.coalesce(source, F.lit(""))
        cond = {
            "=": lambda: value == wanted,
            "!=": lambda: value != wanted,
            "=~": lambda: value.rlike(regex_anchored(wanted)),
            "!~": lambda: ~value.rlike(regex_anchored(wanted)),
        }[op]()
        out = out.filter(cond)
    return out


def promote_labels(samples: DataFrame, names: Sequence[str]) -> DataFrame:
    """Named labels as columns, and `series`, the whole label set as text; series without labels are dropped."""
    entries = F.array_sort(F.map_entries("labels"))
    return samples.filter(F.size("labels") > 0).select(
        "metric",
        *[F.col("labels")[n].alias(n) for n in names],
        F.to_json(entries).alias("series"),
        "ts",
        "value",
    )


def drop_labels(samples: DataFrame, names: Sequence[str]) -> DataFrame:
    return samples.withColumn("labels", F.map_filter("labels", lambda k, _: ~k.isin(*names)))


def add_label(samples: DataFrame, name: str, value: Column | str) -> DataFrame:
    """Insert a label where it is absent; an existing value stays."""
    value = F.lit(value) if isinstance(value, str) else value
    grown = F.map_concat("labels", F.create_map(F.lit(name), value))
    return samples.withColumn("labels", F.when(F.map_contains_key("labels", name), F.col("labels")).otherwise(grown))


def tag_service(samples: DataFrame, service: Column | str) -> DataFrame:
    """Set `exported_job` to the service name, replacing any earlier value."""
    service = F.lit(service) if isinstance(service, str) else service
    rest = F.map_filter("labels", lambda k, _: k != "exported_job")
    return samples.withColumn("labels", F.map_concat(rest, F.create_map(F.lit("exported_job"), service)))


def filter_service_series(series: DataFrame, job: str, column: str = "exported_job") -> DataFrame:
    """Series of one serving job; series without a job label stay."""
    return series.filter(F.col(column).isNull() | F.contains(F.col(column), F.lit(job)))
