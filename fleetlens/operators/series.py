"""Regular series: interval inference, grids, replica sums, resampling and tail rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.functions.expressions import ratio
from fleetlens.operators.chunks import CHUNK, explode_steps, with_halo, with_previous


def sampling_interval(
    samples: DataFrame,
    keys: Sequence[str],
    share: float = cat.INTERVAL_SHARE,
    min_points: int = cat.MIN_POINTS,
    chunk: int | None = CHUNK,
) -> DataFrame:
    """One row per series: points, last_ts, and `freq`, the gap that makes up more than `share` of all gaps.

    `freq` is NULL for series with fewer than `min_points` points or without such a gap. Gaps are
    counted per (series, gap) first, so the last step sees only the distinct gaps of a series.
    """
    gaps = with_previous(samples.select(*keys, "ts"), keys, ["ts"], width=chunk)
    counted = (
        gaps.groupBy(*keys, (F.col("ts") - F.col("prev_ts")).alias("gap"))
        .agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
        # A gap of zero is a repeated timestamp, not another point.
        .filter("gap IS NULL OR gap > 0")
    )
    is_gap = F.col("gap").isNotNull()
    per_series = counted.groupBy(*keys).agg(
        F.sum("n").alias("points"),
        F.max("last_ts").alias("last_ts"),
        F.max(F.when(is_gap, F.col("n"))).alias("_top"),
        # Of equally frequent gaps the smallest counts.
        F.max_by(F.when(is_gap, F.col("gap")), F.when(is_gap, F.struct(F.col("n"), -F.col("gap")))).alias("_gap"),
    )
    regular = (F.col("points") >= min_points) & (ratio(F.col("_top"), F.col("points") - 1) > share)
    return per_series.withColumn("freq", F.when(regular, F.col("_gap"))).drop("_top", "_gap")


def regularise(
    samples: DataFrame,
    keys: Sequence[str],
    n: int = cat.GRID_MINUTES,
    share: float = cat.INTERVAL_SHARE,
    fill: float = 0.0,
    unit: int = cat.MINUTE,
    chunk: int | None = CHUNK,
    keep_irregular: bool = True,
) -> DataFrame:
    """Put every series on a regular grid of its own interval.

    The grid runs from `(n - 1)` units before the last sample up to it, anchored at its start; grid
    points without an exactly matching sample take `fill`. `starts` marks the first grid point. Series
    without an interval keep their raw samples, with a NULL `freq`, unless `keep_irregular` is off.

    Series of any length go through chunks and a (series, ts) aggregation. With `chunk=None`
    the series are bounded, such as range-query results: one shuffle by series does everything.
    """
    columns = [*keys, "ts", "freq", "value", "starts"]
    if chunk is None:
        measured = _measure_bounded(samples, keys, share)
        on_grid = _grid_bounded(measured.filter("freq IS NOT NULL"), keys, n, fill, unit)
        irregular = measured.filter("freq IS NULL")
    else:
        stats = sampling_interval(samples, keys, share, chunk=chunk).select(*keys, "freq", "last_ts")
        on_grid = _grid_chunked(samples, stats, keys, n, fill, unit)
        irregular = samples.join(stats.filter("freq IS NULL").select(*keys, "freq"), list(keys))
    if not keep_irregular:
        return on_grid.select(*columns)
    return on_grid.select(*columns).unionByName(irregular.withColumn("starts", F.lit(False)).select(*columns))


def _measure_bounded(samples: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Samples with the interval (`freq`) and last timestamp of their series, from windows over one partitioning."""
    series = Window.partitionBy(*keys)
    # Equal timestamps keep one value; the same sort serves both windows.
    repeated = F.lead("ts").over(series.orderBy("ts", "value")) == F.col("ts")
    single = samples.select(*keys, "ts", "value").withColumn("_again", F.coalesce(repeated, F.lit(False))).filter("NOT _again")
    gaps = single.withColumn("_gap", F.col("ts") - F.lag("ts").over(series.orderBy("ts")))
    counted = gaps.withColumn("_n", F.count("_gap").over(Window.partitionBy(*keys, "_gap")))
    measured = counted.withColumns({
        "_points": F.count("*").over(series),
        "last_ts": F.max("ts").over(series),
        "_top": F.max("_n").over(series),
        "_mode": F.max_by("_gap", "_n").over(series),
    })
    regular = (F.col("_points") >= cat.MIN_POINTS) & (ratio(F.col("_top"), F.col("_points") - 1) > share)
    return measured.select(*keys, "ts", "value", "last_ts", F.when(regular, F.col("_mode")).alias("freq"))


def _grid_bounded(measured: DataFrame, keys: Sequence[str], n: int, fill: float, unit: int) -> DataFrame:
    """Grid rows per series; at most one sample per grid point is gathered, so arrays are bounded by the grid."""
    start = F.col("last_ts") - (n - 1) * unit
    on_grid = (F.col("ts") >= start) & ((F.col("ts") - start) % F.col("freq") == 0)
    gathered = measured.groupBy(*keys).agg(
        F.max("freq").alias("freq"),
        F.max("last_ts").alias("last_ts"),
        F.map_from_entries(F.collect_list(F.when(on_grid, F.struct("ts", "value")))).alias("_at"),
    )
    points = F.transform(
        F.sequence(start, F.col("last_ts"), F.col("freq")),
        lambda t: F.struct(
            t.alias("ts"), F.coalesce(F.col("_at")[t], F.lit(float(fill))).alias("value"), (t == start).alias("starts")
        ),
    )
    return gathered.select(*keys, "freq", F.inline(points))


def _grid_chunked(
    samples: DataFrame, stats: DataFrame, keys: Sequence[str], n: int, fill: float, unit: int
) -> DataFrame:
    """Grid points and samples meet in one aggregation keyed by (series, ts), which no hot series can skew."""
    start = F.col("last_ts") - (n - 1) * unit
    grid = stats.filter("freq IS NOT NULL").select(
        *keys, "freq", start.alias("_start"), F.explode(F.sequence(start, F.col("last_ts"), F.col("freq"))).alias("ts"),
    ).select(*keys, "ts", "freq", (F.col("ts") == F.col("_start")).alias("starts"), F.lit(None).cast("double").alias("value"))
    raw = samples.select(
        *keys, "ts", F.lit(None).cast("long").alias("freq"), F.lit(None).cast("boolean").alias("starts"), "value"
    )
    met = grid.unionByName(raw).groupBy(*keys, "ts").agg(
        F.max("freq").alias("freq"), F.max("starts").alias("starts"), F.max("value").alias("value")
    )
    return met.filter("freq IS NOT NULL").withColumn("value", F.coalesce("value", F.lit(float(fill))))


def sum_replicas(regular: DataFrame, group: Sequence[str], replica: str = "replica") -> DataFrame:
    """Add the regular series of all replicas, point by point.

    Replicas without an interval are left out and not counted. The grid of the first replica stays;
    where any counted replica has no value the sum is NULL. `n_valid` is the number of counted replicas.

    Replicas are summed per timestamp first (partial aggregation), so the window over a group sees one
    row per distinct grid point of the queried range, however many replicas there are.
    """
    points = regular.filter("freq IS NOT NULL").groupBy(*group, "ts").agg(
        F.count("value").alias("_n"),
        F.sum("value").alias("_sum"),
        F.min(replica).alias("_here"),
        F.count_if("starts").alias("_starts"),
    )
    whole = Window.partitionBy(*group)
    counted = points.withColumns({"n_valid": F.sum("_starts").over(whole), "_first": F.min("_here").over(whole)})
    return counted.filter(F.col("_here") == F.col("_first")).select(
        *group, "ts", F.when(F.col("_n") == F.col("n_valid"), F.col("_sum")).alias("value"), "n_valid"
    )


def resample(df: DataFrame, keys: Sequence[str], width: int = cat.MINUTE, extra: Sequence[str] = ()) -> DataFrame:
    """Bins of `width` with `total` (0 when empty) and `mean` (NULL when empty).

    Every bin between the first and the last of a series is present. Columns in `extra` are constant
    per series and kept. Samples become bins on the map side; each bin then brings the empty ones before it, found by a
    window over the bins of a series, so the input is read once and nothing is joined.
    """
    slot = F.col("ts") - F.col("ts") % width
    bins = df.groupBy(*keys, slot.alias("_bin")).agg(
        F.sum("value").alias("_sum"), F.avg("value").alias("_mean"), *[F.max(c).alias(c) for c in extra])
    before = F.lag("_bin").over(Window.partitionBy(*keys).orderBy("_bin"))
    spans = explode_steps(bins.withColumn("_lo", F.coalesce(before + width, "_bin")), "ts", "_lo", "_bin", width)
    full = F.col("ts") == F.col("_bin")
    return spans.select(
        *keys, "ts", F.when(full, F.coalesce("_sum", F.lit(0.0))).otherwise(0.0).alias("total"), F.when(full, F.col("_mean")).alias("mean"), *extra)


def last_points(df: DataFrame, keys: Sequence[str], m: int, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Last m rows per key. Spark cuts every map task to m rows per key before the shuffle."""
    order = [F.col(ts).desc(), *[F.col(c).desc() for c in tie]]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= m).drop("_rn")


def all_true(cond: Column) -> Column:
    """Aggregate: every row satisfies the condition; NULL counts as not satisfied."""
    return F.bool_and(F.coalesce(cond, F.lit(False)))


def strict_percentile(value: Column, q: float, where: Column | None = None) -> Column:
    """Aggregate: interpolated percentile, NULL as soon as one of the rows is NULL."""
    here = F.lit(True) if where is None else where
    missing = F.count_if(here & value.isNull())
    return F.when(missing == 0, F.percentile(F.when(here, value), F.lit(q)))


def tail_all(df: DataFrame, keys: Sequence[str], m: int, cond: Column) -> DataFrame:
    return last_points(df, keys, m).groupBy(*keys).agg(all_true(cond).alias("all_true"))


def tail_percentile(df: DataFrame, keys: Sequence[str], m: int, q: float, value: str = "value") -> DataFrame:
    return last_points(df, keys, m).groupBy(*keys).agg(strict_percentile(F.col(value), q).alias("pct"))


def reporting_replicas(intervals: DataFrame, group: Sequence[str]) -> DataFrame:
    """Replicas with an inferred interval, per group."""
    return intervals.groupBy(*group).agg(
        F.count_if(F.col("freq").isNotNull()).alias("n_valid"), F.count("*").alias("n_replicas")
    )


def reset_stale(
    samples: DataFrame, keys: Sequence[str], timeout: int = cat.STALE, chunk: int = CHUNK
) -> DataFrame:
    """Add a zero sample at `ts + timeout` wherever the next sample comes later than that, or never."""
    haloed = with_halo(samples.select(*keys, "ts", "value"), chunk, ahead=timeout)
    window = Window.partitionBy(*keys, "_chunk").orderBy("ts")
    spaced = haloed.withColumn("_next", F.lead("ts").over(window)).filter("_own")
    stale = F.col("_next").isNull() | (F.col("_next") - F.col("ts") > timeout)
    rows = F.when(
        stale,
        F.array(
            F.struct("ts", "value", F.lit(False).alias("stale")),
            F.struct((F.col("ts") + timeout).alias("ts"), F.lit(0.0).alias("value"), F.lit(True).alias("stale")),
        ),
    ).otherwise(F.array(F.struct("ts", "value", F.lit(False).alias("stale"))))
    return spaced.select(*keys, F.inline(rows))


def pivot_replicas(samples: DataFrame, keys: Sequence[str], metrics: Sequence[str] = cat.REPLICA_METRICS) -> DataFrame:
    """One row per (keys, ts) with one column per metric; absent metrics are NULL. One shuffle, no join."""
    return (
        samples.filter(F.col("metric").isin(*metrics))
        .groupBy(*keys, "ts")
        .agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])
    )


def previous_period(series: DataFrame, keys: Sequence[str], offset: int, value: str = "value") -> DataFrame:
    """Lay the series over itself `offset` earlier.

    Both periods meet in one aggregation over (series, ts), so the series is scanned and shuffled once.
    """
    doubled = series.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("ts").alias("ts"), F.col(value).alias("current"), F.lit(None).cast("double").alias("previous")),
                F.struct((F.col("ts") + offset).alias("ts"), F.lit(None).cast("double").alias("current"), F.col(value).alias("previous")),
            )
        ),
    )
    return doubled.groupBy(*keys, "ts").agg(F.max("current").alias("current"), F.max("previous").alias("previous"))


def overlay(series: DataFrame, offset: int, start: int, end: int) -> DataFrame:
    """Current and shifted earlier period as one long table with a `period` column."""
    current = series.filter(F.col("ts").between(start, end)).withColumn("period", F.lit("current"))
    earlier = series.filter(F.col("ts").between(start - offset, end - offset))
    return current.unionByName(
        earlier.withColumn("ts", F.col("ts") + offset).withColumn("period", F.lit("previous"))
    )
