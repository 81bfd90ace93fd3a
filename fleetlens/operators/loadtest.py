"""Load tests: report summaries, throughput inside test windows, request bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import catalog as cat
from fleetlens.functions.expressions import duration_seconds, ratio, success_percent
from fleetlens.operators.chunks import CHUNK, chunk_of, with_halo

# Aligned block lengths that cover the inside of a test window; the finest also keys the edges.
BLOCKS = (10 * cat.MINUTE, cat.HOUR)
SALTS = 4
# Longest test that has a window.
MOST_SECONDS = 366 * 86400


def summarise_load_report(report: DataFrame) -> DataFrame:
    """Requests, successes and mean elapsed time per test."""
    return report.groupBy("test_id").agg(
        F.count("*").alias("total"), F.count_if("success").alias("success"), F.avg("elapsed").alias("elapsed_avg")
    )


def with_success_rate(summary: DataFrame) -> DataFrame:
    return summary.withColumn("success_rate", success_percent(F.col("success"), F.col("total")))


def unreadable_durations(tests: DataFrame) -> DataFrame:
    """Tests whose duration or unit is missing, unknown or beyond a year; they have no window."""
    return tests.filter(~_known_duration())


def _known_duration() -> Column:
    # Windows are cut into hours, so one absurd duration must not become an endless list.
    return F.coalesce(duration_seconds(F.col("duration"), F.col("duration_unit")) <= MOST_SECONDS, F.lit(False))


def test_windows(tests: DataFrame) -> DataFrame:
    """Window of a test in epoch microseconds: at least a minute long, both ends inclusive. `created` is in seconds.

    Tests of unknown duration are left out here and found by ``unreadable_durations``.
    """
    length = F.greatest(F.lit(60), duration_seconds(F.col("duration"), F.col("duration_unit")))
    return tests.filter(_known_duration()).withColumns({
        "w_start": (F.col("created") * cat.SECOND).cast("long"), "w_end": ((F.col("created") + length) * cat.SECOND).cast("long")})


COVER = "array<struct<size:bigint,block:bigint,lo:bigint,hi:bigint>>"


def _cover(start: Column, end: Column) -> Column:
    """Cover start..end exactly: aligned blocks inside, single timestamps in the two edge blocks.

    Besides its full hours a window takes at most two edges and ten blocks of ten minutes.
    """
    stop = end + 1
    fine = BLOCKS[0]
    spans = [(size, _up(start, size), _down(stop, size)) for size in BLOCKS]
    _, lo, hi = spans[0]
    first_stop = F.least(lo, stop)
    parts = [
        _edge(start, first_stop, _down(start, fine)),
        F.when(hi >= lo, _edge(hi, stop, hi)).otherwise(_nothing()),
    ]
    for (size, lo, hi), larger in zip(spans, [*spans[1:], None]):
        if larger is None:
            parts.append(_run(size, lo, hi))
            continue
        # The larger blocks take the middle, where there is one.
        _, mid_lo, mid_hi = larger
        has_middle = mid_lo < mid_hi
        parts.append(_run(size, lo, F.when(has_middle, mid_lo).otherwise(hi)))
        parts.append(_run(size, F.when(has_middle, mid_hi).otherwise(hi), hi))
    return F.concat(*parts)


def _up(x: Column, size: int) -> Column:
    return (F.ceil(x / size) * size).cast("long")


def _down(x: Column, size: int) -> Column:
    return (F.floor(x / size) * size).cast("long")


def _nothing() -> Column:
    return F.array().cast(COVER)


def _edge(lo: Column, stop: Column, block: Column) -> Column:
    one = F.array(F.struct(F.lit(1).alias("size"), block.alias("block"), lo.alias("lo"), (stop - 1).alias("hi")))
    return F.when(lo < stop, one.cast(COVER)).otherwise(_nothing())


def _run(size: int, lo: Column, hi: Column) -> Column:
    run = F.transform(
        F.sequence(lo, hi - size, F.lit(size).cast("long")),
        lambda b: F.struct(F.lit(size).alias("size"), b.alias("block"), b.alias("lo"), b.alias("hi")),
    )
    return F.when(lo < hi, run.cast(COVER)).otherwise(_nothing())


def series_in_windows(windows: DataFrame, samples: DataFrame, series: Sequence[str], match: Sequence[str] = ()) -> DataFrame:
    """Sum, count and peak per (test, series) over the samples inside each test window.

    An interval join by exact cover: every window becomes a bounded set of aligned blocks, samples are
    rolled up once per block size, and both meet in an equi-join on (size, block). Long windows touch hour
    rollups instead of raw samples. Only distinct windows take part; the tests are joined to their window's sums. Windows are repeated over a few salts so that one busy block is spread.
    `match` names columns both sides must agree on.
    """
    # Samples outside every window's hours are dropped first. One row per calendar hour (under 9000 a year,
    # however many tests or samples there are) is small enough to broadcast.
    hour = BLOCKS[-1]
    hours = windows.select(
        F.explode(F.sequence(_down(F.col("w_start"), hour), F.col("w_end"), F.lit(hour).cast("long"))).alias("_hour")
    ).distinct()
    near = samples.withColumn("_hour", _down(F.col("ts"), hour)).join(F.broadcast(hours), "_hour", "left_semi")
    merged = [F.sum("v_sum").alias("v_sum"), F.sum("v_n").alias("v_n"), F.max("v_peak").alias("v_peak")]
    level = near.groupBy(*series, F.col("ts").alias("at")).agg(
        F.sum("value").alias("v_sum"), F.count("value").alias("v_n"), F.max(F.abs("value")).alias("v_peak")
    )
    rollups = level.withColumn("size", F.lit(1).cast("long")).withColumn("block", _down(F.col("at"), BLOCKS[0]))
    for size in BLOCKS:
        level = level.groupBy(*series, _down(F.col("at"), size).alias("at")).agg(*merged)
        rollups = rollups.unionByName(level.withColumn("size", F.lit(size).cast("long")).withColumn("block", F.col("at")))
    rollups = rollups.withColumn("_salt", F.pmod(F.xxhash64(*series), F.lit(SALTS)).cast("int"))
    # Tests that share a window are one window until the end.
    window = ["w_start", "w_end", *match]
    covered = windows.select(*window).distinct().select(*window, F.inline(_cover(F.col("w_start"), F.col("w_end"))))
    covered = covered.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = covered.join(rollups, ["size", "block", "_salt", *match]).filter("at BETWEEN lo AND hi")
    per_window = hits.groupBy(*dict.fromkeys([*window, *series])).agg(*merged)
    return windows.select("test_id", *window).join(per_window, window).select("test_id", *dict.fromkeys(series), "v_sum", "v_n", "v_peak")


def robust_average(per_series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over all values of the series that are not zero throughout; 0 where nothing is left."""
    live = F.col("v_peak") > 0
    return per_series.groupBy(*keys).agg(
        F.coalesce(
            ratio(F.sum(F.when(live, F.col("v_sum"))), F.sum(F.when(live, F.col("v_n")))), F.lit(0.0)
        ).alias("robust_avg")
    )


def robust_metric_avg(samples: DataFrame, keys: Sequence[str], series: Sequence[str]) -> DataFrame:
    per_series = samples.groupBy(*dict.fromkeys([*keys, *series])).agg(
        F.sum("value").alias("v_sum"), F.count("value").alias("v_n"), F.max(F.abs("value")).alias("v_peak")
    )
    return robust_average(per_series, keys)


def job_averages(samples: DataFrame, lookback: int = cat.LOOKBACK) -> DataFrame:
    """metric, exported_job, t, t_end, value: what an instant query for the mean over a job's series gives from t up to t_end.

    A sample is seen until the next one of its series, for less than `lookback`. The mean comes from a sweep: a sample
    adds its value and one series where it starts to be seen and takes them away where it stops; running sums of these signed
    events are the total and the number of series in view. The sweep starts anew in each (job, chunk), for which samples are cut
    at the edges of chunks, so it holds two events per sample and chunk and rounding doesn't add up. Values that aren't finite are
    counted instead of added.
    """
    series = [c for c in samples.columns if c not in ("ts", "value")]
    near = with_halo(samples, CHUNK, ahead=lookback)
    following = F.lead("ts").over(Window.partitionBy(*series, "_chunk").orderBy("ts"))
    until = F.least(F.coalesce("_next", F.col("ts") + lookback), F.col("ts") + lookback)
    seen = near.withColumn("_next", following).filter("_own").withColumn("until", until)

    chunks = F.sequence(chunk_of("ts", CHUNK), chunk_of(F.col("until") - 1, CHUNK))
    pieces = seen.filter("until > ts").select("metric", "exported_job", "ts", "until", "value", F.explode(chunks).alias("_chunk"))
    begin, end = F.greatest("ts", F.col("_chunk") * CHUNK), F.least("until", (F.col("_chunk") + 1) * CHUNK)
    value, infinite = F.col("value"), float("inf")
    odd = F.isnan(value) | (F.abs(value) == infinite)
    parts = {
        "n": F.lit(1), "total": F.when(odd, 0.0).otherwise(value), "moved": (value != 0).cast("int"),
        "none": F.isnan(value).cast("int"), "high": (value == infinite).cast("int"), "low": (value == -infinite).cast("int")}
    event = lambda at, sign: F.struct(at.alias("t"), *[(c * sign).alias(k) for k, c in parts.items()])
    key = ["metric", "exported_job", "_chunk"]
    events = pieces.select(*key, F.inline(F.array(event(begin, 1), event(end, -1))))
    steps = events.groupBy(*key, "t").agg(*[F.sum(k).alias(k) for k in parts])
    order = Window.partitionBy(*key).orderBy("t")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select(*key, "t", F.lead("t").over(order).alias("t_end"), *[F.sum(k).over(running).alias(k) for k in parts])
    # Where all series are at zero the total is zero, whatever rounding left.
    mean = (
        F.when((F.col("none") > 0) | ((F.col("high") > 0) & (F.col("low") > 0)), F.lit(float("nan")))
        .when(F.col("high") > 0, F.lit(infinite)).when(F.col("low") > 0, F.lit(-infinite))
        .when(F.col("moved") == 0, F.lit(0.0)).otherwise(F.col("total") / F.col("n")))
    return swept.filter("n > 0 AND t_end IS NOT NULL").select("metric", "exported_job", "t", "t_end", mean.alias("value"))


def job_averages_in_windows(windows: DataFrame, averages: DataFrame, step: int, match: Sequence[str] = ()) -> DataFrame:
    """Sum, count and peak of a job's averages at the ticks w_start, w_start + step, ... <= w_end of each distinct window.

    Windows and segments meet in the hours that both touch, and are counted in the first of these. How many ticks lie in
    a segment is arithmetic, so no tick is written out.
    """
    hour = F.lit(BLOCKS[-1]).cast("long")
    grids = windows.select("w_start", "w_end", *match).distinct()
    by_hour = grids.withColumn("_h", F.explode(F.sequence(_down(F.col("w_start"), BLOCKS[-1]), F.col("w_end"), hour)))
    pieces = averages.withColumn("_h", F.explode(F.sequence(_down(F.col("t"), BLOCKS[-1]), F.col("t_end") - 1, hour)))
    first = F.greatest(_down(F.col("w_start"), BLOCKS[-1]), _down(F.col("t"), BLOCKS[-1]))
    low = F.ceil((F.greatest("t", "w_start") - F.col("w_start")) / step)
    high = F.floor((F.least(F.col("t_end") - 1, F.col("w_end")) - F.col("w_start")) / step)
    met = by_hour.join(pieces, ["_h", *match]).filter(F.col("_h") == first).withColumn("_n", high - low + 1).filter("_n > 0")
    return met.groupBy("w_start", "w_end", *dict.fromkeys(["metric", "exported_job"])).agg(
        F.sum(F.col("value") * F.col("_n")).alias("v_sum"), F.sum("_n").alias("v_n"), F.max(F.abs("value")).alias("v_peak"))


def test_throughput(
    tests: DataFrame, samples: DataFrame, prompt: str, generation: str, by_job: bool = False, step: int = cat.MINUTE
) -> DataFrame:
    """Prompt and generation throughput per test, truncated to whole numbers; 0 without data.

    Means of a job's series are taken every `step` of the test's window; jobs that stay at zero are left
    out, and the mean of all other values counts. All jobs count, as in the dashboards; `by_job` restricts a test to the
    job it drives (`exported_job` on both sides). All columns of `samples` but `ts` and `value` name a series.
    """
    metrics = samples.filter(F.col("metric").isin(prompt, generation))
    match = ["exported_job"] if by_job else []
    windows = test_windows(tests)
    per_window = job_averages_in_windows(windows, job_averages(metrics), step, match)
    live = F.col("v_peak") > 0
    # Rounded before truncation, so that the order of summation cannot tip a whole number.
    mean = lambda name: F.round(F.coalesce(
        ratio(
            F.sum(F.when(live & (F.col("metric") == name), F.col("v_sum"))),
            F.sum(F.when(live & (F.col("metric") == name), F.col("v_n"))),
        ),
        F.lit(0.0),
    ), 9).cast("long")
    keys = ["w_start", "w_end", *match]
    measured = per_window.groupBy(*keys).agg(mean(prompt).alias("prompt_tps"), mean(generation).alias("generation_tps"))
    measured = windows.select("test_id", *keys).join(measured, keys)
    zero = F.lit(0).cast("long")
    return tests.select("test_id").join(measured, "test_id", "left").select(
        "test_id", F.coalesce("prompt_tps", zero).alias("prompt_tps"), F.coalesce("generation_tps", zero).alias("generation_tps")
    )


def finalise_tests(tests: DataFrame, summary: DataFrame, throughput: DataFrame) -> DataFrame:
    """Finished tests with their result: `failed` without a report, else `success`."""
    return (
        tests.join(summary, "test_id", "left").join(throughput, "test_id", "left")
        .withColumn("test_status", F.when(F.col("total").isNull(), "failed").otherwise("success"))
    )


def test_query_window(tests: DataFrame, now: Column, compat: bool = False) -> DataFrame:
    """Chart range of a test: from its creation to three minutes after its end, not beyond `now`.

    `compat` takes durations in seconds for ten at most, as older charts did.
    """
    seconds = F.least(F.col("duration"), F.lit(10)) if compat else F.col("duration")
    length = (
        F.when(F.col("duration_unit") == "hour", F.col("duration") * 3600)
        .when(F.col("duration_unit") == "min", F.col("duration") * 60)
        .when(F.col("duration_unit") == "sec", seconds)
        .otherwise(F.lit(0))
    )
    return tests.select(
        "test_id",
        F.col("created").alias("q_start"),
        F.least(F.col("created") + length + 180, now).cast("long").alias("q_end"),
    )


def render_requests(requests: DataFrame, tests: DataFrame) -> DataFrame:
    """Request path and JSON body for every request of a load test.

    `requests`: test_id, prompt_id, question. `tests`: test_id, mode, model, max_tokens, temperature,
    top_p. The model field appears in `openai` mode only.
    """
    joined = requests.join(tests, "test_id")
    path = F.element_at(F.create_map(*[F.lit(x) for kv in cat.REQUEST_PATH_BY_MODE.items() for x in kv]), F.col("mode"))
    plain = F.struct(F.col("question").alias("prompt"), "max_tokens", "temperature", "top_p")
    named = F.struct("model", F.col("question").alias("prompt"), "max_tokens", "temperature", "top_p")
    body = F.when(F.col("mode") == "openai", F.to_json(named)).otherwise(F.to_json(plain))
    return joined.select("test_id", "prompt_id", path.alias("path"), body.alias("body"))
