"""Series rules on small hand-made and random series, against plain Python.

Where all widths are given, timestamps are in any unit; the others are in microseconds."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog import HOUR, MINUTE, SECOND
from fleetlens.operators import chunks, ranges, series

KEYS = ["service", "replica", "metric"]
SCHEMA = "service string, replica string, metric string, ts bigint, value double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def one(values, service="s", replica="r0", metric="m"):
    return [(service, replica, metric, t, float(v)) for t, v in values]


def freq_of(spark, stamps, width=100):
    rows = one([(t, 1.0) for t in stamps])
    return series.sampling_interval(frame(spark, rows), KEYS, chunk=width).first()["freq"]


def test_interval_needs_five_points(spark):
    assert freq_of(spark, [0, 15, 30, 45]) is None
    assert freq_of(spark, [0, 15, 30, 45, 60]) == 15


def test_interval_share_is_strict(spark):
    # Five gaps, four of them equal: a share of exactly 0.8 does not count.
    assert freq_of(spark, [0, 15, 30, 45, 60, 90]) is None
    assert freq_of(spark, [0, 15, 30, 45, 60, 75, 105]) == 15


def python_interval(stamps, share=0.8):
    if len(stamps) < 5:
        return None
    gaps = Counter(b - a for a, b in zip(stamps, stamps[1:]))
    gap, n = max(gaps.items(), key=lambda kv: (kv[1], -kv[0]))
    return gap if n / sum(gaps.values()) > share else None


def python_grid(points, n, unit, fill=0.0):
    points = sorted(points)
    freq = python_interval([t for t, _ in points])
    if freq is None:
        return None
    last = points[-1][0]
    known = dict(points)
    out, t = [], last - (n - 1) * unit
    while t <= last:
        out.append((t, known.get(t, fill)))
        t += freq
    return out


@pytest.mark.parametrize("chunk", [None, 300])
def test_grid_is_anchored_at_its_start(spark, chunk):
    rows = one([(1000 + 50 * i, i) for i in range(60)])
    got = series.regularise(frame(spark, rows), KEYS, unit=60, chunk=chunk).orderBy("ts").collect()
    last = 1000 + 50 * 59
    assert [r["ts"] for r in got] == list(range(last - 1740, last + 1, 50))
    assert len(got) == 35 and got[-1]["ts"] == last - 40
    # 1740 is no multiple of 50: no sample falls on the grid, so every point takes the fill value.
    assert {r["value"] for r in got} == {0.0}


@pytest.mark.parametrize("chunk", [None, 120])
def test_random_series_match_plain_python(spark, chunk):
    rng = random.Random(7)
    rows, expected = [], {}
    for s in range(3):
        for r in range(4):
            step = rng.choice([15, 15, 30, 60])
            start = 10_000 + rng.choice([0, 0, 15])
            stamps = [start + step * i for i in range(rng.choice([3, 40, 130]))]
            stamps = [t for t in stamps if rng.random() > 0.03]
            points = [(t, float(rng.randint(0, 99))) for t in stamps]
            rows += one(points, f"s{s}", f"r{r}")
            expected[f"s{s}", f"r{r}"] = python_grid(points, 10, 60)
    regular = series.regularise(frame(spark, rows), KEYS, n=10, unit=60, chunk=chunk)
    got = {}
    for row in regular.filter("freq IS NOT NULL").collect():
        got.setdefault((row["service"], row["replica"]), []).append((row["ts"], row["value"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in expected.items() if v is not None}
    irregular = {(r["service"], r["replica"]) for r in regular.filter("freq IS NULL").select("service", "replica").collect()}
    assert irregular == {k for k, v in expected.items() if v is None and any(x[0] == k[0] and x[1] == k[1] for x in rows)}

    summed = {(r["service"], r["ts"]): (r["value"], r["n_valid"]) for r in series.sum_replicas(regular, ["service", "metric"]).collect()}
    wanted = {}
    for s in {k[0] for k in expected}:
        grids = [expected[s, r] for r in sorted(r for q, r in expected if q == s) if expected[s, r] is not None]
        if grids:
            for t, _ in grids[0]:
                parts = [dict(g).get(t) for g in grids]
                wanted[s, t] = (None if None in parts else sum(parts), len(grids))
    assert summed == wanted


def test_resample_fills_empty_bins(spark):
    rows = one([(0, 1), (15, 2), (200, 5)])
    got = series.resample(frame(spark, rows), KEYS, 60).orderBy("ts").collect()
    assert [(r["ts"], r["total"], r["mean"]) for r in got] == [(0, 3.0, 1.5), (60, 0.0, None), (120, 0.0, None), (180, 5.0, 5.0)]


def test_tail_percentile_interpolates_and_needs_all_points(spark):
    rows = one([(0, 9), (60, 1), (120, 2), (180, 3)]) + one([(0, 1), (60, 1)], replica="r1")
    df = frame(spark, rows).withColumn("value", F.when(F.col("replica") == "r0", F.col("value")).when(F.col("ts") == 0, 1.0))
    got = {r["replica"]: r["pct"] for r in series.tail_percentile(df, KEYS, 3, 0.9).collect()}
    assert got["r0"] == pytest.approx(2.8) and got["r1"] is None


def test_tail_all_treats_null_as_false(spark):
    rows = one([(0, 50), (60, 60), (120, 70)]) + one([(0, 1), (60, 60), (120, 70), (180, 80)], replica="r1")
    df = frame(spark, rows)
    got = {r["replica"]: r["all_true"] for r in series.tail_all(df, KEYS, 3, F.col("value") >= 50).collect()}
    assert got == {"r0": True, "r1": True}
    nulled = df.withColumn("value", F.when(F.col("ts") != 60, F.col("value")))
    assert not any(r["all_true"] for r in series.tail_all(nulled, KEYS, 3, F.col("value") >= 50).collect())


def test_reset_stale_over_chunk_edges(spark):
    rows = one([(10, 1), (20, 2), (36, 3), (100, 4), (114, 5)])
    got = series.reset_stale(frame(spark, rows), KEYS, timeout=15, chunk=10)
    assert sorted((r["ts"], r["value"]) for r in got.filter("stale").collect()) == [(35, 0.0), (51, 0.0), (129, 0.0)]
    assert got.filter("NOT stale").count() == 5


@pytest.mark.parametrize("seconds", [1, 7, 1000, None])
def test_with_previous_on_a_hot_series(spark, seconds):
    rng = random.Random(3)
    stamps = sorted(rng.sample(range(5000), 400))
    rows = one([(t, t * 2) for t in stamps]) + one([(4, 1), (4000, 2)], replica="cold")
    got = {
        (r["replica"], r["ts"]): (r["prev_ts"], r["prev_value"])
        for r in chunks.with_previous(frame(spark, rows), KEYS, ["ts", "value"], width=seconds).collect()
    }
    expected = {("r0", t): (p, None if p is None else p * 2.0) for p, t in zip([None, *stamps], stamps)}
    expected |= {("cold", 4): (None, None), ("cold", 4000): (4, 1.0)}
    assert got == expected


def test_running_total_and_rank_over_chunks(spark):
    rng = random.Random(5)
    order = rng.sample(range(10_000), 300)
    rows = [("hot", i, i % 7) for i in order] + [("cold", 5, 1)]
    df = spark.createDataFrame(rows, "k string, i bigint, n bigint")
    got = {r["i"]: r["running"] for r in chunks.running_total(df, ["k"], "n", "i", 64).filter("k = 'hot'").collect()}
    ranks = {r["i"]: r["rank"] for r in chunks.split_rank(df, ["k"], "i", 64).filter("k = 'hot'").collect()}
    total = 0
    for rank, i in enumerate(sorted(order), start=1):
        total += i % 7
        assert got[i] == total and ranks[i] == rank


def python_increase(points, t, w):
    inside = [(x, v) for x, v in points if t - w < x <= t]
    if len(inside) < 2:
        return None
    growth = inside[-1][1] - inside[0][1] + sum(a[1] for a, b in zip(inside, inside[1:]) if b[1] < a[1])
    length = inside[-1][0] - inside[0][0]
    gap = length / (len(inside) - 1)
    before, after = inside[0][0] - (t - w), t - inside[-1][0]
    before = gap / 2 if before >= 1.1 * gap else before
    after = gap / 2 if after >= 1.1 * gap else after
    if growth > 0 and inside[0][1] >= 0:
        before = min(before, length * inside[0][1] / growth)
    return growth * (length + before + after) / length


def counter_points(rng, n):
    t, v, out = 1000, 0.0, []
    for _ in range(n):
        t += rng.choice([0.004, 0.25, 5, 15, 15.000001, 15, 40, 300])
        v = 0.0 if rng.random() < 0.05 else v + rng.randint(0, 20)
        out.append((round(t * SECOND), v))
    return out


@pytest.mark.parametrize("window,step", [(60, 60), (300, 60), (300, 15), (90, 120)])
def test_increase_with_resets(spark, window, step):
    rng = random.Random(11)
    points = counter_points(rng, 900)
    window, step = window * SECOND, step * SECOND
    start, end = 990 * SECOND, points[-1][0] + 400 * SECOND
    got = {r["ts"]: r["value"] for r in ranges.increase(frame(spark, one(points)), KEYS, window, start, end, step).collect()}
    expected = {}
    for t in range(start, end + 1, step):
        value = python_increase(points, t, window)
        if value is not None:
            expected[t] = value
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[t], expected[t], rel_tol=1e-9, abs_tol=1e-9) for t in got)


def test_instant_and_mean_follow_the_window_edges(spark):
    points = [(0, 1), (60, 2), (61, 3), (400, 4)]
    df = frame(spark, one(points))
    instant = {r["ts"]: r["value"] for r in ranges.instant_at_step(df, KEYS, 0, 720, 60, 300).collect()}
    # A sample is seen at its own time and for less than the lookback after it.
    assert instant == {0: 1.0, 60: 2.0, 120: 3.0, 180: 3.0, 240: 3.0, 300: 3.0, 360: 3.0, 420: 4.0, 480: 4.0, 540: 4.0, 600: 4.0, 660: 4.0}
    mean = {r["ts"]: r["value"] for r in ranges.avg_over_time(df, KEYS, 60, 0, 120, 60).collect()}
    assert mean == {0: 1.0, 60: 2.0, 120: 3.0}


def test_vector_op_drops_unmatched_and_zero_division(spark):
    left = spark.createDataFrame([("a", 0, 6.0), ("a", 60, 1.0), ("b", 0, 1.0)], "k string, ts bigint, value double")
    right = spark.createDataFrame([("a", 0, 3.0), ("a", 60, 0.0)], "k string, ts bigint, value double")
    assert [tuple(r) for r in ranges.vector_op(left, right, ["k"], "/").collect()] == [("a", 0, 2.0)]


def test_label_match_is_anchored(spark):
    df = spark.createDataFrame([({"job": "a-replica1"},), ({"job": "xa-replica1"},), ({"other": "1"},)], "labels map<string,string>")
    assert ranges.label_match(df, {"job": ("=~", "a-replica.*")}).count() == 1
    assert ranges.label_match(df, {"job": ("!~", "a-replica.*")}).count() == 2
    assert ranges.label_match(df, {"job": ("=", "")}).count() == 1


def test_explode_steps_in_blocks(spark):
    df = spark.createDataFrame([(0, 1000), (5, 5), (7, 26)], "lo bigint, hi bigint")
    got = sorted((r["lo"], r["t"]) for r in chunks.explode_steps(df, "t", "lo", "hi", 10, block=4).collect())
    assert got == sorted((lo, t) for lo, hi in ((0, 1000), (5, 5), (7, 26)) for t in range(lo, hi + 1, 10))


@pytest.mark.parametrize("reach,step", [(300, 60), (45, 60), (300, 7)])
def test_instant_and_mean_over_many_chunks(spark, reach, step):
    rng = random.Random(13)
    stamps = sorted(rng.sample(range(1000, 16_000), 700))
    points = [(t * SECOND + rng.choice([0, 0, 1, 500_000, 999_999]), float(rng.randint(0, 50))) for t in stamps]
    points += [(points[k][0] + 7, 60.0) for k in range(0, 700, 9)]
    points.sort()
    start, end, step, reach = 1003 * SECOND, 16_500 * SECOND, step * SECOND, reach * SECOND
    df = frame(spark, one(points))
    instant = {r["ts"]: r["value"] for r in ranges.instant_at_step(df, KEYS, start, end, step, reach).collect()}
    mean = {r["ts"]: r["value"] for r in ranges.avg_over_time(df, KEYS, reach, start, end, step).collect()}
    seen = {t: [v for x, v in points if t - reach < x <= t] for t in range(start, end + 1, step)}
    seen = {t: v for t, v in seen.items() if v}
    assert instant == {t: v[-1] for t, v in seen.items()}
    assert mean.keys() == seen.keys()
    assert all(math.isclose(mean[t], sum(v) / len(v)) for t, v in seen.items())


@pytest.mark.parametrize("chunk", [None, 60])
def test_repeated_timestamps_keep_one_value(spark, chunk):
    rows = one([(15 * i, i) for i in range(40)] + [(300, 99), (300, 7)])
    got = series.regularise(frame(spark, rows), KEYS, n=5, unit=60, chunk=chunk).orderBy("ts").collect()
    assert [r["ts"] for r in got] == list(range(345, 586, 15))
    early = series.regularise(frame(spark, rows).filter("ts <= 390"), KEYS, n=5, unit=60, chunk=chunk)
    assert {r["ts"]: r["value"] for r in early.collect()}[300] == 99.0


@pytest.mark.parametrize("seconds", [None, 20])
def test_interval_ignores_repeated_timestamps(spark, seconds):
    stamps = [0, 15, 15, 15, 30, 45, 60]
    got = series.sampling_interval(frame(spark, one([(t, 1.0) for t in stamps])), KEYS, chunk=seconds).first()
    assert (got["points"], got["freq"], got["last_ts"]) == (5, 15, 60)
    same = series.sampling_interval(frame(spark, one([(7, 1.0)] * 9)), KEYS, chunk=seconds).first()
    assert (same["points"], same["freq"]) == (1, None)


def test_subsecond_intervals(spark):
    """Four samples a second are a series of a quarter of a second, and each lies on its grid."""
    rows = one([(k * SECOND // 4, k) for k in range(400)])
    for chunk in (None, 7 * SECOND):
        got = series.regularise(frame(spark, rows), KEYS, n=2, chunk=chunk).orderBy("ts").collect()
        assert {r["freq"] for r in got} == {SECOND // 4} and [r["value"] for r in got] == [float(k) for k in range(159, 400)]


def test_a_million_samples_an_hour_in_bounded_tasks(spark):
    """One series of 3,600 microseconds between samples: nothing is merged, and no window sees more than its chunk."""
    n = 1_000_000
    samples = spark.range(n).select(F.lit("m").alias("metric"), (F.col("id") * (HOUR // n)).alias("ts"), (F.col("id") % 100).cast("double").alias("value"))
    again = samples.unionByName(samples.filter("ts % 36000000 = 0"))
    merged = chunks.latest(again, ["metric"], "value")
    assert merged.count() == n
    most = samples.groupBy(chunks.chunk_of("ts", chunks.CHUNK)).count().agg(F.max("count")).first()[0]
    assert most == n // 12 + 1
    stats = series.sampling_interval(merged, ["metric"]).first()
    assert (stats["points"], stats["freq"]) == (n, HOUR // n)
    last = chunks.with_previous(merged, ["metric"], ["ts"]).agg(F.count("prev_ts"), F.max(F.col("ts") - F.col("prev_ts"))).first()
    assert tuple(last) == (n - 1, HOUR // n)
    means = ranges.avg_over_time(merged, ["metric"], MINUTE, 0, HOUR, MINUTE).collect()
    assert len(means) == 61 and all(abs(r["value"] - 49.5) < 0.15 for r in means[1:] if 0 < r["ts"] < HOUR)
    growth = ranges.rate(merged.withColumn("value", F.col("ts") / SECOND), ["metric"], MINUTE, MINUTE, HOUR - MINUTE, MINUTE).collect()
    assert len(growth) == 59 and all(abs(r["value"] - 1) < 1e-3 for r in growth)


def test_no_event_is_lost(spark, sf):
    """Events closer together than a second each stay a sample; only equal timestamps of a series are merged."""
    from fleetlens.plans.series_queries import ALL_METRICS, all_view_samples
    from fleetlens.sources import fixtures as fx

    events = fx.events(spark, sf)
    assert fx.samples(spark, sf).count() == events.select("event_type", "replica", "ts").distinct().count()
    assert events.filter(F.col("ts") % SECOND != 0).count() > 0
    series_of = events.select("replica", F.floor(F.col("user_id") / 6) % 2, F.col("user_id") % 5 == 0, "ts").distinct()
    assert all_view_samples(spark, sf).count() == len(ALL_METRICS) * series_of.count()
