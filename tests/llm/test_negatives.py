"""Hard negatives against a plain version that scores all pairs, and against SQL."""

import math
import random

import numpy as np
from fleetlens.llm import negatives, queries
from pyspark.sql import functions as F

EMBEDDINGS = "vec_id long, embedding array<float>, label int, score string, rank string, times int, mark string, row_block int"


def frame(spark, rows):
    """Embeddings with extra columns whose names clash with those of the operator."""
    return spark.createDataFrame([(i, v, lab, "x", "y", 7, "z", 1) for i, v, lab in rows], EMBEDDINGS)


def plain(rows, every):
    whole = []
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, lab, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for k, (i, lab, v) in enumerate(whole):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == lab) for m, (j, other, w) in enumerate(whole) if m != k)
        for s, j, same in [x for x in scored if x[2]][:5]:
            fits = [(t, n) for t, n, alike in scored if not alike and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fits[:3], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dims))
    return [(k, (centers[k % 4] + rng.normal(size=dims) * (0.2 + k % 3)).tolist(), int(rng.integers(0, 3))) for k in range(n)]


def test_equal_to_all_pairs(spark):
    for dims, seed in ((64, 1), (5, 2), (100, 3), (1, 4)):
        rows = clustered(400, dims, seed)
        want = plain(rows, 10)
        assert found(negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)) == want and want


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = clustered(60, 8, 6)
    tie = [0.5] * 8
    rows += [(100 + k, tie, k % 3) for k in range(40)] + [(100, tie, 0)] * 3 + [(0, rows[0][1], rows[0][2])] * 8 + [(0, tie, 1), (0, tie, 2)]
    rows += [(200, None, 1), (201, tie, None), (None, tie, 1), (202, [*tie[:7], None], 1), (203, [*tie[:7], float("nan")], 1), (204, [*tie[:7], float("-inf")], 2)]
    rows += [(210, [0.0] * 8, 1), (220, [], 2), (230, [1.0, -1.0], 0), (-50, [-x for x in tie], 1), (-57, tie, 2), (240, [1e-30] * 8, 1)]
    rng.shuffle(rows)
    want = plain(rows, 10)
    assert found(negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)) == want
    assert len(want) > len(set(want))


def test_large_components_are_cut(spark):
    rows = [(k, [3e38 if k % 2 else 1e9, float(k)], k % 2) for k in range(12)]
    limit = math.isqrt(2**62 // 2)
    got = found(negatives.mine(frame(spark, rows), F.col("vec_id") == 0))
    assert all(r[4] <= 2**62 and r[5] <= 2**62 for r in got) and limit**2 <= 2**62


def test_empty_tables(spark):
    assert found(negatives.mine(frame(spark, []), F.col("vec_id") % 10 == 0)) == []
    assert found(negatives.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") % 10 == 0)) == []
    assert found(negatives.mine(frame(spark, [(10, [1.0], 1)]), F.col("vec_id") % 10 == 0)) == []


def test_intervals_hold_every_score():
    rng = np.random.default_rng(7)
    for dims in (3, 64, 130):
        rows = rng.integers(-200, 200, (300, dims))
        rows[0] = 0
        anchors = rng.integers(-200, 200, (20, dims))
        codes, sides = negatives.coded(rows)

        class Held:
            pass

        held = Held()
        held.codes, held.sides, held.n = codes, sides, len(rows)
        exact, widths = anchors @ rows.T, []

        def keep(a, low, high):
            assert (low <= exact.ravel()).all() and (exact.ravel() <= high).all()
            widths.append((high - low).mean())
            return np.ones(len(a), bool)

        negatives.survivors(negatives.Planes(anchors), np.arange(20), held, np.arange(300), keep)
        assert len(widths) == negatives.LAYERS and (dims < 64 or widths[-1] < 0.5 * widths[0])


def test_blocks_give_the_same(spark, monkeypatch):
    rows = clustered(500, 16, 8)
    want = plain(rows, 7)
    monkeypatch.setattr(negatives, "BLOCK", 60)
    assert found(negatives.mine(frame(spark, rows), F.col("vec_id") % 7 == 0)) == want


def test_sql_twin(spark, sf, duck):
    want = sorted(duck.sql(queries.NEGATIVES_SQL).fetchall())
    assert found(queries.op13_hard_negatives(spark, sf)) == want
