"""Hard negatives of anchors, by rotated one-bit codes whose intervals decide what is scored.

Each vector of whole numbers is turned by a fixed rotation and stored as the signs of its components, its alignment
with that code (the inner product with the unit vector of the signs) and the length of what the code leaves over; the rest is
turned and coded again, in a few layers. An anchor is turned likewise and written in bit planes, so that its product with
a row's code is a sum of popcounts. By Cauchy and Schwarz, what the code leaves over adds at most its length times the
length of the anchor's part outside the code: each layer gives an interval that surely holds the score. A row whose interval
can't reach the best ones known in its cell, or the window of wanted scores, is left; the others are scored in whole numbers.
So results are exact, whatever the codes.

Anchors are a stated query set against all rows: both are dealt into blocks of bounded size, a task holds one block of each
and returns the few best per anchor, which are merged. First an anchor's positives are found, among rows of its label, then, for
the score of each, the negatives among rows of other labels.

Rows without vec_id, label or vector, or with a component that is null or not finite, take no part. A vector shorter than the longest
is continued by zeros. Components are cut to what keeps sums in 64 bits (for 64 dimensions 2 ** 28, that is values of a million).
Equal rows are folded into one with their number; each counts, as positive, negative and anchor, so that results of repeated
anchors repeat. Ties go by vec_id. Other columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import written

POSITIVES = 5
NEGATIVES = 3
#: Negatives score between these hundredths of a positive's score.
LEAST_SHARE, MOST_SHARE = 50, 95
SCALE = 256
LAYERS = 3
PLANES = 8
#: Rows and anchors of a cell, and anchors compared at once.
BLOCK = 16_384
TOGETHER = 64
#: Pairs scored at once.
SCORED = 32_768
_SEED = 1729
#: Share by which intervals are widened for rounding.
_ROUNDING = 1e-9

CODED = "vec_id long, label long, vector binary, mark binary, codes binary, sides binary"

_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dims: int, layer: int) -> np.ndarray:
    """A fixed random rotation."""
    if (dims, layer) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng((_SEED, dims, layer)).normal(size=(dims, dims)))
        _rotations[dims, layer] = q * np.sign(np.diag(r))
    return _rotations[dims, layer]


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into 64-bit words."""
    width = -(-bits.shape[1] // 64) * 64
    padded = np.zeros((len(bits), width), np.uint8)
    padded[:, :bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of each layer, (rows, layers, words), and alignment and length of the rest, (rows, layers, 2)."""
    n, dims = vectors.shape
    codes = np.zeros((n, LAYERS, -(-dims // 64)), np.uint64)
    sides = np.zeros((n, LAYERS, 2))
    rest = vectors.astype(np.float64)
    for layer in range(LAYERS):
        turned = rest @ rotation(dims, layer).T
        signs = turned >= 0
        codes[:, layer] = words(signs)
        unit = np.where(signs, 1.0, -1.0) / math.sqrt(dims)
        aligned = (turned * unit).sum(axis=1)
        rest = turned - aligned[:, None] * unit
        sides[:, layer, 0], sides[:, layer, 1] = aligned, np.sqrt((rest**2).sum(axis=1))
    return codes, sides


class Planes:
    """Anchors turned as each layer's code is, in bit planes."""

    def __init__(self, vectors: np.ndarray) -> None:
        n, self.dims = vectors.shape
        turned = vectors.astype(np.float64)
        self.norm2 = (turned**2).sum(axis=1)
        self.planes, self.low, self.step, self.total, self.error = [], [], [], [], []
        for layer in range(LAYERS):
            turned = turned @ rotation(self.dims, layer).T
            low = turned.min(axis=1)
            step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-300)
            level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
            rounded = low[:, None] + level * step[:, None]
            self.planes.append(np.stack([words(level >> k & 1) for k in range(PLANES)]))
            self.low.append(low)
            self.step.append(step)
            self.total.append(rounded.sum(axis=1))
            self.error.append(np.sqrt(((turned - rounded) ** 2).sum(axis=1)))

    def along(self, layer: int, anchors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Product of the rounded anchors with the unit vectors of codes, from popcounts; shapes are broadcast."""
        level, ones = 0, 0
        for w in range(codes.shape[-1]):
            ones = ones + np.bitwise_count(codes[..., w]).astype(np.int32)
            for k in range(PLANES):
                level = level + (np.bitwise_count(self.planes[layer][k][anchors, w] & codes[..., w]).astype(np.int32) << k)
        plus = self.low[layer][anchors] * ones + self.step[layer][anchors] * level
        return (2 * plus - self.total[layer][anchors]) / math.sqrt(self.dims)


class Rows:
    """Rows of a block, with their codes unless they are anchors."""

    def __init__(self, table: pa.Table) -> None:
        self.n = n = table.num_rows
        self.vec_id, self.label = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        self.vector = _matrix(table.column("vector"), np.int64, n)
        self.mark = np.array(table.column("mark").to_pylist(), object)
        if "codes" not in table.column_names:
            return
        self.times = table.column("times").to_numpy()
        self.codes = _matrix(table.column("codes"), np.uint64, n).reshape(n, LAYERS, -1 if n else 1)
        self.sides = _matrix(table.column("sides"), np.float64, n).reshape(n, LAYERS, 2)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _matrix(column: pa.ChunkedArray, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1 if n else 0)


def scores(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Products in whole numbers of pairs of rows of two matrices."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), SCORED):
        some = slice(at, at + SCORED)
        out[some] = np.einsum("ij,ij->i", anchors[a[some]], rows[r[some]])
    return out


def survivors(planes: Planes, anchors: np.ndarray, rows: Rows, kept: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, as positions in `anchors` and in `kept`, that no layer's interval excludes.

    `keep` takes the pairs and their lower and upper bounds, and says which of them may still count.
    """
    a, r = (x.ravel() for x in np.meshgrid(np.arange(len(anchors)), np.arange(len(kept)), indexing="ij"))
    estimate = slack = 0.0
    for layer in range(LAYERS):
        if layer:
            along = planes.along(layer, anchors[a], rows.codes[kept[r], layer])
        else:
            along = planes.along(0, anchors[:, None], rows.codes[kept, 0][None]).ravel()
        error, norm2 = planes.error[layer][anchors[a]], planes.norm2[anchors[a]]
        aligned, rest = rows.sides[kept[r], layer].T
        estimate, slack = estimate + aligned * along, slack + aligned * error
        across = np.sqrt(np.maximum(norm2 - np.maximum(np.abs(along) - error, 0) ** 2, 0))
        wide = slack + rest * across
        wide = wide + _ROUNDING * (1 + np.abs(estimate) + wide + np.sqrt(norm2) * rows.sides[kept[r], 0].sum(axis=1))
        good = keep(a, estimate - wide, estimate + wide)
        a, r, estimate, slack = a[good], r[good], estimate[good], slack[good]
        if not len(a):
            break
    return a, r


def nth_largest(groups: np.ndarray, values: np.ndarray, n: int, count: int) -> np.ndarray:
    """Per group, which come in order, the n-th largest value; minus infinity where there are fewer."""
    out = np.full(count, -np.inf)
    bounds = np.searchsorted(groups, np.arange(count + 1))
    for k, (start, end) in enumerate(zip(bounds, bounds[1:])):
        if end - start >= n:
            out[k] = np.partition(values[start:end], end - start - n)[end - start - n]
    return out


def best_of_label(anchors: Rows, rows: Rows) -> Iterator[tuple]:
    """anchor position, row position and score of an anchor's best rows of its label, itself among them."""
    wanted = POSITIVES + 1
    if not anchors.n or not rows.n:
        return
    planes = Planes(anchors.vector)
    for label in np.unique(anchors.label):
        mine, kept = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        times = np.minimum(rows.times[kept], wanted)
        for at in range(0, len(mine) if len(kept) else 0, TOGETHER):
            some = mine[at:at + TOGETHER]

            def keep(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                return high >= nth_largest(a, low, wanted, len(some))[a]

            a, r = survivors(planes, some, rows, kept, keep)
            exact = scores(anchors.vector, rows.vector, some[a], kept[r])
            for k, row, score in firsts(a, rows.vec_id[kept[r]], exact, times[r], r, wanted):
                yield some[k], kept[row], score


def firsts(groups: np.ndarray, ids: np.ndarray, exact: np.ndarray, times: np.ndarray, rows: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """Group, row and score of the first rows of each group, until n with their repetitions."""
    order = np.lexsort((ids, -exact, groups))
    groups, exact, times, rows = groups[order], exact[order], times[order], rows[order]
    before = np.cumsum(times) - times
    if len(groups):
        begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        taken = before - np.repeat(before[begins], np.diff(np.append(begins, len(groups)))) < n
        yield from zip(groups[taken].tolist(), rows[taken].tolist(), exact[taken].tolist())


def best_in_windows(anchors: Rows, lows: list[np.ndarray], highs: list[np.ndarray], rows: Rows) -> Iterator[tuple]:
    """anchor position, window, row position and score of the best rows of other labels whose scores lie in each window."""
    if not anchors.n or not rows.n:
        return
    planes = Planes(anchors.vector)
    kept = np.arange(rows.n)
    times = np.minimum(rows.times, NEGATIVES)
    for at in range(0, anchors.n, TOGETHER):
        some = np.arange(at, min(at + TOGETHER, anchors.n))
        most = max(len(lows[k]) for k in some)
        low_, high_ = np.full((len(some), most), np.inf), np.full((len(some), most), -np.inf)
        for k, anchor in enumerate(some):
            low_[k, :len(lows[anchor])], high_[k, :len(lows[anchor])] = lows[anchor], highs[anchor]
        other = (anchors.label[some][:, None] != rows.label[None]).ravel()

        def keep(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            nonlocal other
            good = np.zeros(len(a), bool)
            for w in range(most):
                from_, to = low_[a, w], high_[a, w]
                inside = other & (low >= from_) & (high <= to)
                floor = nth_largest(a[inside], low[inside], NEGATIVES, len(some))
                good |= other & (high >= np.maximum(from_, floor[a])) & (low <= to)
            other = other[good]
            return good

        a, r = survivors(planes, some, rows, kept, keep)
        exact = scores(anchors.vector, rows.vector, some[a], r)
        for w in range(most):
            fits = (exact >= low_[a, w]) & (exact <= high_[a, w])
            for k, row, score in firsts(a[fits], rows.vec_id[r[fits]], exact[fits], times[r[fits]], r[fits], NEGATIVES):
                yield some[k], w, row, score


def code_rows(embeddings: DataFrame, dims: int) -> DataFrame:
    """Whole-number vectors with their codes; equal rows folded, `times` says how many they were."""
    limit = math.isqrt(2**62 // dims)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            vectors = np.zeros((batch.num_rows, dims))
            vectors[np.arange(dims) < sizes[:, None]] = flat
            vectors = np.clip(np.floor(SCALE * vectors), -limit, limit).astype(np.int64)
            codes, sides = coded(vectors)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), _binary(vectors),
                pa.array([blake2b(v.tobytes(), digest_size=16).digest() for v in vectors], pa.binary()), _binary(codes), _binary(sides)],
                ["vec_id", "label", "vector", "mark", "codes", "sides"])

    rows = whole_rows(embeddings).mapInArrow(run, CODED)
    firsts_ = [F.first(c).alias(c) for c in ("codes", "sides")]
    return rows.groupBy("vec_id", "label", "mark", "vector").agg(F.count("*").alias("times"), *firsts_)


def whole_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(~broken)


def _cells(anchors: DataFrame, rows: DataFrame, row_blocks: int, anchor_blocks: int):
    """Anchors and rows dealt into cells of a block of each; a cell without anchors or rows gives nothing."""
    by = F.pmod(F.xxhash64("vec_id", "label", "mark"), F.lit(row_blocks)).cast("int")
    rows = rows.withColumn("row_block", by).withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    by = F.pmod(F.xxhash64("mark", "label", "vec_id"), F.lit(anchor_blocks)).cast("int")
    # Named anew, as both sides come from one table.
    anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns if c not in ("codes", "sides", "times")))
    anchors = anchors.withColumn("anchor_block", by).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    return anchors.groupBy("row_block", "anchor_block").cogroup(rows.groupBy("row_block", "anchor_block"))


def mine(embeddings: DataFrame, is_anchor) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `is_anchor` is a condition on vec_id. Of each anchor's first positives (other rows of its label, by score) every one gets the first
    rows of other labels that score between half and 95 hundredths of its score.
    """
    spark = embeddings.sparkSession
    dims = max(whole_rows(embeddings).agg(F.max(F.size("vector"))).first()[0] or 1, 1)
    rows = written(spark, code_rows(embeddings, dims), "negatives-rows")
    anchors = rows.filter(is_anchor)
    row_blocks, anchor_blocks = max(-(-rows.count() // BLOCK), 1), max(-(-anchors.count() // BLOCK), 1)
    key = ["anchor_id", "anchor_label", "anchor_mark"]

    def first_pass(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, r = Rows(anchors), Rows(rows)
        found = list(best_of_label(a, r))
        k, row, score = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        same = (a.vec_id[k] == r.vec_id[row]) & np.array([x == y for x, y in zip(a.mark[k], r.mark[row])], bool)
        return pa.table([a.vec_id[k], a.label[k], pa.array(a.mark[k], pa.binary()), r.vec_id[row], score, np.minimum(r.times[row], POSITIVES + 1), same],
                        ["anchor_id", "anchor_label", "anchor_mark", "positive_id", "positive_score", "times", "same"])

    best = _cells(anchors, rows, row_blocks, anchor_blocks).applyInArrow(
        first_pass, "anchor_id long, anchor_label long, anchor_mark binary, positive_id long, positive_score long, times long, same boolean")
    # Of the anchor itself one copy is no other row.
    best = best.withColumn("times", F.col("times") - F.col("same").cast("long")).filter("times > 0")
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    order = Window.partitionBy(*key).orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= POSITIVES)
    positives = written(spark, best.select(*key, "positive_id", "positive_score", "place"), "negatives-positives")

    windows = positives.groupBy(*key).agg(F.sort_array(F.collect_set("positive_score")).alias("wanted"))
    wanted = anchors.join(windows.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_label").alias("label"), F.col("anchor_mark").alias("mark"), "wanted"),
                          ["vec_id", "label", "mark"])

    def second_pass(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, r = Rows(anchors), Rows(rows)
        wanted = [np.array(x, np.int64) for x in anchors.column("wanted").to_pylist()]
        lows, highs = [-(-LEAST_SHARE * w // 100) for w in wanted], [MOST_SHARE * w // 100 for w in wanted]
        found = list(best_in_windows(a, lows, highs, r))
        k, w, row, score = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        of = np.array([wanted[i][j] for i, j in zip(k, w)], np.int64)
        return pa.table([a.vec_id[k], a.label[k], pa.array(a.mark[k], pa.binary()), of, r.vec_id[row], score, np.minimum(r.times[row], NEGATIVES)],
                        ["anchor_id", "anchor_label", "anchor_mark", "positive_score", "negative_id", "negative_score", "times"])

    found = _cells(wanted, rows, row_blocks, anchor_blocks).applyInArrow(
        second_pass, "anchor_id long, anchor_label long, anchor_mark binary, positive_score long, negative_id long, negative_score long, times long")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    order = Window.partitionBy(*key, "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    found = found.select(*key, "positive_score", "rank", "negative_id", "negative_score")
    # A repeated anchor gives its results once per copy.
    copies = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("mark").alias("anchor_mark"), "times")
    result = positives.join(found, [*key, "positive_score"]).join(copies, key)
    result = result.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return result.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
