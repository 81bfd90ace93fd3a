"""Document quality by a Gaussian kernel over document statistics.

Each text gets a fixed list of statistics. Random Fourier features of the standardised statistics approximate a Gaussian
kernel. Tasks sum their part of the normal equations (one fixed-size table each), the sums are added, and ridge weights
follow from one small linear system. Isotonic regression on a part of the training rows that the ridge weights haven't
seen turns the raw score into a probability.

Null text is read as empty; empty texts have all statistics 0 and a score like any other. Without labels every score is
0.5. Of several labels of a document the largest counts; labels without doc_id are left out. Each row gives a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import fold, grams, plain_texts, running_sums, slices, span_hashes, utf8, words, written

FEATURES = 256
#: Width of the kernel, in standard deviations times the root of the number of statistics.
WIDTH = 0.7
RIDGE = 1.0
#: Bins of the raw score in which calibration counts are added up.
BINS = 2_048
THRESHOLD = 0.3
STATISTICS = (
    "bytes", "words", "mean_word", "spread_word", "upper", "digit", "space", "beyond_ascii", "stops", "marks", "symbols", "bars", "short_words",
    "distinct_words", "distinct_grams", "lines", "distinct_lines", "sentence_words", "shout_words", "marked_words",
)
_BYTE = np.arange(256)
_MASKS = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90), "digit": (_BYTE >= 48) & (_BYTE <= 57), "space": np.isin(_BYTE, [9, 10, 13, 32]), "beyond_ascii": _BYTE >= 128,
    "stops": np.isin(_BYTE, list(b".?!")), "marks": np.isin(_BYTE, list(b",;:'\"()-")), "symbols": np.isin(_BYTE, list(b"#$%&*@^~=+<>\\/_`")),
    "bars": np.isin(_BYTE, list(b"|{}[]")),
}
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)


def _distinct(hashes: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Number of distinct hashes of each row."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=count)


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    count = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    out = np.zeros((count, len(STATISTICS)))
    put = lambda name, value: out.__setitem__((slice(None), STATISTICS.index(name)), value)
    if not len(data):
        return out

    def summed(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    some = np.maximum(size, 1)
    put("bytes", np.log1p(size))
    sums = {name: summed(mask[data]) for name, mask in _MASKS.items()}
    for name, value in sums.items():
        put(name, value / some)
    starts, ends, hashes, rows = words(data, bounds)
    n = np.bincount(rows, minlength=count).astype(float)
    many = np.maximum(n, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(rows, length, count) / many
    put("words", np.log1p(n))
    put("mean_word", mean)
    put("spread_word", np.sqrt(np.maximum(np.bincount(rows, length**2, count) / many - mean**2, 0)))
    put("short_words", np.bincount(rows, length <= 2, count) / many)
    put("distinct_words", _distinct(hashes, rows, count) / many)
    gram, gram_row, _ = grams(hashes, rows, 3)
    put("distinct_grams", _distinct(gram, gram_row, count) / np.maximum(np.bincount(gram_row, minlength=count), 1))
    put("sentence_words", np.log1p(n / (sums["stops"] + 1)))
    upper, lower = np.concatenate([[0], np.cumsum(_MASKS["upper"][data])]), np.concatenate([[0], np.cumsum(_LOWER[data])])
    shout = (length > 1) & (upper[ends] > upper[starts]) & (lower[ends] == lower[starts])
    put("shout_words", np.bincount(rows, shout, count) / many)
    after = np.append(data, 32)[ends]
    odd = ~(_MASKS["space"][after] | np.isin(after, list(b".,;:?!'\"()-")))
    put("marked_words", np.bincount(rows, odd & (ends < bounds[1:][rows]), count) / many)
    # Lines: what lies between line ends, and between rows.
    cut = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
    cut = cut[cut < len(data)]
    line_end = np.append(cut[1:], len(data))
    line_row = np.searchsorted(bounds, cut, "right") - 1
    lines = np.maximum(np.bincount(line_row, minlength=count), 1)
    put("lines", np.log1p(lines))
    put("distinct_lines", _distinct(span_hashes(running_sums(data), cut, line_end), line_row, count) / lines)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            x = statistics(*utf8(piece.column("text")))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)], ["doc_id", "x"])

    return plain_texts(docs).mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


class Kernel:
    """Random Fourier features of a Gaussian kernel over standardised statistics."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        random = np.random.default_rng(17)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.direction = random.normal(size=(len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)))
        self.phase = random.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.direction + self.phase), np.ones((len(x), 1))])


def normal_equations(train: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over (x, label): added up inside tasks, then in two rounds, row by row of the matrix."""
    width = FEATURES + 1

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                z = kernel(_matrix(batch.column("x")))
                total += z.T @ np.hstack([z, batch.column("label").to_numpy()[:, None]])
        if total.any():
            yield pa.RecordBatch.from_pydict({"line": np.arange(width, dtype=np.int32), "sums": pa.array([t.tobytes() for t in total], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b) for b in table.column("sums").to_pylist()], axis=0)
        return pa.table({"line": table.column("line")[:1], "part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "line int, part int, sums binary"
    parts = train.select("x", "label").mapInArrow(partial, "line int, sums binary").select("line", (F.spark_partition_id() % 32).cast("int").alias("part"), "sums")
    halves = parts.groupBy("line", "part").applyInArrow(add, schema)
    rows = halves.withColumn("part", F.lit(0)).groupBy("line", "part").applyInArrow(add, schema).collect()
    total = np.zeros((width, width + 1))
    for r in rows:
        total[r["line"]] = np.frombuffer(r["sums"])
    return total[:, :-1], total[:, -1]


def isotonic(place: np.ndarray, rows: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins: centres of the pools and their share of good rows, which doesn't fall."""
    pools: list[list[float]] = []
    for p, n, g in zip(place, rows, good):
        pools.append([p * n, n, g])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better), predicted (1 from THRESHOLD on), a row per row of `docs`."""
    spark = docs.sparkSession
    table = written(spark, measured(docs), "quality-statistics")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("label"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    train = written(spark, table.join(own, "doc_id"), "quality-train")
    calibrate = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    moments = train.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")).collect()
    model: tuple[Kernel, np.ndarray, np.ndarray, np.ndarray] | None = None
    if moments:
        moments.sort(key=lambda r: r["k"])
        kernel = Kernel(np.array([r["mean"] for r in moments]), np.array([r["spread"] for r in moments]))
        square, target = normal_equations(train.filter(~calibrate), kernel)
        weights = np.linalg.solve(square + RIDGE * np.eye(len(target)), target)

        def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = kernel(_matrix(batch.column("x"))) @ weights
                yield pa.RecordBatch.from_arrays([pa.array(_bin(raw)), batch.column("label")], ["bin", "label"])

        held = train.filter(calibrate).select("x", "label").mapInArrow(binned, "bin int, label double")
        bins = held.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
        bins.sort(key=lambda r: r["bin"])
        if bins:
            at, share = isotonic(np.array([r["bin"] for r in bins], float), np.array([r["n"] for r in bins], float), np.array([r["good"] for r in bins]))
        else:
            at, share = np.array([0.0, BINS - 1]), np.array([0.0, 1.0])
        model = (kernel, weights, at, share)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                kernel, weights, at, share = model
                value = np.interp(_place(kernel(_matrix(batch.column("x"))) @ weights), at, share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(value, 0.0, 1.0))], ["doc_id", "score"])

    scored = table.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def _place(raw: np.ndarray) -> np.ndarray:
    """Where raw scores, mostly between 0 and 1, lie on the scale of the bins."""
    return np.clip((raw + 0.5) / 2, 0, 1) * (BINS - 1)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.rint(_place(raw)).astype(np.int32)
