"""Helpers shared by the text operators: Arrow text buffers, word hashes, scratch tables.

Words are maximal runs of ASCII letters and digits and of bytes above 127; ASCII letters are folded to lower
case. All hashes are 64 bits wide and depend on nothing but the bytes, so any task computes the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import scratch_path

#: Text handled at once inside a task; bounds the working arrays, which take about 50 bytes per byte of text.
SLICE_BYTES = 1 << 20

_SEED = 20240229
_random = np.random.default_rng(_SEED)
_BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_FOLD = np.zeros(256, np.uint8)
for _code in range(256):
    _char = chr(_code)
    if _code > 127:
        _FOLD[_code] = _code
    elif _char.isalnum():
        _FOLD[_code] = ord(_char.lower())

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def plain_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text read as empty; other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def written(spark: SparkSession, frame: DataFrame, label: str) -> DataFrame:
    """`frame` written to the shared scratch folder and read back, which cuts its lineage."""
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each row starts and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    bytes_ = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]
    return bytes_, bounds - bounds[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text or a single row; whole texts, all rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = utf8(batch.column(batch.schema.get_field_index(text)).fill_null(""))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, 0 to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 2 * len(_powers))
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _STEP, np.uint64), dtype=np.uint64)])
        _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _STEP_INVERSE, np.uint64), dtype=np.uint64)])
    return _powers, _inverses


def running_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which `span_hashes` takes the hash of any span."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each span."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and row of each word."""
    folded = _FOLD[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = folded != 0
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= inside[1:-1][inner]
    last[inner - 1] |= inside[1:-1][inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(bounds, starts, "right") - 1
    return starts, ends, span_hashes(running_sums(folded), starts, ends), rows


def word_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: which words are longer, in code points, and the hash of their so many first ones."""
    folded = _FOLD[data]
    sums = running_sums(folded)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(heads, starts)
    for n in lengths:
        stop = np.append(heads, len(data))[np.minimum(first + n, len(heads))]
        longer = np.flatnonzero(stop < ends)
        # A prefix is told apart from a word of the same letters.
        yield longer, mixed(span_hashes(sums, starts[longer], stop[longer]))


def word_hash(word: str) -> int:
    """The hash that `words` gives to this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)]))[2][0])


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of each run of n words; a row of fewer words has one run of all its words."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = np.bincount(rows)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    size = len(hashes)
    at = np.arange(size)
    length = np.minimum(n, count[rows])
    keep = at + length <= (begin + count)[rows]
    at, length = at[keep], length[keep]
    out = hashes[at]
    for j in range(1, n):
        more = length > j
        if more.all():
            out = out * _STEP + hashes[at + j]
        else:
            out[more] = out[more] * _STEP + hashes[at[more] + j]
    return mixed(out), rows[at], at


def run_starts(sorted_rows: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_rows):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))


def text_map(frame: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`each` applied to slices of bounded text; a slice's result is one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            out = each(piece)
            if out is not None and out.num_rows:
                yield out

    return frame.mapInArrow(run, schema)


class HashTable:
    """Positions of 64-bit hashes in a fixed list, -1 for others; a bitmap settles most of the misses."""

    def __init__(self, hashes: np.ndarray, bits: int = 20) -> None:
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = np.asarray(hashes, np.uint64)[self.order]
        self.shift = np.uint64(64 - bits)
        self.marked = np.zeros(1 << bits, bool)
        self.marked[self.sorted >> self.shift] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into `hashes` that are in the list, and their places in it."""
        maybe = np.flatnonzero(self.marked[hashes >> self.shift])
        if not len(maybe) or not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        found = self.sorted[at] == hashes[maybe]
        return maybe[found], self.order[at[found]]


def bounded_labels(labels: DataFrame, label: str, keep: object, most: int) -> DataFrame:
    """(doc_id, label) of at most `most` labelled rows chosen by a hash of doc_id: small enough to broadcast.

    Rows without label or doc_id are left out; of several labels of a document the largest counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & keep)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fold(column: str, of: int) -> object:
    """crc32 of the decimal doc_id modulo `of`; 0 for a missing doc_id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % of, F.lit(0)).cast("int")


def key_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys of rows that come sorted by them; keys are whole numbers without nulls."""
    pending: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(int(c[start]) for c in columns)
            if pending and key != last:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(start, end - start))
            last = key
    if pending:
        yield pa.Table.from_batches(pending)


class Automaton:
    """Tokens that are suffixes of what was read, by Aho and Corasick's construction over the tokens' bytes."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.step: dict[int, int] = {}
        own: list[int | None] = [None]
        for token, data in tokens.items():
            state = 0
            for b in data:
                key = state << 8 | b
                after = self.step.get(key)
                if after is None:
                    after = self.step[key] = len(own)
                    own.append(None)
                state = after
            own[state] = token
        self.shorter = [0] * len(own)
        self.suffixes: list[tuple[int, ...]] = [()] * len(own)
        # Every state's prefix has a smaller depth, so states are completed in order of depth.
        level = [0]
        children: dict[int, list[tuple[int, int]]] = {}
        for key, after in self.step.items():
            children.setdefault(key >> 8, []).append((key & 255, after))
        while level:
            deeper = []
            for state in level:
                for b, after in children.get(state, ()):
                    if state:
                        self.shorter[after] = self.next(self.shorter[state], b)
                    rest = self.suffixes[self.shorter[after]]
                    self.suffixes[after] = rest if own[after] is None else (own[after], *rest)
                    deeper.append(after)
            level = deeper

    def next(self, state: int, b: int) -> int:
        """The state after one more byte."""
        while True:
            after = self.step.get(state << 8 | b)
            if after is not None:
                return after
            if not state:
                return 0
            state = self.shorter[state]


class Remembered:
    """Values of whole numbers, the last one for each place of a table of fixed size."""

    def __init__(self, work: Callable[[int], int], bits: int = 20) -> None:
        self.work, self.shift = work, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1)
        self.values = np.zeros(1 << bits, np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        out = self.values[at]
        new = np.flatnonzero(self.keys[at] != keys)
        if len(new):
            distinct, back = np.unique(keys[new], return_inverse=True)
            out[new] = np.array([self.work(k) for k in distinct.tolist()], np.int32)[back]
            self.keys[at[new]], self.values[at[new]] = keys[new], out[new]
        return out


class Prefixes:
    """Tokens of many sequences by a programme over their prefixes.

    `tokens` gives the bytes of each token, `fitting` says whether a token can follow the last token of a prefix, which is numbered
    from 1, or stand first (0), by a key of both. At most one token may fit for any prefix.
    """

    BITS = 24

    def __init__(self, tokens: dict[int, bytes], fitting: Callable[[int], int]) -> None:
        self.automaton = Automaton(tokens)
        self.fits = Remembered(fitting)
        self.steps = Remembered(lambda key: self.automaton.next(key >> 8, key & 255))
        self.sizes = np.ones(max(tokens) + 1, np.int64)
        self.sizes[list(tokens)] = [len(t) for t in tokens.values()]
        found = self.automaton.suffixes
        self.suffixes = np.array([t for s in found for t in reversed(s)], np.int64)
        self.ends = np.cumsum([len(s) for s in found])

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Tokens of sorted sequences as packed 32-bit values; all go on by a byte at a time, a shared prefix is settled once."""
        n, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        letters = np.zeros((n, width), np.uint8)
        letters[inside] = np.frombuffer(b"".join(words), np.uint8)
        shared = np.zeros(n, np.int64)
        shared[1:] = np.logical_and.accumulate((letters[1:] == letters[:-1]) & inside[1:] & inside[:-1], axis=1).sum(axis=1)
        last, state = np.full((n, width + 1), -1, np.int32), np.zeros(n, np.int64)
        for end in range(1, width + 1):
            alive = np.flatnonzero(sizes >= end)
            fresh = shared[alive] < end
            rows, node = alive[fresh], np.cumsum(fresh) - 1
            reached = self.steps(state[rows] << 8 | letters[rows, end - 1]).astype(np.int64)
            token, stop = np.full(len(rows), -1, np.int32), self.ends[reached]
            at = np.where(reached > 0, self.ends[reached - 1], 0)
            open_ = np.flatnonzero(at < stop)
            while len(open_):
                tried = self.suffixes[at[open_]]
                begin = end - self.sizes[tried]
                before = last[rows[open_], begin].astype(np.int64)
                # Inside a character no token ends, so nothing follows there.
                good = ((begin == 0) | (before >= 0)) & (self.fits(before + 1 << self.BITS | tried) > 0)
                token[open_[good]] = tried[good]
                at[open_] += 1
                open_ = open_[~good & (at[open_] < stop[open_])]
            last[alive, end], state[alive] = token[node], reached[node]
        tokens, count = np.zeros((n, width), np.uint32), np.zeros(n, np.int64)
        open_, at = np.arange(n), sizes.copy()
        while len(open_):
            token = last[open_, at[open_]]
            if (token < 0).any():
                raise ValueError("no token ends here")
            count[open_] += 1
            tokens[open_, width - count[open_]] = token
            at[open_] -= self.sizes[token]
            open_ = open_[at[open_] > 0]
        packed = tokens[np.arange(width) >= (width - count)[:, None]].tobytes()
        bounds = (4 * np.cumsum([0, *count])).tolist()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:])]
