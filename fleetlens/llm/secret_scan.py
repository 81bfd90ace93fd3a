"""Secrets by character Markov models of random strings and of ordinary identifiers.

Base rules find assigned passwords and tokens, access keys and long hex strings; these spans always stay. The values that
they find are the labelled samples of random strings; the other words of all documents are the samples of ordinary
identifiers. For both a first-order Markov model over characters is trained, as a table of pair counts that
tasks add up. Every further run of identifier characters is compared by its log-likelihood ratio, and runs that are
clearly random are added as spans of the kind `random`.

Spans are in code points, end exclusive. Null text is read as empty and has no span. Without base spans there is no sample
of random strings, and nothing is added. Each row gives a row, repeated ones and ones without doc_id too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import plain_texts, slices, utf8, written

KINDS = ("assign", "access", "hex", "random")
#: Shortest run that is compared, and what its log-likelihood ratio must reach, in all and by character.
LEAST_RUN = 12
LEAST_RATIO = 12.0
LEAST_RATIO_BY_CHARACTER = 0.6
#: Words from this length on are samples of ordinary identifiers.
LEAST_WORD = 4

ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
# Words by one of which an assignment starts, in lower case.
_NAMES = ("passw", "secret", "token", "api_key", "apikey")

# Characters of the models: letters, digits, + / _ = -, and one for both ends.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(_ALPHABET) + 1
_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i + 1
_HEX_BYTE = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def _runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of marked bytes; runs end with their row."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(inside))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the base rules, by start, then kind."""
    found = []
    lower = text.lower()
    if any(n in lower for n in _NAMES):
        found += [(m.start(), m.end(), 0, m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m.group()) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def pair_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each character follows each other one in the given stretches, with their ends as a state."""
    if not len(starts):
        return np.zeros((STATES, STATES), np.int64)
    lengths = ends - starts
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    codes = np.zeros(len(at) + len(starts) + 1, np.int64)
    codes[np.arange(len(at)) + np.repeat(np.arange(len(starts)), lengths) + 1] = _CODE[data[at]]
    return np.bincount(codes[:-1] * STATES + codes[1:], minlength=STATES**2).reshape(STATES, STATES)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the next character; every pair is imagined half a time more."""
    smooth = counts + 0.5
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans with their values, and the other long runs, of each row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.string())]))
    for piece in slices(batches):
        data, bounds = utf8(piece.column("text"))
        marked = np.zeros(piece.num_rows, bool)
        if len(data):
            for inside, least in ((_CODE[data] > 0, LEAST_RUN), (_HEX_BYTE[data], 32)):
                starts, ends = _runs(inside, bounds)
                marked[np.searchsorted(bounds, starts[ends - starts >= least], "right") - 1] = True
        base, runs = [], []
        for text, long_run in zip(piece.column("text").to_pylist(), marked):
            lower = text.lower()
            if not long_run and not any(n in lower for n in _NAMES):
                base.append([])
                runs.append([])
                continue
            own = base_spans(text)
            base.append([dict(start=a, end=b, kind=k, value=v) for a, b, k, v in own])
            free = []
            at = 0
            reach = 0
            for m in RUN.finditer(text):
                while at < len(own) and own[at][0] < m.end():
                    reach = max(reach, own[at][1])
                    at += 1
                if reach <= m.start():
                    free.append(dict(start=m.start(), end=m.end(), kind=3, value=m.group()))
            runs.append(free)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(base, kind), pa.array(runs, kind)], ["doc_id", "base", "runs"])


def _summed(frame: DataFrame) -> np.ndarray:
    """Sum of the count tables (packed in `counts`) that tasks have made; each is of one fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist()), np.zeros(STATES**2, np.int64))
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    halves = frame.withColumn("part", (F.spark_partition_id() % 64).cast("int")).select("part", "counts").groupBy("part").applyInArrow(add, schema)
    rows = halves.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(add, schema).collect()
    return np.frombuffer(rows[0]["counts"], np.int64).reshape(STATES, STATES) if rows else np.zeros((STATES, STATES), np.int64)


def _ordinary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts of all runs of identifier characters, base spans included."""
    total = np.zeros((STATES, STATES), np.int64)
    for piece in slices(batches):
        data, bounds = utf8(piece.column("text"))
        if len(data):
            starts, ends = _runs(_CODE[data] > 0, bounds)
            long_ = ends - starts >= LEAST_WORD
            total += pair_counts(data, starts[long_], ends[long_])
    yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})


def _random(least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pair counts of the values that base rules have found, from `least` characters on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((STATES, STATES), np.int64)
        for batch in batches:
            values = [v for row in batch.column("values").to_pylist() for v in re.findall(r"[A-Za-z0-9+/_=-]+", " ".join(row)) if len(v) >= least]
            data, bounds = utf8(pa.array(values, pa.string()))
            total += pair_counts(data, bounds[:-1], bounds[1:])
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    return run


def ratios(values: list[str], model: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each value, from the difference of the two log models."""
    data, bounds = utf8(pa.array(values, pa.string()))
    if not len(data):
        return np.zeros(len(values))
    codes = _CODE[data]
    before = np.concatenate([[0], codes[:-1]])
    before[bounds[:-1][bounds[:-1] < len(codes)]] = 0
    steps = np.concatenate([[0.0], np.cumsum(model[before, codes])])
    return steps[bounds[1:]] - steps[bounds[:-1]] + model[codes[bounds[1:] - 1], 0]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, and base and all spans, a row per row of `docs`."""
    texts = plain_texts(docs)
    span = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"
    found = written(docs.sparkSession, texts.mapInArrow(_scan, f"doc_id long, base {span}, runs {span}"), "secret-spans")
    random = _summed(found.filter(F.size("base") > 0).select(F.transform("base", lambda s: s["value"]).alias("values")).mapInArrow(_random(8), "counts binary"))
    ordinary = _summed(texts.select("text").mapInArrow(_ordinary, "counts binary"))
    known = random.sum() > 0
    model = log_model(random) - log_model(np.maximum(ordinary - random, 0))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, counts = [], np.zeros((batch.num_rows, 3), np.int64)
            more = []
            for i, (base, runs) in enumerate(zip(batch.column("base").to_pylist(), batch.column("runs").to_pylist())):
                for s in base:
                    counts[i, s["kind"]] += 1
                if runs and known:
                    ratio = ratios([r["value"] for r in runs], model)
                    runs = [r for r, x in zip(runs, ratio) if x >= LEAST_RATIO and x >= LEAST_RATIO_BY_CHARACTER * len(r["value"])]
                else:
                    runs = []
                spell = lambda spans: ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans)
                lines.append(spell(base))
                more.append(spell(sorted(base + runs, key=lambda s: (s["start"], s["kind"]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(lines, pa.string()), pa.array(more, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    judged = found.mapInArrow(judge, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")
    return judged.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
