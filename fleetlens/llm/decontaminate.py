"""Benchmark decontamination: word n-gram seeds find passages, Smith-Waterman alignment scores them.

All word n-grams of a test item are its seeds, so a copy is found as long as `n` words in a row are left of it. Where a seed
occurs in a document, the words around it are aligned with the item: matches count 2, a
different, missing or additional word -1. The score is the best local alignment as a share of a full match, so edited and
paraphrased copies score by what is left of the item. Common seeds lead to many passages; those with too few words of
the item to reach the least score are passed over before they are aligned, which loses none.

The test items are held by every task; they are taken in blocks of `block` items, one after another, so what the driver holds and
sends out stays bounded however many there are; each block reads the documents once. Documents are read where they lie and never shuffled.

Null and empty texts or items match nothing. An item of fewer than `n` words has a single seed, all its words, and
is found only in documents that consist of them. Items with equal ids are taken as one item per distinct text.
A repeated document row gives its matches again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import HashTable, grams, plain_texts, run_starts, slices, utf8, words, written

SEED_WORDS = 3
#: Share of a full match from which a passage counts as a copy of the item.
LEAST_SCORE = 0.5
#: Items sent to the tasks at once.
BLOCK = 20_000
#: Pairs of a seed's place and an item looked at together, or those of a single document.
LINES = 1 << 20
MATCH, OTHER = 2, 1


@dataclass(frozen=True)
class Items:
    """A block of test items: ids, word hashes, and each n-gram with the items and places where it stands."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray


def read_items(rows: list[tuple[int, str]], n: int) -> Items:
    data, bounds = utf8(pa.array([t for _, t in rows], pa.string()))
    _, _, hashes, row = words(data, bounds)
    seeds, item, at = grams(hashes, row, n)
    begins = np.searchsorted(row, np.arange(len(rows)))
    ends = np.searchsorted(row, np.arange(len(rows)), "right")
    return Items([i for i, _ in rows], [hashes[b:e] for b, e in zip(begins, ends)], seeds, item, at - begins[item])


def align(passages: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of the item in each row of `passages`, and the word after its end."""
    m, width = passages.shape
    above = np.zeros((m, width + 1), np.int32)
    best, end = np.zeros(m, np.int32), np.zeros(m, np.int64)
    slope = OTHER * np.arange(width + 1, dtype=np.int32)
    for word in item:
        row = above - OTHER
        row[:, 1:] = np.maximum(row[:, 1:], above[:, :-1] + np.where(passages == word, MATCH, -OTHER))
        np.maximum(row, 0, out=row)
        # A gap along the passage: the best earlier cell less its distance, as a running maximum.
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        at = row.argmax(axis=1)
        high = row[np.arange(m), at]
        better = high > best
        best[better], end[better] = high[better], at[better]
        above = row
    return best, end


def _passages(hits: np.ndarray, lead: np.ndarray, length: int, begin: int, stop: int) -> list[tuple[int, int]]:
    """Stretches of words around the hits that could hold the item, overlapping ones joined."""
    pad = length // 2
    low = np.sort(np.maximum(hits - lead - pad, begin))
    out: list[tuple[int, int]] = []
    for a in low.tolist():
        b = min(a + length + 2 * pad + 1, stop)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _matches(texts: DataFrame, items: Items, n: int, least: float) -> DataFrame:
    seeds, owner, place = items.seeds, items.item, items.place
    distinct, of_seed = np.unique(seeds, return_inverse=True)
    order = np.argsort(of_seed, kind="stable")
    begin_of = np.searchsorted(of_seed[order], np.arange(len(distinct) + 1))

    def scored(hashes: np.ndarray, row: np.ndarray, gram_row: np.ndarray, at: np.ndarray, seed: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int]]:
        """The best passage of each (document, item) that reaches the least score, from the seeds found in some documents."""
        # A seed may stand in several items: one line for each.
        times = begin_of[seed + 1] - begin_of[seed]
        line = np.repeat(np.arange(len(seed)), times)
        entry = order[np.repeat(begin_of[seed], times) + np.arange(len(line)) - np.repeat(np.cumsum(times) - times, times)]
        key = gram_row[line] * len(items.ids) + owner[entry]
        by = np.argsort(key, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[by])) + 1, [len(by)]])
        # Passages of like width of the same item are aligned together.
        waiting: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for a, b in zip(cuts, cuts[1:]):
            group = by[a:b]
            document, k = divmod(int(key[group[0]]), len(items.ids))
            lo, hi = np.searchsorted(row, document), np.searchsorted(row, document, "right")
            for low, high in _passages(at[line[group]], place[entry[group]], len(items.words[k]), int(lo), int(hi)):
                waiting[(k, (high - low - 1).bit_length())].append((document, low, high))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for (k, _), found in waiting.items():
            item = items.words[k]
            for part in range(0, len(found), 256):
                some = found[part:part + 256]
                width = max(high - low for _, low, high in some)
                matrix = np.zeros((len(some), width), np.uint64)
                for i, (_, low, high) in enumerate(some):
                    matrix[i, :high - low] = hashes[low:high]
                # Every match takes a word of the item: fewer than these can't reach the least score.
                enough = np.flatnonzero(np.isin(matrix, item).sum(axis=1) * MATCH >= least * MATCH * len(item))
                if not len(enough):
                    continue
                some, matrix = [some[i] for i in enough], matrix[enough]
                score, end = align(matrix, item)
                for i in np.flatnonzero(score >= least * MATCH * len(item)):
                    document, low, _ = some[i]
                    # Aligned backwards from its end, the passage shows its start.
                    back, start = align(matrix[i:i + 1, :end[i]][:, ::-1], item[::-1])
                    share = float(score[i]) / (MATCH * len(item))
                    mine = (share, low + int(end[i] - start[0]), low + int(end[i]) - 1)
                    if (document, k) not in best or mine > best[(document, k)]:
                        best[(document, k)] = mine
        return best

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable(distinct)
        for piece in slices(batches):
            _, _, hashes, row = words(*utf8(piece.column("text")))
            gram, gram_row, at = grams(hashes, row, n)
            hit, seed = table.hits(gram)
            if not len(hit):
                continue
            found = gram_row[hit]
            # Documents are taken together up to LINES lines.
            begins = run_starts(found)
            sizes = np.add.reduceat(begin_of[seed + 1] - begin_of[seed], begins)
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            first = 0
            while first < len(begins):
                last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), LINES, "right")) + first)
                a, b = begins[first], begins[last] if last < len(begins) else len(hit)
                best |= scored(hashes, row, found[a:b], at[hit[a:b]], seed[a:b])
                first = last
            if best:
                ids = piece.column("doc_id")
                lines = sorted(best.items())
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([d for (d, _), _ in lines])), pa.array([items.ids[k] for (_, k), _ in lines], pa.int64()),
                    pa.array([v[0] for _, v in lines]),
                    pa.array([int(v[1] - np.searchsorted(row, d)) for (d, _), v in lines], pa.int64()),
                    pa.array([int(v[2] - np.searchsorted(row, d)) + 1 for (d, _), v in lines], pa.int64()),
                ], ["doc_id", "item_id", "score", "first_word", "end_word"])

    return texts.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")


def find(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, least: float = LEAST_SCORE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: each document with a copy of a test item, and its best passage."""
    texts = plain_texts(docs)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    blocks = max(-(-rows.count() // block), 1)
    result: DataFrame | None = None
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        items = read_items([(r["item_id"], r["text"]) for r in part], n)
        found = _matches(texts, items, n, least)
        if blocks > 1:
            # Written before the next block is read, so the driver never holds more than one.
            found = written(docs.sparkSession, found, "leaks")
            del items
        result = found if result is None else result.union(found)
    assert result is not None
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no copy of a test item; rows without doc_id as well are judged by their own text.

    Columns of any name stay as they are.
    """
    # Made from doc_id and text and never null, so a match removes its own row and equal ones.
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    leaks = find(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(leaks, key, "left_anti").drop(key)
