"""Similarity join of documents on their sets of word n-grams, by MinHash banding.

Two documents are linked if the Jaccard similarity of their n-gram sets reaches the threshold. Documents with the
same words in the same order are copies: they share one representative, the smallest doc_id. A representative's
MinHash values are cut into bands; representatives that agree on a band meet in a bucket, and every pair in
a bucket is verified on the full n-gram sets.

- Rows and bands follow from the threshold and the wanted recall (`choose_bands`).
- Buckets with the same members are verified once. A bucket of more than `block` members is dealt into blocks, and each
  pair of blocks is a cell of its own, so no task holds a whole bucket. Pairs aren't written out: a cell
  returns, per member, its number of links and the smallest member it is connected to inside the cell.
- A pair is counted in the first band on which it agrees, so links are exact for all pairs that meet.
- Classes are the connected components of the links.

Null and empty texts, and texts without words, are linked to nothing and are classes of their own. Rows without
doc_id get no class and no links. A row repeated with the same doc_id and text gives the same result row again. A doc_id may stand
for several texts: texts are known by the hash of their words, so each has its own set, bands, links and class. Columns other
than doc_id and text are left out of `join`, and kept by `one_of_each`, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import grams, key_groups, mixed, plain_texts, run_starts, slices, utf8, words, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_BANDS = 20
#: Members of a block of a large bucket.
BLOCK = 512

_rng = np.random.default_rng(5)
_FLIP = _rng.integers(0, 2**63, 1024, dtype=np.uint64)
_SCALE = _rng.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most selective rows with which at most `most` bands find a pair at the threshold with `recall`."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no number of rows reaches this recall with so few bands")
    return best


def _band_hashes(hashes: np.ndarray, begins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band values of each text, from the hashes of its n-grams."""
    out = np.zeros((len(begins), bands), np.uint64)
    for band in range(bands):
        for k in range(band * rows, band * rows + rows):
            least = np.minimum.reduceat((hashes ^ _FLIP[k]) * _SCALE[k], begins)
            out[:, band] = mixed(out[:, band] + mixed(least))
    return out


def _order_hashes(hashes: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    """Two hashes of each text's sequence of words; zero for texts without words."""
    order = np.zeros((count, 2), np.uint64)
    if len(hashes):
        begins = run_starts(row)
        place = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
        for k in range(2):
            order[row[begins], k] = np.add.reduceat(mixed(hashes ^ _FLIP[1000 + k]) * mixed(place.astype(np.uint64) + _SCALE[1000 + k]), begins)
    return order


def signatures(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, a 128-bit hash of the word sequence, and the bands (null without words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            data, bounds = utf8(piece.column("text"))
            _, _, hashes, row = words(data, bounds)
            count = piece.num_rows
            full = np.bincount(row, minlength=count) > 0
            order = _order_hashes(hashes, row, count)
            band = np.zeros((0, bands), np.uint64)
            if len(hashes):
                gram, gram_row, _ = grams(hashes, row, n)
                band = _band_hashes(gram, run_starts(gram_row), bands, rows)
            offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("text_key"), pa.array(order[:, 0].view(np.int64)), pa.array(order[:, 1].view(np.int64)), pa.array(full), lists],
                ["doc_id", "text_key", "words_a", "words_b", "full", "bands"],
            )

    return texts.mapInArrow(run, "doc_id long, text_key string, words_a long, words_b long, full boolean, bands array<long>")


def _sets(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, the hash of its words, its bands and its n-gram set, as packed 64-bit values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            data, bounds = utf8(piece.column("text"))
            _, _, hashes, row = words(data, bounds)
            gram, gram_row, _ = grams(hashes, row, n)
            if not len(gram):
                continue
            begins = run_starts(gram_row)
            band = _band_hashes(gram, begins, bands, rows)
            ends = np.append(begins[1:], len(gram))
            order = _order_hashes(hashes, row, piece.num_rows)[gram_row[begins]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(gram_row[begins])), pa.array(order[:, 0]), pa.array(order[:, 1]), pa.array([b.tobytes() for b in band], pa.binary()),
                 pa.array([np.unique(gram[s:e]).tobytes() for s, e in zip(begins, ends)], pa.binary())],
                ["rep", "words_a", "words_b", "signature", "grams"],
            )

    return texts.mapInArrow(run, "rep long, words_a long, words_b long, signature binary, grams binary")


def verify_cell(ids: np.ndarray, part: np.ndarray, signature: np.ndarray, sets: list[np.ndarray], band: int, cross: bool,
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member that this cell counts, and the smallest id it is connected to by them."""
    m = len(ids)
    sizes = np.array([len(s) for s in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    seen = np.zeros(int(tokens.max()) + 1, bool)
    links, label = np.zeros(m, np.int64), np.arange(m)
    for i in range(m - 1):
        own = tokens[begins[i]:begins[i + 1]]
        seen[own] = True
        shared = np.add.reduceat(seen[tokens[begins[i + 1]:]], begins[i + 1:-1] - begins[i + 1], dtype=np.int64)
        seen[own] = False
        linked = shared >= threshold * (sizes[i] + sizes[i + 1:] - shared) - 1e-9
        if cross:
            linked &= part[i + 1:] != part[i]
        other = np.flatnonzero(linked) + i + 1
        if len(other):
            first = np.argmax(signature[other] == signature[i], axis=1)
            other = other[first == band]
        if len(other):
            links[i] += len(other)
            links[other] += 1
            joined = np.unique(label[np.append(other, i)])
            label[np.isin(label, joined)] = joined[0]
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return links, least[label]


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, class_id) of the connected components of (a, b); class_id is the smallest id. Each step is written out."""
    spark = edges.sparkSession
    both = written(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    state = written(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("class_id")), f"{label}-classes")
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near"))
        nearer = state.join(near, "id", "left").select("id", F.col("class_id").alias("old"), F.least("class_id", "near").alias("next"))
        jump = state.select(F.col("id").alias("next"), F.col("class_id").alias("far"))
        moved = nearer.join(jump, "next", "left").select("id", "old", F.least("next", "far").alias("class_id"))
        moved = written(spark, moved, f"{label}-classes")
        state = moved.select("id", "class_id")
        if moved.filter(F.col("old") != F.col("class_id")).isEmpty():
            return state


def _classified(docs: DataFrame, n: int, threshold: float, recall: float, block: int, text_key: Column) -> DataFrame:
    """doc_id, text_key, class_id, n_links, n_copies and is_first, a row per row with a doc_id.

    is_first marks the rows with the smallest doc_id of their class, and of several texts under it those with the same words as one.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    known = plain_texts(docs).filter(F.col("doc_id").isNotNull()).withColumn("text_key", text_key)
    sketch = written(spark, signatures(known, n, bands, rows), "join-signatures")
    full = sketch.filter("full")
    node = ["words_a", "words_b"]
    reps = written(spark, full.groupBy(*node).agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")), "join-representatives")

    banded = reps.select("rep", *node, F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("band", "bucket").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64(*node)).alias("x"), F.bit_xor(F.xxhash64(*node, F.lit(1))).alias("y")).filter("n > 1")
    kept = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.band", "b.bucket", "n")
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = banded.join(kept, ["band", "bucket"]).withColumn("part", F.pmod(F.xxhash64(*node), blocks).cast("int"))
    members = written(spark, members.select("band", "bucket", "rep", *node, "part", blocks.alias("blocks")), "join-members")
    # As many members as there are copies: never broadcast, so the plan is the same at every size.
    wanted = members.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    sets = _sets(known.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), n, bands, rows)
    # Texts of one id that differ but for their words give a set each.
    sets = sets.dropDuplicates(["rep", *node])
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", "bucket", "rep", *node, "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    keys = ["band", "bucket", "low", "high"]

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in key_groups(batches, keys):
            a, b = (cell.column(c).to_numpy() for c in node)
            signature = np.frombuffer(b"".join(cell.column("signature").to_pylist()), np.uint64).reshape(len(a), bands)
            sets_ = [np.frombuffer(g, np.uint64) for g in cell.column("grams").to_pylist()]
            cross = cell.column("low")[0] != cell.column("high")[0]
            # Members come sorted by the hashes of their words, so places order them.
            links, least = verify_cell(np.arange(len(a)), cell.column("part").to_numpy(), signature, sets_, cell.column("band")[0].as_py(), cross, threshold)
            some = np.flatnonzero(links)
            if len(some):
                first = least[some]
                yield pa.RecordBatch.from_pydict({"words_a": a[some], "words_b": b[some], "links": links[some], "least_a": a[first], "least_b": b[first]})

    found = written(spark, cells.join(sets, ["rep", *node]).repartition(*keys).sortWithinPartitions(*keys, *node)
                    .mapInArrow(verify, "words_a long, words_b long, links long, least_a long, least_b long"), "join-links")
    degree = found.groupBy(*node).agg(F.sum("links").alias("n_links"))
    point = lambda a, b: F.struct(F.col(a).alias("words_a"), F.col(b).alias("words_b"))
    edges = found.filter("words_a <> least_a OR words_b <> least_b").select(point(*node).alias("a"), point("least_a", "least_b").alias("b"))
    classes = components(edges, "join").select("id.*", "class_id")
    named = reps.drop("bands").join(degree, node, "left").join(classes, node, "left")
    own = F.struct("rep", *node)
    firsts = named.filter("class_id IS NOT NULL").groupBy("class_id").agg(F.min(own).alias("first"))
    named = named.join(firsts, "class_id", "left").select(*node, "n_copies", "n_links", F.coalesce("first", own).alias("first"))
    rows_ = sketch.select("doc_id", "text_key", *node, "full").join(named.withColumn("full", F.lit(True)), [*node, "full"], "left")
    is_first = (F.col("doc_id") == F.col("first.rep")) & (F.col("words_a") == F.col("first.words_a")) & (F.col("words_b") == F.col("first.words_b"))
    return rows_.select(
        "doc_id", "text_key", F.coalesce("first.rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce(is_first, F.lit(True)).alias("is_first"))


def join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links and n_copies, a row per row of `docs`.

    n_links counts the other representatives linked to this document's, n_copies the documents with its words.
    """
    result = _classified(docs, n, threshold, recall, block, F.lit("")).drop("text_key", "is_first")
    nameless = plain_texts(docs).filter(F.col("doc_id").isNull()).select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return result.union(nameless)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are the first document of their class; rows equal in all columns stay once.

    What goes is named by doc_id and a digest of the text, so another text under the same doc_id stays if it is a class of its own.
    """
    digest = lambda text: F.md5(F.coalesce(text.cast("string"), F.lit("")))
    spare = _classified(docs, WORDS, THRESHOLD, RECALL, BLOCK, F.md5("text")).filter("NOT is_first").select(
        F.col("doc_id").alias("spare_id"), F.col("text_key").alias("spare_text")).distinct()
    gone = (docs["doc_id"].cast("long") == spare["spare_id"]) & (digest(docs["text"]) == spare["spare_text"])
    return docs.join(spare, gone, "left_anti").dropDuplicates()
