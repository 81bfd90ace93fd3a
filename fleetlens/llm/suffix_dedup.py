"""Removal of byte strings that an earlier document already has, by interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a `WINDOW`-byte string that also starts in a document with a smaller doc_id. Equal strings
must meet without comparing all text with all text, so each window is represented by its anchor, the smallest
hash among the `ANCHOR`-byte strings in it; equal windows have equal anchors. Consecutive windows with one anchor form a
context of at most 76 bytes. Steps, all keyed by bounded buckets of documents or of anchors:

1. Each bucket of documents lists its anchors, with how many documents have them (as a power of two).
2. Anchors in more than one document are sent back. Most text ends here.
3. Buckets send the distinct contexts of shared anchors, with the first document of each. Contexts of an anchor that
   very many documents have are sent window by window instead, so no group of contexts grows with its frequency.
4. Contexts are compared. An anchor with a single context needs no comparison. The others are put in suffix order
   and transformed; breadth-first backward extension derives the common prefixes by increasing length (`long_prefixes`),
   stopping at WINDOW. What is left undefined then shares WINDOW bytes with its predecessor; the smallest document of
   such a run is the owner of the string.
5. Buckets learn which of their windows have an earlier owner, and cover and count bytes.

A document whose whole text occurs earlier is a copy and is not searched: all of it goes if it has a window at all.
Null text is read as empty. Texts under WINDOW bytes keep everything. Rows without doc_id come neither before nor after
others and keep everything; rows that repeat a doc_id don't count as earlier to one another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import plain_texts, running_sums, span_hashes, utf8, written

WINDOW = 50
ANCHOR = 24
#: Text of a bucket of documents.
BUCKET_BYTES = 2 << 20
#: Contexts compared together.
BLOCK_BYTES = 3 << 19
#: An anchor of about so many documents is compared window by window.
FREQUENT = 8_192

_POSITION = np.uint64((1 << 30) - 1)
_KEY = np.uint64((1 << 36) - 1)
_NOTE = "bucket long, part int, kind int, body binary"
COPIES, SHARED, MASKS = range(3)


def contexts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, number of windows, row and anchor hash of each context."""
    n, spread = len(data), WINDOW - ANCHOR + 1
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(n - ANCHOR + 1)
    hashes = span_hashes(running_sums(data), at, at + ANCHOR)
    # The smallest hash of each window, the leftmost of equals: positions are the low bits.
    least = (hashes & ~_POSITION) | at.astype(np.uint64)
    width = 1
    while width < spread:
        step = min(width, spread - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = (least & _POSITION).astype(np.int64)
    stop = np.repeat(bounds[1:], np.diff(bounds))[:n - WINDOW + 1]
    inside = np.arange(n - WINDOW + 1) + WINDOW <= stop
    same = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(inside & ~np.concatenate([[False], same]))
    last = np.flatnonzero(inside & ~np.concatenate([same, [False]]))
    return first, last - first + 1, np.searchsorted(bounds, first, "right") - 1, hashes[anchor[first]]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by at least their first `depth` symbols, by prefix doubling from seven symbols on."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key << 9 | padded[j:j + n]
    length = 7
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if length >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[:n - length] += rank[length:] + 1
        length *= 2


def long_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Which suffixes, in suffix order, share at least `least` symbols with the one before; symbol 0 ends a text.

    Boundaries between suffixes are settled by increasing common prefix. Let a boundary with prefix l lie between two
    neighbours among the suffixes preceded by some symbol c; extended backwards by c, these are neighbours with
    prefix l + 1, unless a smaller prefix has settled that boundary already. So each level looks, for all unsettled
    boundaries at once, whether a boundary settled so far lies between the two suffixes they come from.
    """
    n = len(symbols)
    transform = symbols[order - 1].astype(np.int16)
    transform[order == 0] = 0
    source = np.argsort(transform, kind="stable")
    before = np.concatenate([[0], source[:-1]])
    first = np.concatenate([[True], transform[source[1:]] != transform[source[:-1]]])
    settled = first | (transform[source] == 0)
    open_ = np.flatnonzero(~settled)
    for _ in range(1, least):
        if not len(open_):
            break
        count = np.cumsum(settled, dtype=np.int32)
        now = count[source[open_]] > count[before[open_]]
        settled[open_[now]] = True
        open_ = open_[~now]
    return ~settled


def window_owners(data: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each byte that starts a window of its text: the smallest document with this window; elsewhere the largest number."""
    n, texts = len(data), len(lengths)
    symbols = np.zeros(n + texts, np.int64)
    owner = np.repeat(np.arange(texts), lengths)
    symbols[np.arange(n) + owner] = data.astype(np.int64) + 1
    order = suffix_order(symbols, WINDOW)
    shared = long_prefixes(symbols, order, WINDOW)
    # Text of each place; separators count to the text before them.
    text_of = np.repeat(np.arange(texts), lengths + 1)
    begins = np.flatnonzero(~shared)
    least = np.repeat(np.minimum.reduceat(docs[text_of[order]], begins), np.diff(np.append(begins, len(order))))
    result = np.empty(n + texts, np.int64)
    result[order] = least
    ends = np.cumsum(lengths + 1) - 1
    room = ends[text_of] - np.arange(n + texts)
    result[room < WINDOW] = np.iinfo(np.int64).max
    return result


def _packed(keys: np.ndarray) -> bytes:
    """The low five bytes of each value."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(body, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _address(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and key of an anchor: what is sent instead of the full hash. A rare mix-up only adds contexts to compare."""
    return (hashes >> np.uint64(44)) % np.uint64(parts), hashes & _KEY


class Bucket:
    """Documents of a bucket that aren't copies, in the order of doc_id, and their contexts."""

    def __init__(self, docs: pa.Table, notes: pa.Table) -> None:
        copies = [np.frombuffer(b, np.int64) for b in _bodies(notes, COPIES).values()]
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = docs.column("doc_id").to_numpy()
        copy = np.isin(ids, np.concatenate(copies)) if copies else np.zeros(len(ids), bool)
        self.copies = docs.filter(pa.array(copy))
        own = docs.filter(pa.array(~copy))
        self.ids = ids[~copy]
        self.data, self.bounds = utf8(own.column("text"))
        self.first, self.windows, self.row, self.anchor = contexts(self.data, self.bounds)

    def compared(self, shared: dict[int, bytes], parts: int) -> None:
        """Keeps what has to be compared: contexts of shared anchors, frequent ones as single windows."""
        part, key = _address(self.anchor, parts)
        sent = [_unpacked(b) & _KEY | np.uint64(p) << np.uint64(36) for p, b in shared.items()]
        many = [_unpacked(b) >> np.uint64(36) for b in shared.values()]
        known = np.concatenate(sent) if sent else np.zeros(0, np.uint64)
        frequent = np.concatenate(many).astype(bool) if many else np.zeros(0, bool)
        order = np.argsort(known)
        known, frequent = known[order], frequent[order]
        mine = part << np.uint64(36) | key
        at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
        keep = np.flatnonzero(known[at] == mine) if len(known) else np.zeros(0, np.int64)
        single = frequent[at[keep]] if len(known) else np.zeros(0, bool)
        times = np.where(single, self.windows[keep], 1)
        index = np.repeat(keep, times)
        step = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
        split = np.repeat(single, times)
        self.first = self.first[index] + step * split
        self.windows = np.where(split, 1, self.windows[index])
        self.row = self.row[index]
        body = span_hashes(running_sums(self.data), self.first, self.first + self.windows + WINDOW - 1)
        self.group = np.where(split, body, self.anchor[index])
        # Documents are in order, so the first occurrence of a text is in its smallest document.
        _, self.sample, self.which = np.unique(body, return_index=True, return_inverse=True)

    def dealt(self, deals: int) -> np.ndarray:
        """To which deal each distinct text belongs."""
        return ((self.group[self.sample] >> np.uint64(20)) % np.uint64(deals)).astype(np.int64)


def _bodies(notes: pa.Table, kind: int) -> dict[int, bytes]:
    if not notes.num_rows:
        return {}
    rows = zip(notes.column("part").to_pylist(), notes.column("kind").to_pylist(), notes.column("body").to_pylist())
    return {p: b for p, k, b in rows if k == kind}


def _list_anchors(parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"part": [], "bucket": [], "body": []}
        if docs.num_rows:
            bucket = Bucket(docs, notes)
            order = np.lexsort((bucket.row, bucket.anchor))
            anchor, row = bucket.anchor[order], bucket.row[order]
            new = np.concatenate([[True], anchor[1:] != anchor[:-1]])[:len(anchor)]
            other = new | np.concatenate([[True], row[1:] != row[:-1]])[:len(anchor)]
            begins = np.flatnonzero(new)
            if len(begins):
                documents = np.add.reduceat(other.astype(np.int64), begins)
                power = np.minimum(np.log2(documents).astype(np.uint64), np.uint64(15))
                part, key = _address(anchor[begins], parts)
                value = key | power << np.uint64(36)
                for p in np.unique(part).tolist():
                    rows["part"].append(p)
                    rows["bucket"].append(docs.column("bucket")[0].as_py())
                    rows["body"].append(_packed(value[part == p]))
        return pa.table(rows, schema=pa.schema([("part", pa.int32()), ("bucket", pa.int64()), ("body", pa.binary())]))

    return run


def _notes(buckets: list[int], part: int, kind: int, bodies: list[bytes]) -> pa.Table:
    return pa.table({
        "bucket": pa.array(buckets, pa.int64()), "part": pa.array([part] * len(buckets), pa.int32()), "kind": pa.array([kind] * len(buckets), pa.int32()),
        "body": pa.array(bodies, pa.binary())})


def _share_anchors(frequent: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bodies = [_unpacked(b) for b in table.column("body").to_pylist()]
        value = np.concatenate(bodies)
        key, documents = value & _KEY, np.left_shift(1, (value >> np.uint64(36)).astype(np.int64))
        order = np.argsort(key)
        begins = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        total = np.add.reduceat(documents[order], begins)
        back = np.empty(len(key), np.int64)
        back[order] = np.repeat(total, np.diff(np.append(begins, len(key))))
        reply = key | (back >= frequent).astype(np.uint64) << np.uint64(36)
        buckets, out, at = [], [], 0
        for bucket, body in zip(table.column("bucket").to_pylist(), bodies):
            mine = slice(at, at + len(body))
            at += len(body)
            chosen = reply[mine][back[mine] > 1]
            if len(chosen):
                buckets.append(bucket)
                out.append(_packed(chosen))
        return _notes(buckets, table.column("part")[0].as_py(), SHARED, out)

    return run


_CONTEXTS = pa.schema([("part", pa.int32()), ("bucket", pa.int64()), ("text", pa.binary()), ("lengths", pa.binary()), ("docs", pa.binary()), ("groups", pa.binary())])


def _send_contexts(parts: int, deals: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        rows: dict[str, list] = {name: [] for name in _CONTEXTS.names}
        shared = _bodies(notes, SHARED)
        if docs.num_rows and shared:
            bucket = Bucket(docs, notes)
            bucket.compared(shared, parts)
            deal, first = bucket.dealt(deals), bucket.first[bucket.sample]
            length = bucket.windows[bucket.sample] + WINDOW - 1
            for d in np.unique(deal).tolist():
                mine = np.flatnonzero(deal == d)
                at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(length[mine])[:-1]]), length[mine]) + np.arange(int(length[mine].sum()))
                rows["part"].append(d)
                rows["bucket"].append(docs.column("bucket")[0].as_py())
                rows["text"].append(bucket.data[at].tobytes())
                rows["lengths"].append(length[mine].astype(np.uint8).tobytes())
                rows["docs"].append(bucket.ids[bucket.row[bucket.sample[mine]]].astype(np.int64).tobytes())
                rows["groups"].append((bucket.group[bucket.sample[mine]] >> np.uint64(32)).astype(np.uint32).tobytes())
        return pa.table(rows, schema=_CONTEXTS)

    return run


def _compare(block_bytes: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(b, kind) for b in table.column(name).to_pylist()]
        texts = read("text", np.uint8)
        data, per_row = np.concatenate(texts), read("lengths", np.uint8)
        lengths, docs, groups = np.concatenate(per_row).astype(np.int64), np.concatenate(read("docs", np.int64)), np.concatenate(read("groups", np.uint32))
        begins = np.cumsum(lengths) - lengths
        masks = np.zeros(len(lengths), np.uint32)
        blocks = -(-len(data) // block_bytes)
        body = np.zeros(len(lengths), np.uint64)
        row_of = np.repeat(np.arange(len(per_row)), [len(x) for x in per_row])
        base = np.cumsum([0] + [len(t) for t in texts])
        for r, text in enumerate(texts):
            mine = row_of == r
            body[mine] = span_hashes(running_sums(text), begins[mine] - base[r], begins[mine] - base[r] + lengths[mine])
        for b in range(blocks):
            mine = np.flatnonzero(groups % np.uint32(blocks) == b) if blocks > 1 else np.arange(len(lengths))
            if not len(mine):
                continue
            _, sample, which = np.unique(body[mine], return_index=True, return_inverse=True)
            owner = np.full(len(sample), np.iinfo(np.int64).max)
            np.minimum.at(owner, which, docs[mine])
            unique = mine[sample]
            _, of_group, size = np.unique(groups[unique], return_inverse=True, return_counts=True)
            # The only context of its anchor: all its windows start first where it does.
            masks[mine] = np.where(owner[which] < docs[mine], np.uint32(0xFFFFFFFF), np.uint32(0))
            several = np.flatnonzero(size[of_group] > 1)
            if len(several):
                chosen, length = unique[several], lengths[unique[several]]
                at = np.repeat(begins[chosen] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                least = window_owners(data[at], length, owner[several])
                place = np.full(len(sample), -1)
                place[several] = np.cumsum(length + 1) - (length + 1)
                member = np.flatnonzero(place[which] >= 0)
                bits = np.zeros(len(member), np.uint32)
                begin, windows, own = place[which[member]], lengths[mine[member]] - WINDOW + 1, docs[mine[member]]
                for w in range(WINDOW - ANCHOR + 1):
                    some = np.flatnonzero(windows > w)
                    bits[some] |= (least[begin[some] + w] < own[some]).astype(np.uint32) << np.uint32(w)
                masks[mine[member]] = bits
        bodies = [masks[row_of == r].tobytes() for r in range(len(per_row))]
        return _notes(table.column("bucket").to_pylist(), table.column("part")[0].as_py(), MASKS, bodies)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _apply(parts: int, deals: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _RESULT.empty_table()
        bucket = Bucket(docs, notes)
        bucket.compared(_bodies(notes, SHARED), parts)
        masks, deal = np.zeros(len(bucket.sample), np.uint32), bucket.dealt(deals)
        for d, body in _bodies(notes, MASKS).items():
            masks[deal == d] = np.frombuffer(body, np.uint32)
        later = bucket.ids[bucket.row] > bucket.ids[bucket.row[bucket.sample]][bucket.which] if len(bucket.row) else np.zeros(0, bool)
        mask = np.where(later, np.uint32(0xFFFFFFFF), masks[bucket.which])
        change = np.zeros(len(bucket.data) + 1, np.int64)
        for w in range(WINDOW - ANCHOR + 1):
            at = bucket.first[(bucket.windows > w) & (mask >> np.uint32(w) & np.uint32(1) == 1)] + w
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
        gone = np.cumsum(change)[:-1] > 0
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        edge = bucket.bounds[1:-1]
        edge = edge[edge < len(gone)]
        starts[edge] = gone[edge]
        n_gone, n_starts = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(starts)])
        low, high = bucket.bounds[:-1], bucket.bounds[1:]
        kept = [bucket.data[a:b][~gone[a:b]].tobytes() for a, b in zip(low.tolist(), high.tolist())]
        sizes = np.array([len(t.as_py().encode()) for t in bucket.copies.column("text")], np.int64)
        whole = sizes >= WINDOW
        copies = [b"" if w else t.as_py().encode() for w, t in zip(whole, bucket.copies.column("text"))]
        return pa.table([
            pa.array(np.concatenate([bucket.ids, bucket.copies.column("doc_id").to_numpy()])), pa.array(np.concatenate([high - low, sizes])),
            pa.array(np.concatenate([n_gone[high] - n_gone[low], sizes * whole])), pa.array(np.concatenate([n_starts[high] - n_starts[low], whole.astype(np.int64)])),
            pa.array(kept + copies, pa.binary())], schema=_RESULT)

    return run


def dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, block_bytes: int = BLOCK_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes), a row per row of `docs`."""
    spark = docs.sparkSession
    texts = plain_texts(docs)
    known = texts.filter(F.col("doc_id").isNotNull())
    keys = written(spark, known.select("doc_id", F.md5("text").alias("key"), F.octet_length("text").alias("size")), "suffix-keys")
    buckets = int(max(-(-(keys.agg(F.sum("size")).first()[0] or 0) // bucket_bytes), 1))
    parts, deals = max(buckets // 8, 1), max(buckets // 4, 1)

    def bucket_of(doc_id: str) -> object:
        return F.pmod(F.xxhash64(doc_id), F.lit(buckets))

    first = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = keys.join(first, "key").filter("doc_id > first").groupBy(bucket_of("doc_id").alias("bucket")).agg(F.collect_list("doc_id").alias("ids"))

    def pack(batches: object) -> object:
        for batch in batches:
            bodies = [np.array(i, np.int64).tobytes() for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "bucket": batch.column("bucket"), "part": pa.array([0] * len(bodies), pa.int32()), "kind": pa.array([COPIES] * len(bodies), pa.int32()),
                "body": pa.array(bodies, pa.binary())})

    copies = written(spark, copies.mapInArrow(pack, _NOTE), "suffix-copies")
    dealt = known.withColumn("bucket", bucket_of("doc_id"))

    def by_bucket(notes: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        # All three uses read the same exchange of the texts, which Spark runs once.
        return dealt.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(step, schema)

    anchors = by_bucket(copies, _list_anchors(parts), "part int, bucket long, body binary")
    shared = anchors.groupBy("part").applyInArrow(_share_anchors(frequent), _NOTE)
    notes = copies.union(shared)
    sent = by_bucket(notes, _send_contexts(parts, deals), "part int, bucket long, text binary, lengths binary, docs binary, groups binary")
    masks = sent.groupBy("part").applyInArrow(_compare(block_bytes), _NOTE)
    found = by_bucket(notes.union(masks), _apply(parts, deals), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    nameless = texts.filter(F.col("doc_id").isNull()).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.encode("text", "UTF-8").alias("kept"))
    return found.union(nameless)


def digest(docs: DataFrame) -> DataFrame:
    """`dedup` with the hash of the remaining bytes in their place."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
