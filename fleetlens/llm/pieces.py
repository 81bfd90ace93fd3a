"""SentencePiece encoding and decoding of whole texts, giant ones included, as a max-plus scan.

For a BPE model the library's result is the one sequence of pieces whose neighbours are all stable, that is, whose
joined text is merged back into the same two pieces. So encoding is a best path: a step from piece to piece weighs
0 if the pair is stable and minus infinity otherwise. The state at a boundary inside a text is the piece that
crosses it and by how many characters. A long text is split into chunks; each chunk yields the matrix of weights from
its entry to its exit states; matrices are combined associatively (max-plus products); with the states known,
every chunk is traced back on its own. Where no piece has a space mark after another character, paths meet
at every such place, and the stretches between are remembered by their text.

The model must have identity normalisation, a dummy prefix and byte fallback, as the public 32k model. Encoding equals
the library's `encode`. Decoding restores the text, except that a literal space mark (U+2581) comes back as a space.
Null and empty texts have no pieces. Repeated rows, and rows without doc_id, are encoded each.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import Prefixes, slices

MARK = "▁"
#: Code points of a chunk; only texts longer than this are split.
CHUNK = 65_536
#: Stretches and pairs a process remembers; a memory is emptied when it is full, results don't depend on it.
REMEMBERED = 300_000
PAIRS = 100_000
#: Stretches worked off together, and the bytes beyond which one goes alone.
TOGETHER = 16_384
LONG = 192
_MISSING = float("-inf")

State = tuple[str, int]
Spine = list[tuple[str, float]]


class Pieces:
    """The pieces of a model; pieces are named by their text, a character without a piece by itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)]
        left_out = set(special)
        self.ids = {model.id_to_piece(i): i for i in range(size) if i not in left_out}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.surface = [b""] * size
        for p, i in self.ids.items():
            self.surface[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.surface[i] = bytes([b])
        self.surface_sizes = np.array([len(s) for s in self.surface])
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surface_letters = np.frombuffer(b"".join(self.surface), np.uint8)
        self.prefixes = Prefixes({i: p.encode() for p, i in self.ids.items()}, self.fitting)
        self.names = {i: p for p, i in self.ids.items()}
        self._stable: dict[tuple[str, str], bool] = {}
        self._edges: dict[str, tuple[Spine, Spine] | None] = {}

    def _spines(self, piece: str) -> tuple[Spine, Spine] | None:
        """What stands at the left and at the right edge of a piece while it is merged, each with the rank of the merge
        that ends it; None if merging the piece's text doesn't give the piece."""
        if piece not in self._edges:
            left: Spine = []
            right: Spine = []
            parts = list(piece)
            while len(parts) > 1:
                ranks = [self.rank.get(a + b, math.inf) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best == math.inf:
                    break
                at = ranks.index(best)
                if at == 0:
                    left.append((parts[0], best))
                if at == len(parts) - 2:
                    right.append((parts[-1], best))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            whole = (piece, math.inf)
            self._edges[piece] = ([*left, whole], [*right, whole]) if len(parts) == 1 else None
        return self._edges[piece]

    def whole(self, piece: str) -> bool:
        """Whether merging the piece's text gives the piece."""
        return self._spines(piece) is not None

    def stable(self, left: str, right: str) -> bool:
        """Whether the joined text of two pieces is merged into the same two pieces.

        The edges facing each other grow by merges in the order of rank; the pair is unstable if at some moment the merge
        across comes first. Of equal ranks the leftmost merge comes first.
        """
        if len(self._stable) > PAIRS:
            self._stable.clear()
        found = self._stable[(left, right)] = self._compare(left, right)
        return found

    def fitting(self, key: int) -> int:
        """Whether a piece can follow the last piece of a prefix, numbered by its id plus 1, or stand first (0)."""
        before, piece = (key >> Prefixes.BITS) - 1, self.names[key & (1 << Prefixes.BITS) - 1]
        return int(self.whole(piece) if before < 0 else self.stable(self.names[before], piece))

    def _compare(self, left: str, right: str) -> bool:
        own, other = self._spines(left), self._spines(right)
        if own is None or other is None:
            return False
        ends, starts, rank = own[1], other[0], self.rank
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], starts[j]
            across = rank.get(a + b)
            if across is not None and across < a_until and across <= b_until:
                return False
            if a_until == math.inf and b_until == math.inf:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def is_piece(self, text: str) -> bool:
        return text in self.ids or len(text) == 1

    def forward(self, text: str, begin: int, stop: int, before: str | None) -> list[str | None]:
        """The piece that ends at each place begin..stop on a stable path from `before`, None where there is none.

        A text has one stable path at most, so the first piece that fits is the only one; short ones are tried first.
        """
        ending: list[str | None] = [None]
        self.extend(ending, text, begin, stop, before)
        return ending

    def extend(self, ending: list[str | None], text: str, begin: int, stop: int, before: str | None) -> None:
        """Goes on with a list that `forward` has made for a beginning of the same text."""
        ids, longest, known, stable = self.ids, self.longest, self._stable, self.stable
        for i in range(len(ending), stop - begin + 1):
            end = begin + i
            ending.append(None)
            for j in range(i - 1, max(i - longest, 0) - 1, -1):
                left = ending[j] if j else before
                if left is None and j:
                    continue
                piece = text[begin + j:end]
                if piece not in ids and j != i - 1:
                    continue
                if left is None:
                    # A piece must also be what its own text is merged into.
                    fits = self.whole(piece)
                else:
                    fits = known.get((left, piece))
                    if fits is None:
                        fits = stable(left, piece)
                if fits:
                    ending[i] = piece
                    break
        return ending

    def back(self, text: str, begin: int, stop: int, before: str | None) -> list[str]:
        """The pieces of the stable path from begin to stop."""
        return self.followed(self.forward(text, begin, stop, before))

    def followed(self, ending: list[str | None]) -> list[str]:
        """The pieces of the path that ends last."""
        out, i = [], len(ending) - 1
        while i:
            piece = ending[i]
            if piece is None:
                raise ValueError("no stable path ends here")
            out.append(piece)
            i -= len(piece)
        return out[::-1]

    def packed(self, pieces: Iterable[str]) -> bytes:
        """Ids as 32-bit values; a character without a piece becomes its bytes."""
        out = array("i")
        for p in pieces:
            known = self.ids.get(p)
            if known is not None:
                out.append(known)
            else:
                out.extend(self.bytes[b] for b in p.encode())
        return out.tobytes()


class Stretches(dict):
    """Packed ids of the stretches between two breaks, worked out once each."""

    def __init__(self, model: Pieces) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, stretch: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = self[stretch] = self.model.packed(self.model.back(stretch, 0, len(stretch), None))
        return ids

    def learn(self, found: set[str]) -> None:
        """Works out new stretches, sorted and all at the same time; long ones, and those with a character without a piece, alone."""
        new = found - self.keys()
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = found
        unknown = set("".join(new)) - self.model.ids.keys()
        alone = {s for s in new if len(s) > LONG // 4 and len(s.encode()) > LONG}
        if unknown:
            odd = re.compile("[" + re.escape("".join(unknown)) + "]")
            alone |= {s for s in new if odd.search(s)}
        for stretch in alone:
            self[stretch] = self.model.packed(self.model.back(stretch, 0, len(stretch), None))
        rest = sorted(s.encode() for s in new - alone)
        for at in range(0, len(rest), TOGETHER):
            some = rest[at:at + TOGETHER]
            self.update(zip((s.decode() for s in some), self.model.prefixes.packed(some)))


_loaded: dict[str, Stretches] = {}


def stretches(path: str) -> Stretches:
    """The model with what this Python process remembers; tasks of one process share it."""
    if path not in _loaded:
        _loaded[path] = Stretches(Pieces(path))
    return _loaded[path]


class Chunk:
    """A chunk of a marked text with `longest` characters of context on both sides; positions start at the chunk."""

    def __init__(self, model: Pieces, left: str, body: str, right: str) -> None:
        self.model, self.body, self.right = model, body, right
        self.text, self.zero = left + body + right, len(left)
        self.end = self.zero + len(body)
        text, zero, end = self.text, self.zero, self.end
        self.breaks = [i for i in range(max(zero, 1), end) if text[i] == MARK and text[i - 1] != MARK] if model.splits else []

    def entries(self) -> list[State]:
        """Pieces that could cross or end at the chunk's start; the start of a text has the state ('', 0)."""
        return self._crossing(self.zero) if self.zero else [("", 0)]

    def _crossing(self, at: int) -> list[State]:
        text, model = self.text, self.model
        found = []
        for s in range(max(at - model.longest, 0), at):
            for e in range(at, min(s + model.longest, len(text)) + 1):
                if model.is_piece(text[s:e]) and e > s:
                    found.append((text[s:e], e - at))
        return found

    def exits(self, begin: int, before: str | None) -> list[State]:
        """Pieces with which a stable path from begin can cross or end at the chunk's end."""
        text, end, model = self.text, self.end, self.model
        if begin >= end:
            return [(before, begin - end)] if before is not None else []
        ending = model.forward(text, begin, end, before)
        found = []
        for s in range(max(end - model.longest, begin), end):
            left = ending[s - begin] if s > begin else before
            if left is None and s > begin:
                continue
            for e in range(end, min(s + model.longest, len(text)) + 1):
                piece = text[s:e]
                if model.is_piece(piece) and (model.stable(left, piece) if left is not None else model.whole(piece)):
                    found.append((piece, e - end))
        return found

    def transfer(self) -> tuple[list[State], list[State], list[tuple[int, int]]]:
        """Entry states, exit states, and the pairs of them that a stable path joins (weight 0)."""
        entries, exits, pairs = self.entries(), {}, []
        shared: list[State] | None = None
        for i, (piece, over) in enumerate(entries):
            begin, before = self.zero + over, piece or None
            first = next((b for b in self.breaks if b >= begin), None)
            if first is None:
                reached = self.exits(begin, before)
            else:
                meets = first == begin or self.model.forward(self.text, begin, first, before)[-1] is not None
                if meets and shared is None:
                    shared = self.exits(self.breaks[-1], None)
                reached = shared if meets else []
            pairs += [(i, exits.setdefault(state, len(exits))) for state in reached or []]
        return entries, list(exits), pairs

    def trace(self, entry: State, exit_: State, known: Stretches) -> bytes:
        """Packed ids of the pieces that start in this chunk on the path between two states."""
        text, model = self.text, self.model
        begin, before = self.zero + entry[1], entry[0] or None
        stop = self.end + exit_[1] - len(exit_[0])
        if begin > stop:
            return b""
        last = model.packed([exit_[0]])
        breaks = [b for b in self.breaks if begin <= b <= stop]
        if not breaks:
            return model.packed(model.back(text, begin, stop, before)) + last
        head = model.packed(model.back(text, begin, breaks[0], before)) if breaks[0] > begin else b""
        middle = b"".join(known[text[a:b]] for a, b in zip(breaks, breaks[1:]))
        tail = model.packed(model.back(text, breaks[-1], stop, None)) if stop > breaks[-1] else b""
        return head + middle + tail + last


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def prefix_products(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, combined in pairs as a tree."""
    if len(matrices) == 1:
        return matrices
    pairs = [max_plus(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
    inner = prefix_products(pairs)
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(inner[k // 2] if k % 2 else max_plus(inner[k // 2 - 1], matrices[k]))
    return out


def choose_states(chunks: list[tuple[list[State], list[State], list[tuple[int, int]]]]) -> list[tuple[State, State]]:
    """Entry and exit state of each chunk on the whole text's path."""
    matrices = []
    for k, (entries, exits, pairs) in enumerate(chunks):
        after = chunks[k + 1][0] if k + 1 < len(chunks) else [s for s in exits if s[1] == 0]
        place = {state: i for i, state in enumerate(after)}
        matrix = np.full((len(entries), max(len(after), 1)), _MISSING)
        for i, j in pairs:
            if exits[j] in place:
                matrix[i, place[exits[j]]] = 0.0
        matrices.append(matrix)
    ahead = prefix_products(matrices)
    behind = [m.T for m in prefix_products([m.T for m in matrices[::-1]])[::-1]]
    states = [chunks[0][0][0]]
    for k in range(1, len(chunks)):
        states.append(chunks[k][0][int(np.argmax(ahead[k - 1][0] + behind[k].max(axis=1)))])
    ends = [s for s in chunks[-1][1] if s[1] == 0]
    states.append(ends[int(np.argmax(ahead[-1][0]))])
    return list(zip(states, states[1:]))


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


_STRETCH = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")


def encode_texts(texts: list[str], known: Stretches) -> list[bytes]:
    """Packed ids of texts that are their own only chunk."""
    if not known.model.splits:
        return [known[marked(t)] if t else b"" for t in texts]
    parts = [_STRETCH.findall(marked(t)) for t in texts]
    known.learn(set().union(*parts))
    return [b"".join(map(known.__getitem__, p)) for p in parts]


def decode_ids(ids: np.ndarray, surface: list[bytes]) -> str:
    """The text of a sequence of ids."""
    out = b"".join(map(surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def decode_all(packed: list[bytes], model: Pieces) -> list[bytes]:
    """The texts of many sequences of packed ids, as UTF-8."""
    ids = np.frombuffer(b"".join(packed), np.int32)
    sizes = model.surface_sizes[ids]
    ends = np.cumsum(sizes)
    data = model.surface_letters[np.repeat(model.surface_starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    bounds = np.append(0, ends)[np.cumsum([0, *(len(p) // 4 for p in packed)])].tolist()
    texts = [data[a:b] for a, b in zip(bounds, bounds[1:])]
    return [t[1:] if t.startswith(b" ") else t for t in texts]


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (array of int), n_tokens and round_trip, a row per row of `docs`.

    round_trip says that decoding the ids gives the text again (literal space marks read as spaces).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, ids array<int>, round_trip boolean"

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = stretches(model_path)
        model = known.model
        for piece in slices(batches):
            column = piece.column("text").to_pylist()
            packed = encode_texts(column, known)
            back = [d == t.replace(MARK, " ").encode() for d, t in zip(decode_all(packed, model), column)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _lists(packed), pa.array(back, pa.bool_())], ["doc_id", "ids", "round_trip"])

    # Long texts: chunks of the marked text with their context. Rows are told apart by position, as ids may repeat.
    context = 32
    length = F.length("text") + 1
    long = texts.filter(length > chunk).withColumn("row", F.xxhash64("doc_id", "text"))
    long = long.dropDuplicates(["row"]).select("row", F.concat(F.lit(MARK), F.translate("text", " ", MARK)).alias("text"))
    cut = long.select("row", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("chunk"))
    begin = F.col("chunk") * chunk
    cut = cut.select(
        "row", "chunk", F.substring("text", (begin + 1).cast("int"), F.lit(chunk)).alias("body"),
        F.substring("text", F.greatest(begin - context + 1, F.lit(1)).cast("int"), F.least(begin, F.lit(context)).cast("int")).alias("left"),
        F.substring("text", (begin + chunk + 1).cast("int"), F.lit(context)).alias("right"))

    def transfer(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = stretches(model_path).model
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                entries, exits, pairs = Chunk(model, r.left, r.body, r.right).transfer()
                rows.append((r.row, r.chunk, [p for p, _ in entries], [o for _, o in entries], [p for p, _ in exits], [o for _, o in exits],
                             [i for i, _ in pairs], [j for _, j in pairs]))
            yield pd.DataFrame(rows, columns=["row", "chunk", "in_piece", "in_over", "out_piece", "out_over", "pair_in", "pair_out"])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        states = choose_states([
            (list(zip(r.in_piece, map(int, r.in_over))), list(zip(r.out_piece, map(int, r.out_over))), list(zip(map(int, r.pair_in), map(int, r.pair_out))))
            for r in group.itertuples()])
        return pd.DataFrame({
            "row": group["row"].to_numpy(), "chunk": group["chunk"].to_numpy(), "in_piece": [a[0] for a, _ in states], "in_over": [a[1] for a, _ in states],
            "out_piece": [b[0] for _, b in states], "out_over": [b[1] for _, b in states]})

    def trace(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = stretches(model_path)
        model = known.model
        for batch in batches:
            ids = [np.frombuffer(Chunk(model, r.left, r.body, r.right).trace((r.in_piece, r.in_over), (r.out_piece, r.out_over), known), np.int32)
                   for r in batch.itertuples()]
            yield pd.DataFrame({"row": batch["row"], "chunk": batch["chunk"], "ids": ids})

    matrices = cut.mapInPandas(transfer, "row long, chunk int, in_piece array<string>, in_over array<int>, out_piece array<string>, out_over array<int>, "
                                         "pair_in array<int>, pair_out array<int>")
    states = matrices.groupBy("row").applyInPandas(scan, "row long, chunk int, in_piece string, in_over int, out_piece string, out_over int")
    traced = cut.join(states, ["row", "chunk"]).mapInPandas(trace, "row long, chunk int, ids array<int>")
    joined = traced.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda c: c["ids"])).alias("ids"))

    def check(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surface = stretches(model_path).model.surface
        for batch in batches:
            back = [decode_ids(np.asarray(i), surface) == t.replace(MARK, " ") for i, t in zip(batch["ids"], batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": batch["ids"], "round_trip": back})

    rows = texts.filter(length > chunk).withColumn("row", F.xxhash64("doc_id", "text"))
    longs = rows.join(joined, "row").select("doc_id", "text", "ids").mapInPandas(check, schema)
    shorts = texts.filter(length <= chunk).mapInArrow(whole, schema)
    return shorts.union(longs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = stretches(model_path).model.surface
        for batch in batches:
            texts = [decode_ids(np.array(i or [], np.int64), surface) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
