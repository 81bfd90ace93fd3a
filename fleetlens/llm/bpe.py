"""Byte-pair encoding and decoding of whole texts by dynamic programming over prefixes.

The encoding of a pre-token is settled prefix by prefix. An automaton over all tokens reads the bytes and names, at each
place, the tokens that are suffixes of what was read. Exactly one of them is the last token of that prefix's
encoding: the one that is compatible with the last token of what stands before it. Only that token is kept for every
prefix; following them back from the end gives the ids. Two tokens are compatible if merging their joined bytes gives the
same two tokens; the tokens at the edges that face each other decide it, which are worked out once per token.

Pre-tokens that are new in a slice of text are sorted, so that each prefix they share is settled once, and go byte by byte all at
the same time; very long ones go alone. Texts are cut before single spaces, where pre-tokens always begin; pieces are remembered
by the process up to a bound that doesn't affect results. A text of any length is worked off in windows, so memory is bounded by the window
unless one pre-token is longer. Ids equal those of the vocabulary's library without begin, end or padding; the strings
of special tokens inside a text become these tokens, the library's default. Decoding gives the bytes of the ids, read as UTF-8
with replacement of broken sequences.

Null text is read as empty and has no ids. Every row gives a row: repeated rows and rows without doc_id are encoded each.
Columns other than doc_id and text are left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import Prefixes, plain_texts, slices
from fleetlens.llm.token_counts import PRE_TOKEN, SPACE, byte_names

#: Code points of a text handled at once.
WINDOW = 1 << 20
#: Pieces and pairs a process remembers; a memory is emptied when it is full.
REMEMBERED = 700_000
#: Pre-tokens worked off together, and the bytes beyond which one goes alone.
TOGETHER = 16_384
LONG = 192
_NEVER = 1 << 60
_BITS = Prefixes.BITS

Spine = list[tuple[int, int]]


class Vocabulary:
    """Tokens and merge ranks of a tokenizer file, and what the process has worked out so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        ids = spec["model"]["vocab"]
        self.byte = [ids[n] for n in byte_names()]
        code = {n: b for b, n in enumerate(byte_names())}
        tokens = {i: bytes(code[c] for c in name) for name, i in ids.items()}
        self.size = {i: len(t) for i, t in tokens.items()}
        self.bytes = tokens
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[ids[a] << _BITS | ids[b]] = (rank, ids[a + b])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = {text: array("I", [i]).tobytes() for text, i in added.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.surface(tokens | {i: text.encode() for text, i in added.items()})
        self.pattern = regex.compile(PRE_TOKEN)
        self.before_space = re.compile(f" (?=[^{SPACE}])")
        self.window_end = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        self._edges: dict[int, tuple[Spine, Spine] | None] = {}
        self._fits: dict[int, int] = {}
        self.prefixes = Prefixes(tokens, self.fitting)
        self.automaton = self.prefixes.automaton
        #: Packed ids of pieces, of those after a space and of those at the start of a stretch.
        self.spaced: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def surface(self, tokens: dict[int, bytes]) -> None:
        """Bytes of all tokens in one array, with where each id's start and how many they are."""
        known = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(t) for t in known])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(known), np.uint8)

    def edges(self, token: int) -> tuple[Spine, Spine] | None:
        """What stands at the left and at the right edge of a token while its bytes are merged, each with the rank that has to
        be reached before it goes; None if merging the bytes doesn't give the token."""
        if token not in self._edges:
            left: Spine = []
            right: Spine = []
            parts = [self.byte[b] for b in self.bytes[token]]
            since_left = since_right = -1
            while len(parts) > 1:
                best = min((self.merge.get(a << _BITS | b, (_NEVER, -1)) for a, b in zip(parts, parts[1:])))
                if best[0] == _NEVER:
                    break
                at = next(k for k in range(len(parts) - 1) if self.merge.get(parts[k] << _BITS | parts[k + 1]) == best)
                since_left, since_right = max(since_left, best[0]), max(since_right, best[0])
                if at == 0:
                    left.append((parts[0], since_left))
                    since_left = -1
                if at == len(parts) - 2:
                    right.append((parts[-1], since_right))
                    since_right = -1
                parts[at:at + 2] = [best[1]]
            whole = (token, _NEVER)
            self._edges[token] = ([*left, whole], [*right, whole]) if parts == [token] else None
        return self._edges[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens are merged into the same two tokens.

        The edges facing each other grow in the order of ranks; the pair is not compatible if the merge across comes first
        at some moment. Of equal ranks the leftmost merge comes first.
        """
        own, other = self.edges(left), self.edges(right)
        if own is None or other is None:
            return False
        ends, starts, merge = own[1], other[0], self.merge
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], starts[j]
            across = merge.get(a << _BITS | b)
            if across is not None and across[0] < a_until and across[0] <= b_until:
                return False
            if a_until == _NEVER and b_until == _NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def fitting(self, key: int) -> int:
        """Whether a token can follow the last token of a prefix, numbered from 1, or stand first (0)."""
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
            before, token = (key >> _BITS) - 1, key & (1 << _BITS) - 1
            known = self._fits[key] = int(self.compatible(before, token) if before >= 0 else self.edges(token) is not None)
        return known

    def alone(self, data: bytes) -> bytes:
        """Packed ids of one pre-token of any length."""
        last, state = array("i", [-1]), 0
        for end in range(1, len(data) + 1):
            state = self.automaton.next(state, data[end - 1])
            for token in reversed(self.automaton.suffixes[state]):
                if self.fitting(last[end - self.size[token]] + 1 << _BITS | token):
                    last.append(token)
                    break
            else:
                raise ValueError("no token ends here")
        ids, at = array("I"), len(data)
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        ids.reverse()
        return ids.tobytes()

    def settled(self, found: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens."""
        out = {p: self.alone(p.encode()) for p in found if len(p) > LONG // 4 and len(p.encode()) > LONG}
        rest = sorted(p.encode() for p in found - out.keys())
        for at in range(0, len(rest), TOGETHER):
            some = rest[at:at + TOGETHER]
            out.update(zip((w.decode() for w in some), self.prefixes.packed(some)))
        return out

    def cut(self, piece: str, lead: str) -> list[str]:
        """Pre-tokens of a piece; ASCII words, with other signs after them or not, need no pattern."""
        if piece.isascii():
            if piece.isalpha():
                return [lead + piece]
            word = piece.rstrip(".,;:!?")
            if word.isalpha():
                return [lead + word, piece[len(word):]]
        return self.pattern.findall(lead + piece)

    def learn(self, new: set[str], known: dict[str, bytes], lead: str) -> None:
        """Packed ids of pieces that were not met before."""
        cut = {p: self.cut(p, lead) for p in new}
        look = self.settled(set().union(*cut.values())).__getitem__
        for p, parts in cut.items():
            known[p] = look(parts[0]) if len(parts) == 1 else b"".join(map(look, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit values."""
        stretches = [self.at_special.split(t) if self.at_special and any(s in t for s in self.special) else [t] for t in texts]
        cut = [[self.before_space.split(s) for s in found[::2]] for found in stretches]
        pieces = [p for text in cut for p in text]
        for known, lead, wanted in ((self.first, "", {p[0] for p in pieces}), (self.spaced, " ", set().union(*(p[1:] for p in pieces)))):
            new = wanted - known.keys()
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = wanted
            self.learn(new, known, lead)
        look, out = self.spaced.__getitem__, []
        for found, text in zip(stretches, cut):
            packed = [self.first[text[0][0]], *map(look, text[0][1:])]
            for special, parts in zip(found[1::2], text[1:]):
                packed += [self.special[special], self.first[parts[0]], *map(look, parts[1:])]
            out.append(b"".join(packed))
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after another, and where each id's end; ids outside the vocabulary have none."""
        ids = np.where((ids >= 0) & (ids < len(self.lengths)), ids, -1).astype(np.int64)
        lengths = np.where(ids < 0, 0, self.lengths[ids])
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.letters[places], ends

    def windows(self, text: str) -> Iterator[str]:
        """The text in windows that end before a single space, so that no pre-token is cut."""
        at = 0
        while len(text) - at > WINDOW:
            end = self.window_end.search(text, at + WINDOW)
            if end is None:
                break
            yield text[at:end.start()]
            at = end.start()
        yield text[at:] if at else text

    def rows(self, texts: list[str]) -> Iterator[tuple[list[bytes], list[bytes]]]:
        """Packed ids and decoded bytes of each text, in windows; short texts are worked off together."""
        if len(texts) == 1:
            parts = [[w] for w in self.windows(texts[0])]
        else:
            parts = [texts]
        for some in parts:
            packed = self.encode(some)
            data, ends = self.decode(np.frombuffer(b"".join(packed), np.uint32))
            bounds = np.append(0, ends)[np.cumsum([0, *(len(p) // 4 for p in packed)])].tolist()
            data = data.tobytes()
            yield packed, [data[a:b] for a, b in zip(bounds, bounds[1:])]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of this Python process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array of int) and n_tokens, a row per row of `docs`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        for batch in slices(batches):
            parts = [packed for packed, _ in known.rows(batch.column("text").to_pylist())]
            packed = [b"".join(p[0] for p in parts)] if batch.num_rows == 1 else parts[0]
            offsets = pa.array(np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), np.uint32).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return plain_texts(docs).mapInArrow(run, "doc_id long, ids array<int>").select("*", F.size("ids").cast("long").alias("n_tokens"))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give empty text, ids outside the vocabulary nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        for batch in batches:
            ids = batch.column("ids")
            texts = []
            for row in ids:
                data, _ = known.decode(np.array([-1 if i is None else i for i in row.as_py() or []], np.int64))
                texts.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text decoded from them, a row per row of `docs`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        for batch in slices(batches):
            n = batch.num_rows
            tokens = [0] * n
            of_ids, of_text = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            readers = [codecs.getincrementaldecoder("utf-8")("replace") for _ in range(n)]
            for packed, decoded in known.rows(batch.column("text").to_pylist()):
                for k, (p, d) in enumerate(zip(packed, decoded)):
                    tokens[k] += len(p) // 4
                    of_ids[k].update(p)
                    of_text[k].update(readers[k].decode(d).encode())
            for h, r in zip(of_text, readers):
                h.update(r.decode(b"", True).encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array([h.hexdigest() for h in of_ids]), pa.array([h.hexdigest() for h in of_text])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return plain_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
