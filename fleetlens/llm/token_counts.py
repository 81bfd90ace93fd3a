"""Token counts under a byte-level BPE vocabulary by rank-synchronous merging.

Texts are cut into pre-tokens. New pre-tokens of a batch are held as one ragged array of symbol ids; in each round every
sequence looks up its lowest-rank pair and merges all its occurrences, leftmost first, at the same time as all other
sequences. A sequence without a known pair is finished: its surviving symbols are its tokens. Counts of
pre-tokens are remembered by the process, up to a bound that doesn't affect results.

Counts equal those of the vocabulary's library without added tokens; special strings inside texts count as
one token, which is the library's default. Null text is read as empty and has no tokens. Every row gives a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import plain_texts, slices

LIMIT = 512
REMEMBERED = 400_000
#: Pre-tokens merged together, so that the arrays stay small.
TOGETHER = 50_000
#: White space of Unicode, and the pre-token pattern of byte-level vocabularies.
SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_names() -> list[str]:
    """The character by which the vocabulary writes each byte: printable ones themselves, the rest from 256 up."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names, extra = [], 256
    for b in range(256):
        if b in printable:
            names.append(chr(b))
        else:
            names.append(chr(extra))
            extra += 1
    return names


class Merges:
    """Merge ranks of a tokenizer file, and the counts remembered so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.symbol_of_byte = np.array([ids[n] for n in byte_names()], np.int64)
        left, right = np.array([ids[a] for a, _ in pairs]), np.array([ids[b] for _, b in pairs])
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order
        self.result = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.never = len(pairs)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, `never` for pairs that aren't merged."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], self.never)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Tokens of each byte sequence, none of them empty."""
        sizes = np.array([len(s) for s in sequences])
        symbols = self.symbol_of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), sizes)
        result = sizes.copy()
        # A pair's rank stands at its first symbol; the last symbol of a sequence has none.
        rank = np.full(len(symbols), self.never)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lengths = np.diff(np.append(begins, len(owner)))
            least = np.minimum.reduceat(rank, begins)
            done = least == self.never
            if done.any():
                result[owner[begins[done]]] = lengths[done]
                keep = np.repeat(~done, lengths)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                lengths, least = lengths[~done], least[~done]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == np.repeat(least, lengths))
            # In a run of overlapping occurrences (a a a) every second one is merged, from the left.
            new_run = np.concatenate([[True], np.diff(chosen) != 1])
            run = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            symbols[chosen] = self.result[rank[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner = symbols[keep], owner[keep]
            rank = rank[keep]
            # Only pairs next to a merged symbol have changed.
            merged = place[chosen]
            changed = np.unique(np.concatenate([merged, merged[merged > 0] - 1]))
            last = changed[(changed == len(owner) - 1) | (owner[np.minimum(changed + 1, len(owner) - 1)] != owner[changed])]
            rank[last] = self.never
            inner = np.setdiff1d(changed, last, assume_unique=True)
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        return result

    def tokens(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts, extra = [], []
        for text in texts:
            stretches = self.split.split(text) if self.split else [text]
            extra.append(len(stretches) - 1)
            found: list[str] = []
            for s in stretches:
                found += self.pattern.findall(s)
            parts.append(found)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*parts) - self.known.keys())
        for at in range(0, len(new), TOGETHER):
            some = new[at:at + TOGETHER]
            self.known.update(zip(some, self.count([p.encode() for p in some]).tolist()))
        look = self.known.__getitem__
        return [sum(map(look, found)) + more for found, more in zip(parts, extra)]


_loaded: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """The vocabulary of this Python process."""
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, a row per row of `docs`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = merges(tokenizer_path)
        for piece in slices(batches):
            counts = vocabulary.tokens(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    texts = plain_texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
