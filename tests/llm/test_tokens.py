"""Encoding and token counts against the libraries of the vocabularies."""

import random

import numpy as np
import pytest
from fleetlens.llm import bpe, pieces, token_counts

from .cases import docs, odd_rows, sha, table

vocabularies = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
MODEL = vocabularies.path("piece_bpe_32k.model")
BPE = vocabularies.path("byte_bpe_50k.json")


def random_texts(n, alphabet, seed=1, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, most))) for _ in range(n)]


LETTERS = list("aaabbetr  ▁ \n\té\x00ñ\U0001f600中01.,-_AB") + ["tion", "the", "==", "    "]


def test_encoding_equals_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = odd_rows() + [(10_000 + i, t) for i, t in enumerate(random_texts(500, LETTERS) + ["", "  a  b ", "<0x0A><s></s><unk>", "▁x", "a" * 500])]
    rows += [(r["doc_id"] + 50_000, r["text"]) for r in table(spark, sf, "documents").collect()]
    want = sorted((str(i), library.encode(t or "")) for i, t in rows)
    # Small chunks send almost every text through the scan.
    for chunk in (65_536, 64):
        some = rows if chunk > 64 else [r for r in rows if len(r[1] or "") < 20_000]
        got = pieces.encode(docs(spark, some), MODEL, chunk=chunk).collect()
        assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
        assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == (want if chunk > 64 else sorted((str(i), library.encode(t or "")) for i, t in some))


def test_decoding_restores_the_text(spark):
    rows = [(i, t) for i, t in enumerate(random_texts(200, [c for c in LETTERS if c != "▁"], seed=2))]
    back = pieces.decode(pieces.encode(docs(spark, rows), MODEL), MODEL)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(rows)
    assert pieces.encode(docs(spark, []), MODEL).count() == 0


def test_chunks_without_spaces_and_with_any_length():
    library, known = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.stretches(MODEL)
    for k, text in enumerate(random_texts(150, list("aerstin") + ["tion", "中"], seed=3, most=300) + random_texts(150, LETTERS, seed=4, most=300)):
        marked, size = pieces.marked(text), 16 + k % 50
        cut = [pieces.Chunk(known.model, marked[max(b - 32, 0):b], marked[b:b + size], marked[b + size:b + size + 32]) for b in range(0, len(marked), size)]
        states = pieces.choose_states([c.transfer() for c in cut])
        ids = np.frombuffer(b"".join(c.trace(a, b, known) for c, (a, b) in zip(cut, states)), np.int32).tolist()
        assert ids == library.encode(text)


def test_prefix_products_are_associative():
    rng = np.random.default_rng(0)
    matrices = [np.where(rng.random((4, 4)) < 0.5, rng.normal(size=(4, 4)), -np.inf) for _ in range(9)]
    product, expected = matrices[0], [matrices[0]]
    for m in matrices[1:]:
        product = pieces.max_plus(product, m)
        expected.append(product)
    assert all(np.allclose(a, b) for a, b in zip(pieces.prefix_products(matrices), expected))


def test_token_counts_equal_the_library(spark, sf):
    library = tokenizers.Tokenizer.from_file(BPE)
    letters = list("aaabbetrin  \n\t\x1c\x1f\x85 　éñ\U0001f600中01²½.,-_AB'sdtlv") + ["<|endoftext|>", "'ll", "tion", " the"]
    rows = odd_rows() + [(10_000 + i, t) for i, t in enumerate(random_texts(2_000, letters, seed=5))]
    rows += [(r["doc_id"] + 50_000, r["text"]) for r in table(spark, sf, "documents").collect()]
    counts = [len(e.ids) for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, counts))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs(spark, rows), BPE).collect())
    assert got == want
    assert token_counts.count_tokens(docs(spark, []), BPE).count() == 0


BYTE_LETTERS = list("aaabbetrin  \n\t\x1c\x1f\x85 \u3000éñ\U0001f600中01²½.,-_AB'sdtlv") + ["<|endoftext|>", "'ll", "tion", " the", "  "]


def bpe_rows(spark, sf):
    rows = odd_rows() + [(10_000 + i, t) for i, t in enumerate(random_texts(2_000, BYTE_LETTERS, seed=6) + random_texts(2_000, list("theinraosdlk"), seed=7))]
    rows += [(20_000 + i, t) for i, t in enumerate(["a" * 500, "<|endoftext|>", "  <|endoftext|>  ", "foo  <|endoftext|> bar", "中文" * 400, "ab" * 40_000])]
    return rows + [(r["doc_id"] + 50_000, r["text"]) for r in table(spark, sf, "documents").collect()]


def test_prefix_programme_equals_the_library(spark, sf):
    library = tokenizers.Tokenizer.from_file(BPE)
    rows = bpe_rows(spark, sf)
    ids = [e.ids for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    decoded = [library.decode(i, skip_special_tokens=False) for i in ids]
    want = sorted((str(i), len(x), sha(np.array(x, "<u4").tobytes()), sha(d)) for (i, _), x, d in zip(rows, ids, decoded))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digest(docs(spark, rows), BPE).collect()) == want
    encoded = bpe.encode(docs(spark, rows), BPE)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in encoded.collect()) == sorted((str(i), x) for (i, _), x in zip(rows, ids))
    assert sorted((str(r["doc_id"]), r["text"]) for r in bpe.decode(encoded, BPE).collect()) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.digest(docs(spark, []), BPE).count() == 0


def test_windows_of_a_long_text(monkeypatch):
    library, known = tokenizers.Tokenizer.from_file(BPE), bpe.vocabulary(BPE)
    monkeypatch.setattr(bpe, "WINDOW", 40)
    for text in ["", *random_texts(60, BYTE_LETTERS, seed=8, most=400), "word " * 100, " " * 300, "x" * 300]:
        parts = list(known.rows([text]))
        assert b"".join(p[0] for p, _ in parts) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert b"".join(d[0] for _, d in parts) == text.encode()
    assert len(list(known.rows(["word " * 100]))) > 5


def test_one_token_fits_each_prefix():
    """Of the tokens that are suffixes of a prefix exactly one is compatible with what stands before it."""
    library, known = tokenizers.Tokenizer.from_file(BPE), bpe.vocabulary(BPE)
    for text in random_texts(25, list("theinraosdlk"), seed=9, most=20):
        state, last = 0, [-1]
        for end, b in enumerate(text.encode(), 1):
            state = known.automaton.next(state, b)
            suffixes = known.automaton.suffixes[state]
            assert sorted(suffixes) == sorted(i for i, t in known.bytes.items() if text.encode()[:end].endswith(t))
            fitting = [t for t in suffixes if known.fitting(last[end - known.size[t]] + 1 << 24 | t)]
            assert fitting == library.encode(text[:end], add_special_tokens=False).ids[-1:]
            last += fitting


def test_broken_ids_decode_with_replacement(spark):
    library = tokenizers.Tokenizer.from_file(BPE)
    rows = [(1, [127, 222, 64]), (2, None), (3, []), (4, library.encode("\U0001f600é").ids[1:]), (5, [99_999, -3, 64])]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["text"] for r in bpe.decode(frame, BPE).collect()}
    assert found == {1: library.decode(rows[0][1]), 2: "", 3: "", 4: library.decode(rows[3][1]), 5: library.decode([64])}
