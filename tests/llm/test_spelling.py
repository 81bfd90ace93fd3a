"""Spelling variants against a plain version that compares all words, and against SQL."""

import random
import re
import zlib
from collections import Counter

from fleetlens.llm import queries, spelling

from .cases import docs, odd_rows, table


def plain_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, near = {}, {}
    for w, n in words.items():
        found = [v for v in words if plain_near(w, v)]
        near[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, near[w], words.get(forms[w])))
    return sorted(out)


def odd_words(seed):
    rng, rows = random.Random(seed), []
    for stem in ("abcdefgh", "aaabbbaa", "Éclairàge", "x" * 62, "yz" * 34, "q" * 90):
        words = [stem] * 400
        for n in (60, 60, 12, 11, 5, 5):
            word = list(stem)
            for _ in range(rng.choice((1, 1, 2))):
                at = rng.randrange(len(word))
                rng.choice((lambda: word.insert(at, rng.choice("abÿé")), lambda: word.pop(at), lambda: word.__setitem__(at, rng.choice("abxÿ"))))()
            words += ["".join(word)] * n
        rows += [(rng.randrange(10**6), " ".join(words[k::40]) + "," + words[k].upper()) for k in range(40)]
    return rows


def found(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_equal_the_plain_ones(spark):
    rows = odd_words(1) + odd_words(2) + [r for r in odd_rows() if len(r[1] or "") < 1_000] + [(8, "words of one text " * 9), (8, "words of one text " * 9)]
    want = plain_variants(rows)
    assert found(spelling.variants(docs(spark, rows))) == want
    assert any(r[2] not in (r[0], r[1]) for r in want) and any(len(r[0]) > 64 and r[1] for r in want) and any(r[4] > 2 for r in want)


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, ""), (None, "too few")]):
        assert found(spelling.variants(docs(spark, rows))) == []


def test_long_texts_and_runs(spark):
    text = ("longish words stand here " * 60_000) + "k" * 100_000
    whole = [i for i in range(100) if all(zlib.crc32(f"{i}:{w}".encode()) % 199 for w in ("k" * 100_000, "k" * 99_999, "longish"))]
    rows = [(i, text) for i in whole[:5]] + [(whole[5], ("k" * 99_999 + " ") * 5)]
    assert sorted((len(r["word"]), r["n"], r["n_near"]) for r in spelling.variants(docs(spark, rows)).collect()) == [(7, 300_000, 0), (99_999, 5, 1), (100_000, 5, 1)]


def test_every_near_pair_meets_once():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("aab") for _ in range(6))
        b = list(a)
        at = rng.randrange(6)
        rng.choice((lambda: b.insert(at, "a"), lambda: b.pop(at), lambda: b.__setitem__(at, "b")))()
        b = "".join(b)
        if a == b:
            continue
        meet = [(x, y) for x in spelling.rotations(a) for y in spelling.rotations(b) if x[0] == y[0] and (x[1] or y[1]) and (x[2] or y[1]) and (y[2] or x[1])]
        assert len(meet) == plain_near(a, b)


def test_sql_twin(spark, sf, duck):
    want = sorted(duck.sql(queries.SPELLING_SQL).fetchall())
    assert found(queries.op11_spelling_variants(spark, sf)) == want == plain_variants([(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()])
