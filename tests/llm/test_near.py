"""Similarity join, fingerprints, benchmark passages and repeated strings against brute force."""

import random

import numpy as np
import pyarrow as pa
from fleetlens.llm import common, decontaminate, fingerprints, ngram_join, suffix_dedup

from .cases import docs, odd_rows, sha, table


def word_lists(texts):
    data, bounds = common.utf8(pa.array(texts, pa.string()))
    _, _, hashes, row = common.words(data, bounds)
    return [tuple(hashes[row == k].tolist()) for k in range(len(texts))]


def shingles(words, n=5):
    return frozenset(words[i:i + n] for i in range(max(len(words) - n, 0) + 1)) if words else frozenset()


def plain_classes(rows, threshold=0.8):
    """class_id and number of linked representatives of each doc_id."""
    ids = sorted({i for i, _ in rows if i is not None})
    text = {i: t or "" for i, t in rows}
    words = dict(zip(ids, word_lists([text[i] for i in ids])))
    rep = {}
    for i in ids:
        rep[i] = next((j for j in ids if words[j] == words[i] and words[i]), i)
    reps = [i for i in ids if rep[i] == i]
    sets = {i: shingles(words[i]) for i in reps}
    parent, links = {i: i for i in reps}, dict.fromkeys(reps, 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in reps:
        for b in reps:
            both = len(sets[a] & sets[b])
            if a < b and both and both >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (root(rep[i]), links[rep[i]]) for i in ids}


def near_group(n, edits, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10_000)}"
        out.append(" ".join(words))
    return out


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999, 20)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands <= 20


def test_join_equals_brute_force(spark, sf):
    sample = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect() if r["doc_id"] > 8]
    group = [(10_000 + i, t) for i, t in enumerate(near_group(60, 9))]
    rows = odd_rows() + sample + group + [(20_000 + i, sample[0][1]) for i in range(30)]
    want = plain_classes(rows)
    # A block of eight members also takes the way by pairs of blocks.
    for block in (512, 8):
        got = ngram_join.join(docs(spark, rows), block=block).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["class_id"] is None for r in got if r["doc_id"] is None)


def test_one_of_each(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c, d e f g!"), (2, None), (4, ""), (5, "a b c d e f g h i j k l m n o p q r"), (None, "a b c d e f g"), (1, "A b c, d e f g!")]
    frame = docs(spark, rows)
    kept = ngram_join.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "2", "4", "5", "None"]
    assert ngram_join.join(docs(spark, [])).count() == 0


def test_one_id_with_several_texts(spark):
    """Each text has links and a class of its own; what is clean under a repeated id stays, in every row that differs."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    near, other = base + " more", "a clean text with quite different words that nothing else in the table repeats at all"
    rows = [(1, base), (2, near), (2, other), (3, base.upper()), (4, other + " indeed so it is"), (2, near + "!"), (9, "x y z"), (9, "x, y, z")]
    got = {(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.join(docs(spark, rows)).collect()}
    assert got == {(1, 1, 1, 2), (3, 1, 1, 2), (2, 1, 1, 2), (2, 2, 0, 1), (4, 4, 0, 1), (9, 9, 0, 2)}
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs(spark, rows)).collect())
    assert kept == sorted([(1, base), (2, other), (4, other + " indeed so it is"), (9, "x y z"), (9, "x, y, z")])
    schema = "doc_id long, text string, `source.name` string, spare_id long, spare_text string"
    sources = spark.createDataFrame([(7, base, s, 1, "x") for s in ("a", "b", "b")] + [(8, base, "a", 1, "x")], schema)
    out = ngram_join.one_of_each(sources)
    assert out.columns == sources.columns
    assert sorted((r["doc_id"], r["source.name"]) for r in out.collect()) == [(7, "a"), (7, "b")]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["id"], r["class_id"]) for r in ngram_join.components(edges, "t").collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def distance(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_fingerprints(spark, sf):
    rows = [r for r in odd_rows() if r != (5, "one")] + [(5, "one")]
    rows += [(r["doc_id"] * 977 - 90_000, r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect() if r["doc_id"] > 8]
    got = fingerprints.compare(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    own = {r["doc_id"]: r for r in got}
    ordered = sorted((i, t or "") for i, t in rows if i is not None)
    for k, (i, t) in enumerate(ordered):
        j, ahead = ordered[(k + 1) % len(ordered)]
        edited = t[:len(t) - len(t) // 4] + ahead[:len(t) // 4]
        r = own[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        assert r["near_next"] == 1 - distance(r["fingerprint"], own[j]["fingerprint"]) / 64
        assert r["near_edited"] == 1 - distance(r["fingerprint"], r["edited_fingerprint"]) / 64
        near = sum(distance(r["fingerprint"], x["fingerprint"]) <= 3 for x in got) - 1
        assert r["n_near"] == (near if i % 100 == 0 else None)
    texts = {}
    for i, t in ordered:
        assert texts.setdefault(t, own[i]["fingerprint"]) == own[i]["fingerprint"]
    assert fingerprints.compare(docs(spark, [])).count() == 0


def test_near_fingerprints_are_named(spark):
    group = near_group(40, 3)
    rows = [(100 * k + k % 2, t) for k, t in enumerate(group)] + [(7, group[0]), (9, group[0]), (10_000, "nothing is near to this text")]
    got = fingerprints.compare(docs(spark, rows)).collect()
    shares = 0
    for r in got:
        if r["doc_id"] % 100:
            assert r["near_fingerprints"] is None
            continue
        near = {}
        for x in got:
            if x["doc_id"] != r["doc_id"] and distance(r["fingerprint"], x["fingerprint"]) <= 3:
                near[x["fingerprint"]] = near.get(x["fingerprint"], 0) + 1
        assert r["near_fingerprints"] == ",".join(f"{f}:{n}" for f, n in sorted(near.items()))
        assert r["n_near"] == sum(near.values())
        shares += any(f != r["fingerprint"] for f in near)
    own = {r["doc_id"]: r for r in got}
    assert shares and own[10_000]["near_fingerprints"] == "" and own[0]["fingerprint"] in own[0]["near_fingerprints"]


def test_next_ids_of_sparse_and_negative_ids(spark):
    ids = sorted(random.Random(1).sample(range(-10**12, 10**12), 200)) + [2**62]
    got = {r["id"]: r["next"] for r in fingerprints.next_keys(spark.createDataFrame([(i,) for i in ids], "id long"), 16).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


def test_benchmark_passages(spark, sf):
    bench = table(spark, sf, "benchmark")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    words = items[0][1].split()
    edited = " ".join(w for k, w in enumerate(words) if k % 9 != 4)
    extra = [(50_000, "before " * 30 + edited + " after" * 30), (50_001, " ".join(words[:len(words) // 4])), (50_002, " ".join(reversed(words)))]
    sample = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect() if r["doc_id"] > 8]
    for block in (20_000, 15):
        got = decontaminate.find(docs(spark, odd_rows() + sample + extra), bench.withColumn("doc_id", bench["item_id"]), block=block).collect()
        pairs = {(r["doc_id"], r["item_id"]): r["score"] for r in got}
        for i, t in sample:
            for k, item in items:
                if item in t:
                    assert pairs[(i, k)] > 0.99
        assert 0.7 < pairs[(50_000, items[0][0])] < 1
        assert not {(50_001, items[0][0]), (50_002, items[0][0])} & pairs.keys()
    clean = decontaminate.without_leaks(docs(spark, odd_rows() + extra), bench)
    assert clean.columns == docs(spark, []).columns and clean.count() == len(odd_rows()) + 2
    assert decontaminate.find(docs(spark, sample), bench.limit(0)).count() == 0 and decontaminate.find(docs(spark, []), bench).count() == 0


def test_benchmark_passages_with_other_words(spark):
    rng = random.Random(8)
    for length, step in ((20, 5), (20, 4), (41, 5), (60, 4)):
        item = [f"i{k}" for k in range(length)]
        # Every fifth or fourth word is another one: no item n-gram with it stands in a document. No exact copy.
        changed = [f"o{k}" if k % step == step - 1 else w for k, w in enumerate(item)]
        # The n-grams that are left also stand in other documents, more often than those that are gone.
        other = [(100 + k, " ".join(item[k * step:k * step + 3])) for k in range(length // step)] * 3
        rows = [(1, "before " * 30 + " ".join(changed) + " after" * 30), (2, " ".join(rng.choice(item) for _ in range(9))), *other]
        bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
        got = decontaminate.find(docs(spark, rows), bench).collect()
        edits = sum(w != v for w, v in zip(item, changed))
        inner = edits - (changed[-1] != item[-1])
        assert [(r["doc_id"], r["item_id"], r["score"]) for r in got] == [(1, 7, (2 * (length - edits) - inner) / (2 * length))]


def test_leaks_are_judged_row_by_row(spark):
    item = " ".join(f"i{k}" for k in range(20))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = [(None, f"before {item} after"), (None, "clean and without id"), (None, None), (1, item), (1, "clean text of the same id"), (2, "clean")]
    kept = decontaminate.without_leaks(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_passages_do_not_depend_on_the_lines_taken_together(spark, sf, monkeypatch):
    bench, frame = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    want = sorted(decontaminate.find(frame, bench).collect())
    monkeypatch.setattr(decontaminate, "LINES", 3)
    found = decontaminate.find(frame, bench)
    assert want and sorted(found.collect()) == want


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(1, 5, 12).astype(np.uint64), rng.integers(1, 5, 8).astype(np.uint64)
        table_ = np.zeros((9, 13), int)
        for i in range(8):
            for j in range(12):
                table_[i + 1, j + 1] = max(0, table_[i, j] + (2 if a[j] == b[i] else -1), table_[i, j + 1] - 1, table_[i + 1, j] - 1)
        assert decontaminate.align(a[None], b)[0][0] == table_.max()


def plain_removal(rows, window=50):
    first = {}
    known = sorted((i, (t or "").encode()) for i, t in rows if i is not None)
    for i, body in known:
        for p in range(len(body) - window + 1):
            first.setdefault(body[p:p + window], i)
    out = []
    for i, t in rows:
        body = (t or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - window + 1):
            if i is not None and first[body[p:p + window]] < i:
                gone[p:p + window] = b"\1" * window
        runs = sum(1 for k in range(len(body)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(body), sum(gone), runs, sha(bytes(b for b, g in zip(body, gone) if not g))))
    return out


def test_repeated_strings(spark, sf):
    line = "This line stands in a great many documents, word for word, and is longer than fifty bytes."
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    rows = [r for r in odd_rows() if r[0] != 7] + [(7, "ab" * 300), (9, "a" + "ab" * 100), (30, "x" * 49), (31, "x" * 49), (32, "x" * 50), (33, "x" * 50)]
    rows += [(100 + k, noise(rng.randrange(90)) + line + noise(rng.randrange(90)) + (line if k % 7 == 0 else "")) for k in range(60)]
    rows += [(1_000 + r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect() if r["doc_id"] < 80]
    want = sorted(plain_removal(rows), key=str)
    for sizes in ({}, {"bucket_bytes": 40_000, "block_bytes": 20_000, "frequent": 4}):
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in suffix_dedup.dedup(docs(spark, rows), **sizes).collect()]
        assert sorted(got, key=str) == want
    assert suffix_dedup.digest(docs(spark, [])).count() == 0


def test_long_prefixes_equal_plain_comparison():
    rng = np.random.default_rng(4)
    for _ in range(20):
        symbols = rng.integers(1, 3, 200)
        symbols[rng.integers(0, 200, 4)] = 0
        symbols[-1] = 0
        order = suffix_dedup.suffix_order(symbols, 8)
        got = suffix_dedup.long_prefixes(symbols, order, 6)

        def head(p):
            return symbols[p:p + 6].tolist()

        want = [k > 0 and head(order[k]) == head(order[k - 1]) and 0 not in head(order[k]) and len(head(order[k])) == 6 for k in range(200)]
        assert got.tolist() == want
