"""Trained classifiers by held-out accuracy, and their parts by brute force."""

import numpy as np
from fleetlens.llm import quality, toxicity
from pyspark.sql import functions as F

from .cases import docs, labels, odd_rows, table


def judged(spark, sf, result, label):
    return result.join(table(spark, sf, "labels").select("doc_id", F.col(label).alias("label")), "doc_id").collect()


def test_quality_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    result = quality.classify(table(spark, big, "documents"), table(spark, big, "labels"))
    rows = [r for r in judged(spark, big, result, "quality") if r["held_out"]]
    assert len(rows) > 40 and np.mean([r["predicted"] == r["label"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    result = toxicity.classify(table(spark, big, "documents"), table(spark, big, "labels"))
    rows = [r for r in judged(spark, big, result, "toxic") if r["held_out"]]
    assert len(rows) > 80 and np.mean([r["predicted"] == r["label"] for r in rows]) > 0.9
    assert np.mean([r["predicted"] for r in rows if not r["label"]]) < 0.05


def test_odd_rows_and_empty_tables(spark):
    frame, n = docs(spark, odd_rows()), len(odd_rows())
    some = labels(spark, [(4, 1, 0), (6, 0, 1), (5, None, None), (None, 1, 1), (4, 0, 1)])
    for label_table in (labels(spark), some):
        for classify in (quality.classify, toxicity.classify):
            rows = classify(frame, label_table).collect()
            assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
            assert classify(docs(spark, []), label_table).count() == 0
    kept = toxicity.without_toxic(frame, labels(spark))
    assert kept.columns == frame.columns and kept.count() == n


def test_held_out_folds(spark):
    import zlib

    rows = [(i, "text") for i in range(60)]
    assert {r["doc_id"]: r["held_out"] for r in quality.classify(docs(spark, rows), labels(spark)).collect()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    assert {r["doc_id"]: r["held_out"] for r in toxicity.classify(docs(spark, rows), labels(spark)).collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}


def test_composed_grammar_equals_its_parts():
    rng = np.random.default_rng(1)
    machine = toxicity.grammar()
    for _ in range(100):
        roles = rng.integers(0, 6, 15).tolist()
        out = machine.run([(r, frozenset()) for r in roles])
        for i, (role, marks) in enumerate(out):
            assert role == roles[i]
            near = {t: any(roles[j] == t for j in range(max(i - reach, 0), i)) for t, reach in toxicity.REACH.items()}
            offence = role in (toxicity.INSULT, toxicity.THREAT)
            assert marks == frozenset(m for t, m in ((toxicity.NEGATION, "negated"), (toxicity.REPORT, "reported"), (toxicity.TARGET, "targeted")) if offence and near[t])


def test_grammar_counts_by_clause():
    from fleetlens.llm.common import utf8, word_hash
    import pyarrow as pa

    machine = toxicity.Grammar(np.array([word_hash("fool")], np.uint64))
    texts = ["you fool", "not a fool", "they said fool", "not here. fool", "", "you said he is not a fool; I kill"]
    counts = machine.count(*utf8(pa.array(texts)))
    assert [np.flatnonzero(c).tolist() for c in counts] == [[1], [4], [3], [0], [], [6, 8]]


def test_isotonic_pools():
    at, share = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert share.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [0.0, 1.5, 3.0]


def test_normal_equations_are_sums_over_all_rows(spark, sf):
    table_ = quality.measured(table(spark, sf, "documents")).withColumn("label", (F.col("doc_id") % 2).cast("double")).repartition(5)
    rows = table_.collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    kernel = quality.Kernel(x.mean(axis=0), x.std(axis=0))
    square, target = quality.normal_equations(table_, kernel)
    z = kernel(x)
    assert np.allclose(square, z.T @ z) and np.allclose(target, z.T @ y)
