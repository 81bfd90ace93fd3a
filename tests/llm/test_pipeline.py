"""The pipeline's stages one after another against what they promise."""

import corpus_pipeline
from fleetlens.llm import decontaminate, pii
from fleetlens.llm.queries import QUERIES

from .cases import docs, odd_rows, table
from .test_near import plain_classes
from .test_spans import plain_pii


def test_stages(spark, sf, tmp_path):
    frame = table(spark, sf, "documents")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        out = stage(spark, frame, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        frame = after[name] = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == before.columns
    rows = {n: {r["doc_id"]: r for r in f.collect()} for n, f in after.items()}
    classes = plain_classes([(i, r["text"]) for i, r in rows["toxicity"].items()])
    assert rows["ngram_jaccard_join"].keys() == {i for i, (c, _) in classes.items() if i == c}
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    assert not any(t in r["text"] for r in rows["decontamination"].values() for t in items)
    gone = rows["ngram_jaccard_join"].keys() - rows["decontamination"].keys()
    leaks = decontaminate.find(after["ngram_jaccard_join"], table(spark, sf, "benchmark"))
    assert gone == {r["doc_id"] for r in leaks.collect()}
    assert rows["pii"].keys() == rows["decontamination"].keys() == rows["sentencepiece"].keys()
    assert not any(plain_pii(r["text"]) for r in rows["pii"].values())
    assert all(r["round_trip"] for r in rows["sentencepiece"].values())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(rows["sentencepiece"])


def test_stages_take_odd_rows(spark, sf):
    for rows in ([], odd_rows()):
        frame = docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf)
            assert name == "sentencepiece" or out.columns == frame.columns
            assert out.count() >= len(rows) // 2


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {"pipeline", *QUERIES} <= names.keys()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}


def test_columns_of_any_name_stay(spark):
    """Names of the operators' own working columns, and names with dots, in a stage that changes texts and one that removes rows."""
    names = ["doc_id", "text", "n_chars", "_base", "_all", "_text", "_more", "_row", "_row_key", "a.b"]
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(1, "mail me: jane@example.org now", 29, "b", "a", "t", "m", "r", "k", "d"), (2, None, 0, "b2", "a2", "t2", "m2", "r2", "k2", "d2"),
            (3, long, len(long), "b3", "a3", "t3", "m3", "r3", "k3", "d3")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"`{n}` string" for n in names[3:]))
    redacted = pii.redact(frame)
    assert redacted.columns == names
    got = {r["doc_id"]: tuple(r) for r in redacted.collect()}
    assert got[1][1] == "mail me: <EMAIL> now" and got[1][2] == len(got[1][1]) and got[1][3:] == rows[0][3:] and got[2] == rows[1]
    clean = decontaminate.without_leaks(frame, spark.createDataFrame([(1, long)], "item_id long, text string"))
    assert clean.columns == names and sorted(tuple(r) for r in clean.select(*[f"`{n}`" for n in names if n != "text"]).collect()) == [
        r[:1] + r[2:] for r in rows[:2]]


def test_blocks_of_test_items_find_the_same(spark):
    items = [(k, " ".join(f"item{k}word{j}" for j in range(12))) for k in range(30)]
    rows = [(100 + k, "before " + t + " after") for k, t in items[::3]] + [(1, "nothing of the kind in here at all")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole, cut = (sorted(tuple(r) for r in decontaminate.find(docs(spark, rows), benchmark, block=b).collect()) for b in (20_000, 7))
    assert whole == cut and len(whole) == 10
