"""Inputs that every text operator has to take, and helpers of the tests."""

import hashlib
import random

DOCS = "doc_id long, text string, lang string, score string, bucket int, class_id string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, None, "x", 1, "y") for i, t in rows], DOCS)


def odd_rows():
    """Null, empty and very long texts, ties, repeated rows, missing and negative ids."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randrange(99)) for _ in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "no id here at all"), (None, None), (-7, "negative id with some words in it"),
        (6, long), (7, "x" * 70_000), (8, "\U0001f600 é ñ 中文 mixed text"), (2**62, "a very large id"),
    ]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
