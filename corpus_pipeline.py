"""Cleaning of a corpus in five stages, each a text operator; every stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import decontaminate, ngram_join, pieces, pii, toxicity
from fleetlens.llm.common import written
from fleetlens.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go.

    Null and empty texts are never rejected; a text of any length is judged as a whole. Rows without doc_id are judged by their
    text, repeated rows alike. Without labels nothing is learned and all rows stay. All columns stay as they are.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays.

    Null, empty and wordless texts and rows without doc_id are classes of their own and stay. A doc_id with several texts is a
    document for each; of equal ids in a class the one whose words hash lowest stays, and rows equal in all columns stay once. All columns stay.
    """
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go.

    Null and empty texts and items match nothing; rows without doc_id and repeated rows are judged by their own text. Without test
    items all rows stay. All columns stay, whatever their names.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind.

    Null texts stay null, empty ones empty; every row gives a row, repeated ones alike. n_chars is counted anew where a text has changed,
    other columns stay, whatever their names.
    """
    return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every remaining document.

    Null and empty texts have no ids. Every row gives a row, also repeated ones and those without doc_id; giant texts go in
    chunks. Other columns are left out.
    """
    return pieces.encode(docs, tokenizer_path(spark, "piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

#: No stage can be expressed in SQL: trained scores, hashed n-gram sets, alignments and merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
