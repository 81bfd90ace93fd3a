"""Registered queries of the text operators, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, decontaminate, fingerprints, negatives, ngram_join, pieces, pii, quality, secret_scan, spelling, suffix_dedup, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_table(spark, sf_dir, "documents"))


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """Where a public vocabulary file lies; `fleetlens.tokenizers` names another folder than the installed one."""
    folder = spark.conf.get("fleetlens.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), tokenizer_path(spark, "piece_bpe_32k.model"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(spark, "byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.detect(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), tokenizer_path(spark, "byte_bpe_50k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {fn.__name__: fn for fn in (
    op1_pii, op2_ngram_jaccard_join, op3_quality_classifier, op4_document_fingerprints, op5_sentencepiece, op6_token_counts, op7_toxicity, op8_secret_scan, op9_decontamination, op10_suffix_array_dedup,
    op11_spelling_variants, op12_bpe, op13_hard_negatives,
)}
#: The CRC is taken bit by bit: a byte enters, then seven empty steps follow.
SPELLING_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
coded AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(
    flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)),
    lambda b: [b, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]))), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384))) AS h
  FROM counted),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN doc_id IS NULL OR h % 199 <> 0 THEN run ELSE substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) END AS word, n FROM coded)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
skipped AS (
  SELECT word, n, substr(word, 1, i - 1) || '$' || substr(word, i + 1) AS key, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM skipped a JOIN skipped b ON a.key = b.key AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM skipped a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM skipped a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, min({'n': -other_n, 'word': other}) FILTER (WHERE other_n >= 5 * n) AS pick FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, pick.word AS form, -pick.n AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""

NEGATIVES_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector, row_number() OVER () AS place
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.place AS anchor, b.vec_id, a.label = b.label AS same, list_inner_product(a.vector, b.vector)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.place <> b.place),
positives AS (
  SELECT anchor_id, anchor, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY place <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id))::INT AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""

ORACLES: dict[str, str] = {"op11_spelling_variants": SPELLING_SQL, "op13_hard_negatives": NEGATIVES_SQL}
