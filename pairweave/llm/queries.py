"""The registered queries of the corpus operators and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.llm.jpeg import media_digests, media_features, stored
from pairweave.llm.langid import language_id
from pairweave.llm.mixing import mixed
from pairweave.llm.neardup import near_duplicates
from pairweave.llm.phrases import document_fingerprints
from pairweave.llm.pii import find_spans
from pairweave.llm.quality import quality_weights
from pairweave.llm.segment import decode, encode
from pairweave.llm.tokencount import token_counts
from pairweave.llm.toxicity import toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates on two-word shingles at similarity 0.8 or more."""
    return near_duplicates(documents(spark, sf_dir), k=2, percent=80)


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in training order."""
    return mixed(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the clause grammar."""
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, digested, and whether they decode to its text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = encode(docs, keep=("text",))
    back = decode(rows)
    return back.select(
        "doc_id",
        F.expr("transform(samples, x -> size(x.ids))").alias("n_ids"),
        F.expr("transform(samples, x -> xxhash64(x.ids))").alias("ids_hash"),
        F.expr("transform(samples, x -> x.log_prob)").alias("log_prob"),
        F.expr("transform(samples, x -> x.inclusion)").alias("inclusion"),
        F.expr("forall(texts, x -> x = text)").alias("round_trip"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return document_fingerprints(documents(spark, sf_dir))


def op6_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a baseline JPEG, read back, with sizes, digests and features."""
    return media_digests(media_features(stored(documents(spark, sf_dir))))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and selection of every document."""
    return quality_weights(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document."""
    return token_counts(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_spans(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id(documents(spark, sf_dir))


QUERIES = {
    "op1_minhash_neardup": op1_minhash_neardup,
    "op2_mixing_sources": op2_mixing_sources,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_fingerprints": op5_fingerprints,
    "op6_media_jpeg": op6_media_jpeg,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
}

ORACLES = {
    "op1_minhash_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM w),
flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(n, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT ends.b, reach.r FROM reach JOIN ends ON ends.a = reach.n WHERE reach.r < ends.b),
part AS (SELECT n, min(r) AS r FROM reach GROUP BY n)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, r AS component_id, doc_id = r AS kept
FROM sets JOIN part ON part.n = doc_id""",
    "op2_mixing_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
f AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS wsum,
    coalesce(sum(source_size) OVER fill, 0) AS full_, coalesce(sum(weight) OVER fill, 0) AS wfull
  FROM w WINDOW fill AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, (CAST(150 AS DOUBLE) / 100 * CAST(total AS DOUBLE) - 2.0::DOUBLE * CAST(full_ AS DOUBLE)) / CAST(wsum - wfull AS DOUBLE) AS level FROM f),
a AS (SELECT arg_min(level, (source_size / weight, rank)) AS level FROM l WHERE 2.0::DOUBLE * source_size > weight * level),
t AS (
  SELECT source, source_size, rank, max(rank) OVER () AS last,
    CASE WHEN a.level IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, weight * a.level) END AS target
  FROM l, a),
c AS (
  SELECT d.doc_id, d.size, t.*, CASE WHEN last > 1 THEN 0.5::DOUBLE * (2 * (rank - 1) / CAST(last - 1 AS DOUBLE) - 1) ELSE 0 END AS s,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
k AS (
  SELECT *, CASE WHEN source_size > 0 THEN size * (CAST(round(target) AS BIGINT) // source_size)
      + greatest(0, least(size, CAST(round(target) AS BIGINT) % source_size - start)) ELSE 0 END AS taken, start / target AS u
  FROM c)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE,
    CASE WHEN s = 0 THEN u ELSE (sqrt((1 - s) * (1 - s) + 4 * s * u) - (1 - s)) / (2 * s) END)) END AS position
FROM k""",
}
