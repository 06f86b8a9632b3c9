"""Quality classifier by importance resampling over hashed n-grams.

Two generative models are bags of hashed n-grams (runs of word bytes and runs of
punctuation, and pairs of neighbours) in a fixed number of buckets: one of the target
text, counted over a bounded sample of rows labelled good, one of the raw text, counted
over every document. The log importance weight of a document is the sum of its n-grams'
log ratios. Documents are resampled without replacement by Gumbel top-k: each weight gets
Gumbel noise seeded by the document's id, and the k largest are selected, where k is the
number of documents that the target model explains at least as well as the raw one, up to
a slack of a few nats, which keeps short clean documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.llm.arrow import map_rows
from pairweave.llm.hashing import U64, hash_spans, mix, utf8
from pairweave.llm.sampling import cut_at, lowest_by_hash
from pairweave.plans.scratch import Scratch

BUCKETS = 1 << 14
#: Labelled rows that the target model is counted over at most.
FIT_ROWS = 6000
SEED = 13
PRIOR, FLOOR = 40.0, 0.05
#: Nats by which the raw model may explain a document better and still leave it in.
SLACK = 2.0

_CLASS = np.full(256, 2, np.uint8)  # 0 space, 1 word, 2 punctuation
_CLASS[:33] = 0
_CLASS[[95, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def ngram_buckets(text: str | None) -> np.ndarray:
    """Bucket of every unigram and bigram; empty for a text without tokens."""
    data = utf8(text)
    if not len(data):
        return np.zeros(0, np.int64)
    cls = _CLASS[data]
    edge = np.concatenate(([0], np.flatnonzero(cls[1:] != cls[:-1]) + 1, [len(data)]))
    solid = cls[edge[:-1]] > 0
    h = hash_spans(data, edge[:-1][solid], edge[1:][solid])
    pairs = mix(h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:])
    pairs[h[:-1] == h[1:]] = U64(0)  # any token repeated at once is one and the same pair
    return (np.concatenate((h, pairs)) >> U64(64 - 14)).astype(np.int64)


def counted(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the chosen documents and of all; the driver gets one row a bucket."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.lit(True).alias("_target"))), "doc_id", "left").select("text", F.coalesce("_target", F.lit(False)))

    def run(batches):
        import pyarrow as pa

        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1), strict=True):
                n = np.bincount(ngram_buckets(text.as_py()), minlength=BUCKETS)
                total[1] += n
                if target.as_py():
                    total[0] += n
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "target", "raw"])

    parts = flagged.mapInArrow(run, "bucket long, target long, raw long")
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in parts.groupBy("bucket").agg(F.sum("target").alias("t"), F.sum("raw").alias("r")).collect():
        target[r["bucket"]], raw[r["bucket"]] = r["t"], r["r"]
    return target, raw


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two smoothed bucket distributions; zero if the target is empty.

    Buckets of the target are drawn to the raw distribution by PRIOR counts for each
    average bucket, so a small sample says little about rare n-grams; the target model
    holds FLOOR of the raw one, which bounds what a single n-gram can cost.
    """
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    base = (raw + 1) / (raw.sum() + BUCKETS)
    p = (target + PRIOR * BUCKETS * base) / (target.sum() + PRIOR * BUCKETS)
    return np.log((1 - FLOOR) * p + FLOOR * base) - np.log(base)


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    return log_ratios(*counted(docs, lowest_by_hash(good, "quality", fit_rows, SEED)))


def gumbel(key: str, seed: int) -> Column:
    """Standard Gumbel noise that depends on the key and the seed alone."""
    u = F.expr(f"(shiftrightunsigned(xxhash64({key}, {seed}), 11) + 0.5D) / {float(1 << 53)}D")
    return -F.log(-F.log(u))


def _weighted(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """All columns of docs and ``weight``, the log importance weight of their text."""

    def make():
        return lambda texts: [[float(ratios[ngram_buckets(x)].sum()) for x in texts]]

    return map_rows(docs, make, "weight double", keep=len(docs.columns), inputs=[docs.columns.index(text)])


def quality_weights(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, perturbed, selected for every row of docs.

    A null or empty text has weight 0 and counts as explained equally well. Rows with a
    null doc_id share one noise value and are never labelled. Repeated rows get equal
    values. Without labels every weight is 0 and every row is selected. Ties at the cut
    go to the smaller doc_id. Texts are read whole, whatever their length. An empty table
    gives an empty result. Other columns, whatever their names, are not read.
    """
    ratios = fit_on(docs, labels, fit_rows)
    scored = _weighted(docs.select("doc_id", "text"), ratios).select("doc_id", F.col("weight").alias("log_weight"), (F.col("weight") + gumbel("doc_id", seed)).alias("perturbed"))
    scored = Scratch(docs.sparkSession, "quality").table(scored)
    k = scored.where(F.col("log_weight") >= -SLACK).count()
    return scored.withColumn("selected", cut_at(scored, "perturbed", "doc_id", k))


def keep_selected(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = SEED) -> DataFrame:
    """The rows of docs that resampling selects, with all columns, whatever their names.

    Edges as in `quality_weights`: what it marks as selected stays, in repeated rows too.
    Texts are scored once for the cut and once for the rows, so that none is moved.
    """
    ratios = fit_on(docs, labels, fit_rows)
    scratch = Scratch(docs.sparkSession, "quality")
    scored = scratch.table(_weighted(docs.select("doc_id", "text"), ratios).select("doc_id", "weight", (F.col("weight") + gumbel("doc_id", seed)).alias("perturbed")))
    cut = cut_at(scored, "perturbed", "doc_id", scored.where(F.col("weight") >= -SLACK).count())
    scratch.drop(scored)
    names = [f"c{i}" for i in range(len(docs.columns))]  # by number, so no name clashes
    i, t = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = _weighted(docs.toDF(*names), ratios, t).withColumn("doc_id", F.col(i)).withColumn("perturbed", F.col("weight") + gumbel("doc_id", seed))
    return rows.where(cut).select(*names).toDF(*docs.columns)
