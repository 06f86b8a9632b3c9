"""Bounded samples, held-out splits and exact cuts at the k-th largest value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes whose sizes are broadcast at most.
MOST_CLASSES = 1000


def remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; -1 for a null id, which belongs to no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)).cast("int"), F.lit(-1))


def class_sizes(rows: DataFrame, by: str) -> DataFrame:
    """The class column and _n, rows of every class.

    Up to MOST_CLASSES classes are counted first and come as a broadcast table; beyond
    that the table is joined like any other. Both give the same rows.
    """
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    few = sizes.limit(MOST_CLASSES + 1).collect()
    return F.broadcast(rows.sparkSession.createDataFrame(few, sizes.schema)) if len(few) <= MOST_CLASSES else sizes


def lowest_by_hash(rows: DataFrame, by: str, per_class: int, seed: int) -> DataFrame:
    """doc_id and class of at most per_class rows of every class, chosen by a seeded hash of the id.

    Only ids and classes take part. Rows whose hash is far above what a class of its size
    needs are dropped where they are read, so the task that ranks a class gets about one
    and a half times per_class rows, however large the class is. That these are too few
    has a chance below 1e-20.
    """
    u = F.expr(f"shiftrightunsigned(xxhash64(doc_id, {seed}), 11) / {float(1 << 53)}D")
    ids = rows.select("doc_id", by)
    near = ids.join(class_sizes(ids, by), by).withColumn("_u", u).where(F.col("_u") <= F.lit(1.5 * per_class + 200) / F.col("_n"))
    ranked = near.selectExpr("doc_id", by, f"row_number() over (partition by {by} order by _u, doc_id) as _rank")
    return ranked.where(F.col("_rank") <= per_class).select("doc_id", by)


def cut_at(scored: DataFrame, key: str, tie: str, k: int, bins: int = 512, leaf: int = 4096) -> Column:
    """A condition that is true for exactly the k rows with the largest key.

    Ties are resolved by the smaller tie value; rows equal in both stay together.
    The cut is found by histograms of a fixed number of bins over ever narrower ranges,
    so the driver sees at most ``bins`` counts or ``leaf`` rows. Rows with a null key
    are never chosen.
    """
    rows = scored.select(F.col(key).alias("_k"), F.col(tie).alias("_t")).where(F.col("_k").isNotNull())
    low, high, n = rows.agg(F.min("_k"), F.max("_k"), F.count(F.lit(1))).first()
    if not k or not n:
        return F.lit(False)
    if k >= n:
        return F.col(key).isNotNull()
    need, inside = k, n
    for _ in range(200):
        width = (high - low) / bins
        if inside <= leaf or not width > 0 or low + width == low:
            break
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("_k") - F.lit(low)) / F.lit(width)).cast("int"))
        grouped = rows.where(F.col("_k").between(F.lit(low), F.lit(high))).groupBy(bin_.alias("b"))
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in grouped.agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo"), F.max("_k").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if counts[b][0] >= need:
                inside, low, high = counts[b]
                break
            need -= counts[b][0]
    rest = rows.where(F.col("_k").between(F.lit(low), F.lit(high)))
    last = rest.orderBy(F.desc("_k"), F.asc_nulls_last("_t")).limit(need).orderBy(F.asc("_k"), F.desc_nulls_first("_t")).limit(1).first()
    if last["_t"] is None:
        return F.col(key) >= F.lit(last["_k"])
    return (F.col(key) > F.lit(last["_k"])) | ((F.col(key) == F.lit(last["_k"])) & (F.col(tie) <= F.lit(last["_t"])))
