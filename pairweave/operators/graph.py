"""Graph operators over edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.plans.scratch import Scratch

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components by alternating large-star and small-star contraction.

    Returns ``(id, component)`` for every id that occurs in an edge, where component is
    the smallest id reachable. Edges with a null end are ignored; self loops give a
    component of one. Rounds grow with the logarithm of the component size, not with the
    diameter. Every round is two hash joins on the node id (adaptive execution splits
    the partitions of hub nodes) and is written to the shared folder; only two numbers
    per round reach the driver.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    now = scratch.table(
        edges.select(
            F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
        ).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct()
    )

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("v", "u")) if large else pairs
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        if large:
            least = least.select("u", F.least("u", "m").alias("m"))
            return (
                both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(pairs.where("u = v")).distinct()
            )
        hung = pairs.join(least, "u")
        return (
            hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = mark(now)
    for _ in range(MAX_ROUNDS):
        after = scratch.table(star(star(now, True), False))
        scratch.drop(now)
        now, seen = after, mark(after)
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()
