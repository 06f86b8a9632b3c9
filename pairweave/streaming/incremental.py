"""Incremental candidate search: new items against a growing store, batch by batch.

Each micro-batch of a stream of items is compared with the store and with itself, its
pairs and vectors are appended, and the store's next reader sees both. Exactly-once
output comes from writing every batch to a folder named by its id: a batch that is
retried replaces its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.operators import candidates


def match_batch(spark: SparkSession, batch: DataFrame, batch_id: int, root: str, vector: str, k: int, least: float) -> None:
    """Pairs (i, j, score) of a batch's items with the store and among themselves at a similarity or above."""
    new = batch.select("item_id", F.col(vector).alias("v")).where(F.col("v").isNotNull()).dropDuplicates(["item_id"])
    path = f"{root}/items/batch={batch_id}"
    new.write.mode("overwrite").parquet(path)
    new = spark.read.parquet(path)
    store = spark.read.option("basePath", f"{root}/items").parquet(f"{root}/items").where(F.col("batch") <= batch_id).select("item_id", "v")
    near = candidates.topk_exact(new, store, "v", k + 1).where((F.col("i") != F.col("j")) & (F.col("sim") >= least))
    pairs = near.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("sim").alias("score"))
    pairs.write.mode("overwrite").parquet(f"{root}/pairs/batch={batch_id}")


def match_stream(items: DataFrame, root: str, vector: str, k: int, least: float, checkpoint: str):
    """Starts the query over a stream of items; it runs as long as there is input and then stops."""
    spark = items.sparkSession
    each = lambda batch, n: match_batch(spark, batch, n, root, vector, k, least)
    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pairs(spark: SparkSession, root: str) -> DataFrame:
    """All pairs found so far."""
    return spark.read.option("basePath", f"{root}/pairs").parquet(f"{root}/pairs").groupBy("i", "j").agg(F.max("score").alias("score"))
