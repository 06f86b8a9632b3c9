"""Sinks: cluster lines, answer lines, embedding stores and a stage cache."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """cluster_id and line: its item ids in order, joined by commas. Clusters are size-limited, so a line is bounded."""
    return clusters.groupBy("cluster_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("item_id")), lambda x: x.cast("string"))).alias("line"))


def cluster_summary(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    cluster_lines(clusters).orderBy("cluster_id").select("line").write.mode("overwrite").text(path)


def answer_lines(answers: DataFrame) -> DataFrame:
    """group_id and a 0/1 line in task order."""
    return answers.select("group_id", F.col("z").cast("int").cast("string").alias("line")).orderBy("group_id")


def write_answers(answers: DataFrame, path: str) -> None:
    answer_lines(answers).select("line").write.mode("overwrite").text(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def file_marks(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of change of every file below a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def cached(spark: SparkSession, root: str, stage: str, parameters: dict, build: Callable[[], DataFrame], inputs: tuple[str, ...] = ()) -> DataFrame:
    """A stage's table, built once for each set of parameters and state of its inputs, and read back after that.

    The folder is named by the stage and a digest of the parameters and of the files below
    the input paths; a table without its _SUCCESS mark is built anew.
    """
    state = [parameters, [file_marks(spark, p) for p in inputs]]
    tag = hashlib.md5(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{stage}-{tag}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
