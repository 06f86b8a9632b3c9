"""Cutting lineage with tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Only where it is unset (tests, local
sessions) a folder is chosen here: a temporary one for a local master, else one below
the warehouse. Tables are Parquet, so later reads prune columns and a lost executor
costs at most the tasks that read from it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[SparkSession, str]] = []
_CHOSEN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or a folder chosen where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _CHOSEN:
        if spark.sparkContext.master.split("[")[0] == "local":
            _CHOSEN[app] = "file://" + tempfile.mkdtemp(prefix="pairweave-")
        else:
            _CHOSEN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pairweave"
    return _CHOSEN[app]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_left() -> None:
    for spark, path in _LEFT:
        with contextlib.suppress(Exception):
            _remove(spark, path)


class Scratch:
    """Tables written on the way to one result.

    ``table(df)`` writes df and returns a DataFrame over the written files.
    ``drop(df)`` removes one that no later plan reads. What a returned plan still reads
    stays until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def folder(self, name: str = "") -> str:
        """A path below the root for files that are written by other means; removed like tables."""
        path = f"{self.root}/{name}" if name else self.root
        _LEFT.append((self.spark, path))
        return path

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        _LEFT.append((self.spark, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.paths.pop(id(t), None)
            if path:
                with contextlib.suppress(Exception):
                    _remove(self.spark, path)
                _LEFT.remove((self.spark, path))
