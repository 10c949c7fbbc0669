"""Intermediate tables that survive the loss of executors.

A plan that is read more than once is written to the folder which the cluster names in
spark.checkpoint.dir (shared storage), as Parquet, and read back: lineage ends there, the file
sizes give the planner real statistics, and no executor holds the only copy.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets a temporary one, as in tests; on a cluster
    that would part the tables among machines, so there it is an error."""
    folder = spark.conf.get(_KEY, None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tesserine-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there is removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Run `df` once, write it as a table in the shared folder and return that table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Folder:
    """Names of whole entries below a folder of shared storage; an entry is whole once its _SUCCESS is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, kind: str, inside: str = "") -> list[str]:
        where = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(where):
            return []
        whole = [s for s in self._fs.listStatus(where) if self._fs.exists(self._path(s.getPath(), f"{inside}_SUCCESS"))]
        return sorted(s.getPath().getName() for s in whole)

    def read(self, kind: str, names: list[str], schema: T.StructType | str, inside: str = "") -> DataFrame:
        """The entries as one table, in one scan however many they are."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{kind}/{n}{inside}" for n in names))
