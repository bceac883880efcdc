"""Cutting a plan's lineage in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; beside the warehouse where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints").rstrip("/")


def ready(spark: SparkSession) -> None:
    """Make sure checkpoint() has a folder: the shared one, unless the session has set another."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that later work never repeats ``df``."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Send whole texts to Python in Arrow batches of few rows.

    Spark's 10,000 rows of long texts at once would take more memory than two workers beside a
    small heap have.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Shelf:
    """Tables of a job that runs in rounds, written once each to the shared folder.

    Reading them back starts a new lineage, and their sizes are known to the planner. What a round
    supersedes is removed; rows appended to a table stay one table, however many rounds there are.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/docrisk-{uuid.uuid4().hex}", 0
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` in place of the table of that name, which it may read."""
        before, self.n = self.paths.get(name), self.n + 1
        self.paths[name] = f"{self.folder}/{name}-{self.n}"
        df.write.parquet(self.paths[name])
        if before:
            self._remove(before)
        return self.get(name, df.schema)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows to the table of that name; returns all of it."""
        path = self.paths.setdefault(name, f"{self.folder}/{name}")
        df.write.mode("append").parquet(path)
        return self.get(name, df.schema)

    def get(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                self._remove(path)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
