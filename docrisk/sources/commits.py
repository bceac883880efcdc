"""Tables that are written together and seen together.

Each write of some tables goes into folders of its own, ``<table>/run=../batch=../attempt=..``; when all
of them are complete, one row in ``commits/run=../batch=..`` names the attempt. Readers take the attempts
that have such a row and no others, so what a writer left behind when it died is never seen, and the
tables of one batch appear at once. A batch that is written again after its commit changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrisk.schemas import struct

_PLACE = struct(run=T.StringType(), batch=T.LongType(), attempt=T.StringType())
_COMMIT = struct(attempt=T.StringType(), tables=T.ArrayType(T.StringType()), parts=T.ArrayType(T.StringType()))
KEYS = _PLACE.fieldNames()


def _commit_folder(path: str, run: str, batch_id: int) -> str:
    return f"{path}/commits/run={run}/batch={batch_id}"


def _there(spark: SparkSession, folder: str, schema: T.StructType | None = None, base: str | None = None) -> DataFrame | None:
    """The Parquet files of a folder; None where there is no such folder."""
    reader = spark.read if base is None else spark.read.option("basePath", base)
    try:
        return (reader if schema is None else reader.schema(schema)).parquet(folder)
    except AnalysisException as absent:
        if absent.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def is_committed(spark: SparkSession, path: str, run: str, batch_id: int) -> bool:
    there = _there(spark, _commit_folder(path, run, batch_id), _COMMIT)
    return there is not None and not there.isEmpty()


def new_attempt() -> str:
    return "a" + uuid.uuid4().hex


def write_part(df: DataFrame, path: str, table: str, run: str, batch_id: int, attempt: str) -> None:
    """One table of a batch; not seen before ``commit``."""
    df.write.parquet(f"{path}/{table}/run={run}/batch={batch_id}/attempt={attempt}")


def commit(spark: SparkSession, path: str, run: str, batch_id: int, attempt: str, tables: list[str], parts: list[str] | None = None) -> None:
    """Make the tables of an attempt seen: a file of one row, which appears whole or not at all.

    ``parts`` names what the attempt replaces, for tables that are read by parts (``latest_parts``).
    """
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    row = spark.range(1, numPartitions=1).select(F.lit(attempt).alias("attempt"), texts(tables).alias("tables"), texts(parts or []).alias("parts"))
    row.write.mode("append").parquet(_commit_folder(path, run, batch_id))


def write_tables(tables: dict[str, DataFrame], path: str, run: str, batch_id: int) -> bool:
    """Write tables as one batch; False, and nothing written, where the batch is there already."""
    spark = next(iter(tables.values())).sparkSession
    if is_committed(spark, path, run, batch_id):
        return False
    attempt = new_attempt()
    for name, df in tables.items():
        write_part(df, path, name, run, batch_id, attempt)
    commit(spark, path, run, batch_id, attempt, list(tables))
    return True


def committed(spark: SparkSession, path: str) -> DataFrame:
    """``run``, ``batch``, ``attempt``, ``tables``, ``parts``: the batches there are now, one attempt each.

    The files are listed here: tables that are read with the same listing show the same batches,
    whatever is committed meanwhile.
    """
    schema = T.StructType([*_COMMIT.fields, *_PLACE.fields[:2]])
    there = _there(spark, f"{path}/commits", schema)
    if there is None:
        return spark.createDataFrame([], schema).select(*KEYS, "tables", "parts")
    # two writers of one batch may both commit; one of them is seen, always the same
    return there.groupBy("run", "batch").agg(F.min(F.struct("attempt", "tables", "parts")).alias("c")).select("run", "batch", "c.*")


def read_committed(spark: SparkSession, path: str, table: str, schema: T.StructType, commits: DataFrame | None = None) -> DataFrame:
    """The rows of one table (``schema``) with ``run``, ``batch`` and ``attempt``, in committed batches alone."""
    commits = committed(spark, path) if commits is None else commits
    full = T.StructType([*schema.fields, *_PLACE.fields])
    there = _there(spark, f"{path}/{table}", full, f"{path}/{table}")
    if there is None:
        return spark.createDataFrame([], full)
    return there.join(commits.where(F.array_contains("tables", table)).select(*KEYS), KEYS, "left_semi").select(there.columns)


def latest_parts(commits: DataFrame) -> DataFrame:
    """``run``, ``batch``, ``attempt``, ``part``: for each part the last batch that replaced it."""
    return (
        commits.select(*KEYS, F.explode("parts").alias("part"))
        .groupBy("part").agg(F.max(F.struct("batch", "run", "attempt")).alias("c")).select("part", "c.*")
    )
