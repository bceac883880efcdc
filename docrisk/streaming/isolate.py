"""Parting rows that cannot be processed from those that can.

An expression that raises ends the whole job, however many other rows it had. ``write_apart`` runs a step
over all rows; if the rows themselves are at fault, it deals them into ``FAN`` folders by a hash and tries
eighths of these, and eighths of those that fail, until every failing row stands alone with its error and
all others are written. Parts of a round are tried beside one another. A batch without such rows costs one job;
one with some costs as many rounds as it has powers of eight in its size, however many fail.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException, PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

#: Folders that rows are dealt into at once (a power of two), as bits of the hash.
BITS = 6
FAN = 1 << BITS
#: Parts that a failing one is divided into, and jobs at a time.
SPLIT, AT_ONCE = 8, 3
#: Failing rows of a batch beyond which the step, not the rows, is taken to be at fault.
MOST = 200
_HASH, _PART = "_row_hash", "_part"


class StepFails(RuntimeError):
    """More rows failed than single bad ones can explain."""


def _data_state(state: str | None) -> bool:
    """SQLSTATEs that a row's values cause: data exceptions, and errors raised on purpose."""
    return bool(state) and (state.startswith("22") or state in ("P0001", "39000", "38000"))


def data_error(failure: BaseException) -> str | None:
    """The message of an error that values of rows cause; None for all others (lost executors, full disks,
    plans that are wrong), which no division of rows mends."""
    if isinstance(failure, PythonException):
        return str(failure).strip().split("\n")[-1].strip()
    cause = getattr(failure, "java_exception", None)
    if cause is None:
        cause = getattr(failure, "_origin", None)
    while cause is not None:
        if hasattr(cause, "getSqlState") and _data_state(cause.getSqlState()):
            said = cause.getMessageParameters().get("errorMessage") if cause.getSqlState() == "P0001" else None
            return str(said or str(cause.getMessage()).split("\n")[0])
        cause = cause.getCause()
    if isinstance(failure, PySparkException) and _data_state(failure.getSqlState()):
        said = (failure.getMessageParameters() or {}).get("errorMessage")
        return str(said or str(failure).split("\n")[0])
    return None


@dataclass
class Apart:
    """What became of some rows: the folders that were written, and the rows that failed, with ``error``."""

    folders: list[str]
    failed: DataFrame

    def rows(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """What was written, in the step's schema."""
        return spark.read.schema(schema).parquet(*self.folders) if self.folders else spark.createDataFrame([], schema)


def write_apart(rows: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str, most: int = MOST) -> Apart:
    """Write ``step(rows)`` as Parquet into parts of ``folder``, without the rows at which it fails.

    ``rows`` must be written already: they are read once for each try. ``step`` must work row by row, as
    it sees a part of them at a time. Equal rows fail alike and are parted together. Raises ``StepFails``
    if more than ``most`` different rows fail: that is an outage, and the batch is tried again later.
    """
    spark, columns = rows.sparkSession, rows.columns
    folders, found, open_ = [], [], []

    def tried(part: DataFrame, name: str) -> str | None:
        """The error at which the step fails; None if it is written."""
        try:
            step(part.select(columns)).write.parquet(f"{folder}/{name}")
        except (PySparkException, Py4JJavaError) as failure:
            message = data_error(failure)
            if message is None:
                raise
            return message
        folders.append(f"{folder}/{name}")
        return None

    def deal(part: DataFrame, name: str, level: int) -> None:
        bits = F.shiftrightunsigned(_HASH, BITS * level).bitwiseAND(F.lit(FAN - 1))
        part.withColumn(_PART, bits).repartition(_PART).write.partitionBy(_PART).parquet(f"{folder}/{name}")
        there = sorted(r[0] for r in spark.read.parquet(f"{folder}/{name}").select(_PART).distinct().collect())
        size = -(-len(there) // SPLIT)
        paths = [f"{folder}/{name}/{_PART}={k}" for k in there]
        open_.extend((paths[k : k + size], level) for k in range(0, len(paths), size))

    def attempt(group: tuple[list[str], int], name: str) -> None:
        """Try a group of folders; divide it, or note its only row, if it fails."""
        parts, level = group
        # read by path: every try runs the same generated code
        part = spark.read.schema(hashed.schema).parquet(*parts)
        message = tried(part, name)
        if message is None:
            return
        if len(parts) > 1:
            size = -(-len(parts) // SPLIT)
            open_.extend((parts[k : k + size], level) for k in range(0, len(parts), size))
            return
        ends = part.agg(F.min(_HASH), F.max(_HASH)).first()
        if ends[0] == ends[1]:
            found.append((ends[0], message))
        else:
            deal(part, f"dealt-{name}", level + 1)

    hashed = rows.withColumn(_HASH, F.xxhash64(F.to_json(F.struct(*columns))))
    if tried(rows, "whole") is not None:
        deal(hashed, "dealt", 0)
    n = 0
    with ThreadPoolExecutor(AT_ONCE) as pool:
        while open_:
            now, open_[:] = open_[:], []
            names = [f"try-{n + k}" for k in range(len(now))]
            n += len(now)
            list(pool.map(inheritable_thread_target(spark)(attempt), now, names))
            if len(found) > most:
                raise StepFails(f"more than {most} rows fail, one of them with: {found[-1][1]}")
    if not found:
        return Apart(folders, rows.limit(0).withColumn("error", F.lit(None).cast("string")))
    # at most ``most`` rows
    errors = F.broadcast(spark.createDataFrame(found, f"{_HASH} bigint, error string"))
    return Apart(folders, hashed.join(errors, _HASH).select(*columns, "error"))
