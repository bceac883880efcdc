"""Document files, templates, manifests and model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrisk import dims, schemas


def _files(spark: SparkSession, path: str, deep: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(path)


def read_documents(spark: SparkSession, path: str, max_bytes: int = dims.MAX_UPLOAD_BYTES) -> DataFrame:
    """Document files that can be screened: not empty and not above the upload limit.

    The length filter reaches the file source, which then never opens the other files.
    """
    return _files(spark, path).filter((F.col("length") > 0) & (F.col("length") <= max_bytes))


def _plain(path: Column) -> Column:
    """A file's URI with one slash behind the scheme and nothing escaped."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(decoded, "^([A-Za-z0-9]+):/+", "$1:/")


def rejected_documents(
    spark: SparkSession, path: str, max_bytes: int = dims.MAX_UPLOAD_BYTES, requested: DataFrame | None = None
) -> DataFrame:
    """The files ``read_documents`` leaves out, with the reason; their content is not read.

    Spark's file sources never show empty files, so those, and missing ones, are what was requested
    and is not there: ``requested`` has the URIs in ``path`` (see the manifest). Without it, all files
    that Spark lists under ``path`` count as requested.
    """
    there = _files(spark, path).select("path", "length")
    if requested is None:
        requested = spark.createDataFrame([(p,) for p in there.inputFiles()], "path string")
    asked = requested.select(_plain(F.col("path")).alias("path")).distinct()
    found = there.withColumn("path", _plain(F.col("path")))
    absent = asked.join(found, "path", "left_anti").select("path", F.lit(0).cast("bigint").alias("length"), F.lit(dims.EMPTY_FILE).alias("error"))
    large = found.filter(F.col("length") > max_bytes).select("path", "length", F.lit(dims.TOO_LARGE).alias("error"))
    return large.unionByName(absent).select("path", "length", F.lit(False).alias("success"), "error")


def with_contents(requests: DataFrame, spark: SparkSession, path: str, max_bytes: int = dims.MAX_UPLOAD_BYTES) -> DataFrame:
    """``requests`` (doc_id, path, error, ...) with the ``content`` of the file under ``path`` that each names.

    A file that is missing or empty, or too large, is the request's ``error`` unless it has one already;
    the content of large ones is not read, nor kept for requests that have an error. Requests without a
    path, or with one that lies elsewhere, are missing their file. Rows that name the same file all get it.
    Files come in partitions bounded by bytes (``spark.sql.files.maxPartitionBytes``), and a task holds
    one of them at a time.
    """
    files = _files(spark, path)
    place = _plain(F.col("path")).alias("_place")
    small = files.filter(F.col("length") <= max_bytes).select(place, "content", F.lit(None).cast("string").alias("_large"))
    large = files.filter(F.col("length") > max_bytes).select(place, F.lit(None).cast("binary").alias("content"), F.lit(dims.TOO_LARGE).alias("_large"))
    asked = requests.withColumn("_place", F.when(F.col("error").isNull(), _plain(F.col("path"))))
    # requests that need no file do not go through the joins, where all of them would have one key
    wanting = asked.filter(F.col("_place").isNotNull()).drop("content").join(small.unionByName(large), "_place", "left")
    absent = F.when(F.length("content") > 0, F.lit(None)).otherwise(F.coalesce("_large", F.lit(dims.EMPTY_FILE)))
    found = wanting.withColumns({"error": F.coalesce("error", absent), "content": F.when(F.length("content") > 0, F.col("content"))})
    idle = asked.filter(F.col("_place").isNull()).withColumns(
        {"error": F.coalesce("error", F.lit(dims.EMPTY_FILE)), "content": F.lit(None).cast("binary")}
    )
    columns = [c for c in requests.columns if c != "content"] + ["content"]
    return found.select(*columns).unionByName(idle.select(*columns))


def _template_files(spark: SparkSession, path: str) -> DataFrame:
    """The files right under ``path`` that the fixed table names, with their banks: one row a bank at most."""
    name = F.element_at(F.split("path", "/"), -1)
    bank = F.when(F.lit(False), "")
    for key, file in dims.BANK_TEMPLATES.items():
        bank = bank.when(name == file, key)
    there = _files(spark, path, deep=False).filter((F.col("length") > 0) & (F.col("length") <= dims.MAX_UPLOAD_BYTES))
    return there.withColumns({"bank": bank, "reference": name}).filter(F.col("bank").isNotNull())


def present_templates(spark: SparkSession, path: str) -> DataFrame:
    """bank, reference of the issuer templates that are there; the files are listed, not read.

    A bank whose file is missing or empty has no row, so the flow that joins this gives it no reference.
    """
    return _template_files(spark, path).select("bank", "reference")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Issuer templates found under ``path``: bank, reference, template_content.

    Only files of the fixed table count; missing and empty ones are simply not there.
    """
    return _template_files(spark, path).select("bank", "reference", F.col("content").alias("template_content"))


def read_manifest(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Form fields and upload locations, one row per request."""
    return spark.read.schema(schemas.MANIFEST).format(fmt).load(path)


def read_model_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Model answers as text: doc_id, type, output_text."""
    return spark.read.schema(schemas.MODEL_RESPONSES).format(fmt).load(path)
