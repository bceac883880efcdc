"""Single files and work folders in whatever store they are in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that a job of ours made, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_file(spark: SparkSession, file: str, content: bytes) -> None:
    """Write one small file through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
