"""Session settings the library relies on, and a local session for tests and bench."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings; safe to apply to a session somebody else created.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects keep the last of duplicate keys
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators depend on to an existing session."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares between driver and executors.

    Named by ``spark.checkpoint.dir``; where that is unset (tests), beside the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def local_session(cores: str = "8", app: str = "docrisk") -> SparkSession:
    """A local session for tests and bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # The JVM does not compile methods above 8000 bytes of bytecode. The scoring folds exceed
        # that as one whole-stage method and run several times faster as split projections.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
