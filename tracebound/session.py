"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # keyed state on disk, with map state and timers
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def cluster_settings(cores: int) -> dict[str, str]:
    """Settings for a cluster with ``cores`` task slots.

    Text grows when it is exploded into lines, tags and tokens, so scans are cut into
    smaller partitions than usual. Shuffles start with many partitions and are coalesced at
    run time; a join that feeds no later use of its partitioning may always be split.
    """
    return {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(max(200, 3 * cores)),
        "spark.sql.files.maxPartitionBytes": "64m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    }


def local_session(cores: int | str = "*", app: str = "tracebound", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": "8",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
