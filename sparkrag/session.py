"""Session settings that the plans rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  progress: bool = True) -> SparkSession:
    """A session for tests and benches; a cluster brings its own master and memory."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("sparkrag")
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    b = b.config("spark.ui.showConsoleProgress", str(progress).lower())
    spark = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver was started.

    Call it before the first query of an application; later calls do nothing.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "sparkrag.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
