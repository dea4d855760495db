"""Session settings the engine is tuned with; a cluster overrides them at submit time."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, name: str = "quern") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, wherever they start: Spark's file server hands them a copy."""
    import atexit
    import os
    import shutil
    import tempfile
    import zipfile

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    folder_ = tempfile.mkdtemp(prefix="quern-ship-")
    atexit.register(shutil.rmtree, folder_, ignore_errors=True)
    path = os.path.join(folder_, "quern-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
    return spark
