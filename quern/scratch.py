"""Intermediate tables that cut lineage.

``Scratch.cut`` writes a DataFrame as Parquet below the folder named by
``spark.checkpoint.dir`` (shared by driver and executors) and reads it back, so
later stages restart from files rather than from a long lineage, and the loss of
an executor loses nothing.  Only where the setting is absent *and* the master is
local does a private temporary folder stand in for it.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_READ_BATCH = "spark.sql.parquet.columnarReaderBatchSize"
_local_root: str | None = None
_open: list["Scratch"] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it."""
    global _local_root
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="quern-scratch-")
    return f"file://{_local_root}"


@contextmanager
def _set_for_write(spark: SparkSession, settings: dict[str, str]):
    """Session settings that hold while a table is written."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def roots_read(df: DataFrame) -> set[str]:
    """The folders and files that a DataFrame's plan reads tables from."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(k).toString() for k in range(roots.size())}
    return out


class Scratch:
    """A set of intermediate tables that are deleted together: by ``close``, at the end of a ``with``, or at exit."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        _open.append(self)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def cut(self, df: DataFrame, name: str = "table", rows_per_batch: int | None = None) -> DataFrame:
        """Write ``df`` below the shared folder and return the table as read from there.

        Spark drops the job's shuffle files as it ends.  ``rows_per_batch`` bounds what the job
        reads and a Python function of it gets at once, for rows that may be long.
        """
        path = f"{checkpoint_root(self.spark)}/quern-{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        settings = {_CLEANUP: "true"} | ({_BATCH: str(rows_per_batch), _READ_BATCH: str(max(rows_per_batch, 8))} if rows_per_batch else {})
        with _set_for_write(self.spark, settings):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read_by(self, *dfs: DataFrame) -> bool:
        """Does the plan of any of them read any of the tables?"""
        bare = lambda path: re.sub("^file:/+", "/", path)
        mine = {bare(p) for p in self.paths}
        return any(not mine.isdisjoint(map(bare, roots_read(df))) for df in dfs)

    def close(self) -> None:
        """Delete the tables; DataFrames that still read them become invalid."""
        paths, self.paths = self.paths, []
        if self in _open:
            _open.remove(self)
        try:
            jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
            for path in paths:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: a local scratch folder goes with the process
            pass


@atexit.register
def _close_all() -> None:
    for scratch in list(_open):
        if scratch.spark.sparkContext._jsc is not None:
            scratch.close()
    if _local_root is not None:
        shutil.rmtree(_local_root, ignore_errors=True)
