"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_scopes: list[list[str]] = []


def work_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of our own where that is unset and
    Spark runs in one process."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None or not os.path.isdir(_own_root):
        _own_root = tempfile.mkdtemp(prefix="tidalframe-")
    return _own_root


def _path_and_store(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def work_path(spark: SparkSession, label: str) -> str:
    """A new path; what is written there is deleted when the application ends, or its scope()."""
    path = f"{work_root(spark)}/tidalframe-{label}-{uuid.uuid4().hex}"
    found, store = _path_and_store(spark, path)
    store.deleteOnExit(found)
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a written table: its lineage ends here, a lost executor costs only a
    reread, and the planner knows its true size when it chooses a join."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes what is written inside when it ends; for code whose result is then stored elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            found, store = _path_and_store(spark, path)
            store.delete(found, True)
