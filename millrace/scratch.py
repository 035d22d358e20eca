"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


class Scope:
    """The scratch tables made within a block of one thread; see :func:`temporary`."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, path: str) -> None:
        """Leaves a table in place at the end."""
        self.kept.add(path)


#: The innermost scope of the present thread or task; other threads have their own.
_SCOPE: ContextVar[Scope | None] = ContextVar("millrace_scope", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder is made, but only under a ``local`` master, where driver and executors are one
    process; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _LOCAL_SCRATCH:
        import shutil
        import tempfile

        _LOCAL_SCRATCH["root"] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH["root"], ignore_errors=True)
    return "file://" + _LOCAL_SCRATCH["root"]


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; what is there when the driver's JVM ends is deleted, if no scope has done so."""
    path = f"{scratch_root(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    system, target = _hadoop(spark, path)
    system.deleteOnExit(target)
    scope = _SCOPE.get()
    if scope is not None:
        scope.paths.append(path)
    return path


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """:func:`materialize` with the table's path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and reads it back: cuts the lineage, survives lost executors."""
    return write_table(df, label)[0]


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes one scratch table."""
    system, target = _hadoop(spark, path)
    system.delete(target, True)
    system.cancelDeleteOnExit(target)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Scope]:
    """Deletes the scratch tables that the calling thread makes within, at its end, but for those it keeps.

    What is computed within must be written (or otherwise used up) within.  A kept table belongs to the outer scope, if
    there is one.
    """
    outer, scope = _SCOPE.get(), Scope()
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        for path in scope.paths:
            if path not in scope.kept:
                drop_scratch(spark, path)
            elif outer is not None:
                outer.paths.append(path)
