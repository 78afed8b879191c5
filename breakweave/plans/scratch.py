"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class _Scope:
    outer: _Scope | None
    paths: list[str] = field(default_factory=list)


#: Setting of Spark by which a query deletes its shuffle files when it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scope: ContextVar[_Scope | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it names none, a local session gets a temporary
    folder; on a cluster, whose executors would each write to their own disk, this is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Write ``df`` and read it back: the lineage is cut and no executor holds the only copy.

    Inside :func:`scratch_tables` the table goes with the innermost scope; the ``result`` of a scope
    belongs to the one around it. Any other goes when the application ends, so that a long-lived shared
    folder does not fill up.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    scope = _scope.get()
    if scope and result:
        scope = scope.outer
    if scope:
        scope.paths.append(path)
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    _file_system(df.sparkSession, path, "deleteOnExit")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a materialized table before its scope ends, once nothing reads it any more."""
    for p in {f.rpartition("/")[0] for f in table.inputFiles()}:
        _file_system(table.sparkSession, p, "delete", True)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted when it ends. Otherwise they stay until the driver
    happens to collect its garbage: with a large heap, all of them until the application ends."""
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def _file_system(spark: SparkSession, path: str, method: str, *more: bool) -> None:
    """A method of the Hadoop file system of a path, called with it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), method)(p, *more)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are materialized inside, at the end. What leaves the scope must be a
    materialized ``result``, or have been written elsewhere."""
    scope = _Scope(_scope.get())
    token = _scope.set(scope)
    try:
        yield
    finally:
        _scope.reset(token)
        for p in scope.paths:
            _file_system(spark, p, "delete", True)
