"""Cutting lineage: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[str] = []
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _own:
        folder = tempfile.mkdtemp(prefix="helixmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own.append(f"file://{folder}")
    return _own[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with its scope, by ``remove_cuts`` or when the process ends normally."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_at_exit, spark)
    _written.append(path)
    if _scopes:
        _scopes[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write and reread, so that loops don't grow the plan and shared parts are computed once: in spark.checkpoint.dir, or locally in tests."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, "round")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], made: bool = True) -> DataFrame:
    """What ``build`` returns; if it wrote tables on the way they are deleted, and the result is the one table left.

    If it isn't ``made``, the last table that ``build`` wrote is the one left, and the rows are made of it as they are asked for.
    """
    _scopes.append([])
    try:
        frame = build()
    except BaseException:
        _delete(spark, _scopes.pop())
        raise
    inner = _scopes.pop()
    if not made and inner:
        last = inner.pop()
        if _scopes:
            _scopes[-1].append(last)
        _delete(spark, inner)
        return frame
    try:
        return cut(frame) if inner else frame
    finally:
        _delete(spark, inner)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _written:
            _written.remove(name)


def remove_cuts(spark: SparkSession) -> None:
    """Delete what ``cut`` wrote in this process; frames built on it can't be read afterwards."""
    _delete(spark, list(_written))


def _remove_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped
        remove_cuts(spark)
