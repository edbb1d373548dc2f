"""Stages whose results are kept: a run that was cut off goes on where it stopped, and what changed is done again."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """A stage's rows, and the key of all that they were made from."""

    rows: DataFrame
    key: str


class Manifest:
    """A folder with a table for each stage and each of the inputs and options it was run with.

    A stage's key is a digest of its name, its options, and the fingerprints of its inputs: of files their paths, sizes and
    times, of earlier stages their keys. A table is written elsewhere and published by one rename, so that a folder named by
    a key is always whole. Where a store has no atomic rename, a folder without Spark's success file isn't taken.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.used: set[str] = set()
        self.made: list[str] = []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def files(self, *paths: str) -> str:
        """A fingerprint of all files under some paths, which may hold wildcards."""
        seen = []
        for path in paths:
            where = self._path(path)
            fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for found in fs.globStatus(where) or []:
                walk = fs.listFiles(found.getPath(), True) if found.isDirectory() else None
                while walk is None or walk.hasNext():
                    one = found if walk is None else walk.next()
                    seen.append([one.getPath().toString(), one.getLen(), one.getModificationTime()])
                    if walk is None:
                        break
        return _digest(sorted(seen))

    def stage(self, name: str, made_from: list[str], options: dict, build: Callable[[], DataFrame]) -> Stage:
        """The stage's rows: those on record for this key, or what ``build`` returns, once it is written and published."""
        key = _digest([name, made_from, options])
        target = f"{self.folder}/{name}-{key[:24]}"
        self.used.add(target.rsplit("/", 1)[1])
        if not self._fs.exists(self._path(f"{target}/rows/_SUCCESS")):
            writing = f"{self.folder}/.writing-{uuid.uuid4().hex}"
            build().write.parquet(f"{writing}/rows")
            out = self._fs.create(self._path(f"{writing}/made_from.json"))
            out.write(bytearray(json.dumps({"stage": name, "key": key, "made_from": made_from, "options": options}, sort_keys=True, default=str).encode()))
            out.close()
            self._fs.delete(self._path(target), True)  # what a store without atomic renames may have left
            if not self._fs.rename(self._path(writing), self._path(target)):
                raise OSError(f"{target} can't be published")
            self.made.append(name)
        return Stage(self.spark.read.parquet(f"{target}/rows"), key)

    def remove_unused(self) -> None:
        """Delete the tables of stages that this run didn't use, and what broken runs left."""
        for found in self._fs.listStatus(self._path(self.folder)) if self._fs.exists(self._path(self.folder)) else []:
            if found.getPath().getName() not in self.used:
                self._fs.delete(found.getPath(), True)


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Copy a report's only part file to a path of its own; readers see all of it or, until one rename, the old one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(conf)
    parts = [x.getPath() for x in fs.globStatus(path(f"{source}/part-*")) or []]
    if len(parts) != 1:
        raise ValueError(f"{source} has {len(parts)} part files, one is needed")
    to = path(target).getFileSystem(conf)
    folder = target.rsplit("/", 1)[0]
    waiting = path(f"{folder}/.publishing-{uuid.uuid4().hex}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, parts[0], to, waiting, False, conf)
    to.delete(path(target), False)
    if not to.rename(waiting, path(target)):
        raise OSError(f"{target} can't be published")
