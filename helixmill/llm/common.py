"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.shipping import ensure_shipped

#: A word is a run of code points that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []
_written: list[str] = []
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _own_dir:
        folder = tempfile.mkdtemp(prefix="helixmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dir.append(f"file://{folder}")
    return _own_dir[0]


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_at_exit, spark)
    _written.append(path)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, materialised, without the tables that it materialised on the way: these are deleted."""
    _scopes.append([])
    try:
        frame = build()
    except BaseException:
        _delete(spark, _scopes.pop())
        raise
    inner = _scopes.pop()
    try:
        return materialize(frame, label)
    finally:
        _delete(spark, inner)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _written:
            _written.remove(name)


def remove_materialized(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote in this process; frames built on it can't be read afterwards."""
    _delete(spark, list(_written))


def _remove_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped
        remove_materialized(spark)


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(docs: DataFrame) -> Column:
    """``own``, all columns of a caller's table in one struct, so that no name clashes; ``own.*`` brings them back."""
    return F.struct(*(F.col("`{}`".format(c.replace("`", "``"))) for c in docs.columns)).alias("own")


def numbered(docs: DataFrame, label: str, **more: Column) -> DataFrame:
    """(row, own, ...): a number of each row that later reads agree on, and its columns in one struct."""
    whole = docs.select(F.monotonically_increasing_id().alias("row"), packed(docs))
    for name, value in more.items():
        whole = whole.select("*", value.alias(name))
    return materialize(whole, label)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most ``rows`` rows, read no further than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = 100_000) -> DataFrame:
    """Join; the right side, which must be cheap to read, is broadcast only if a count proves it small."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based position of each row in a total order, without gathering the rows in one task.

    Rows are dealt out by range, numbered within each range, and shifted by the sizes of the ranges before.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_range").orderBy(*order)
    numbered = dealt.withColumn("_in", F.row_number().over(inner))
    return numbered.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_in") - 1).drop("_range", "_in", "_start")


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's decimal text modulo ``buckets``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(buckets))


def lean(func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that afterwards returns what it freed to the system: workers live on, and idle ones count too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from func(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every system has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


#: Rows of a batch that a function gets at a time; what it makes of them is passed on before the next.
SLICE_ROWS = 512


def map_arrow(df: DataFrame, func: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Apply a function of one Arrow batch to all rows, a bounded number at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield func(batch.slice(start, SLICE_ROWS))

    ensure_shipped(df.sparkSession)
    return df.mapInArrow(lean(run), schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
