"""Sums along an order over all partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.cut import cut


def running_total(rows: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """The rows with the sum of ``value`` over those before them in a total order; null values count as 0.

    Rows are dealt by range, summed within each range, and shifted by the totals of the ranges before: one number per
    range, which the driver adds up. No task holds more than a range.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = {r[0]: r[1] for r in dealt.groupBy("_range").agg(F.coalesce(F.sum(value), F.lit(0))).collect()}
    starts, before = [], 0
    for part in range(max(sums, default=-1) + 1):
        starts.append(before)
        before += sums.get(part, 0)
    start = F.get(F.array(*map(F.lit, starts)), F.col("_range")) if starts else F.lit(0)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn(out, start + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range")


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """The rows with their place in a total order, from 1."""
    return running_total(rows.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", out).withColumn(out, F.col(out) + 1).drop("_one")


def dealt_by_size(sizes: DataFrame, key: str, size: str, tasks: int) -> DataFrame:
    """(key, task): keys dealt to some ``tasks`` of about equal size, largest first; a task holds at most a mean task and one key more.

    Keys are lined up by size, and a mean task's stretch of that line is a task.
    """
    lined = running_total(sizes, [F.desc(size), F.asc(key)], size, "_before")
    total = sizes.agg(F.sum(size)).first()[0] or 1
    return lined.select(key, F.floor(F.col("_before") * tasks / F.lit(total)).cast("int").alias("task"))
