"""Reads to species: a containment join of node intervals, and what follows per read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.paths import node_bounds

UNCLASSIFIED = "U"
#: Node ids per bucket, and bucket rows of ranges up to which they are broadcast, and only after a count.
WIDTH, BROADCAST_ROWS = 128, 200_000


def _bounded(reads: DataFrame) -> DataFrame:
    low, high = node_bounds(F.col("path"))
    return reads.withColumn("_low", low).withColumn("_high", high)


def _bucketed(ranges: DataFrame, width: int) -> DataFrame:
    """Ranges once for each bucket of node ids that they touch."""
    buckets = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}")))
    return ranges.select(F.col("species").alias("_species"), F.col("start").alias("_start"), F.col("end").alias("_end"), buckets.alias("_bucket"))


def _contained(reads: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """``reads`` with the species of the bucketed range that holds all nodes: a read meets the ranges of its first bucket only."""
    asked = _bounded(reads).withColumn("_bucket", F.expr(f"_low div {width}"))
    inside = (asked["_bucket"] == held["_bucket"]) & (F.col("_low") >= F.col("_start")) & (F.col("_high") <= F.col("_end"))
    return asked.join(held, inside, "left").select(*reads.columns, F.coalesce("_species", F.lit(UNCLASSIFIED)).alias("species"))


def classify_by_range(reads: DataFrame, ranges: DataFrame) -> DataFrame:
    """``reads`` (path, ...) with the species whose node range holds all of a path's nodes, else ``U``.

    Ranges (species, start, end) are disjoint. They are dealt to buckets of node ids, so that a read isn't compared with
    all of them; few bucket rows are broadcast, and reads then stay where they are.
    """
    held = _bucketed(ranges, WIDTH)
    few = held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return _contained(reads, F.broadcast(held) if few else held, WIDTH)


def classify_by_bucket(reads: DataFrame, ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """The same with both sides dealt by bucket, whatever the number of ranges."""
    return _contained(reads, _bucketed(ranges, width), width)


def overlap_any(reads: DataFrame, ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """The first range, by ``ord``, that holds a path's smallest or largest node; null if none does."""
    buckets = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}")))
    held = ranges.select("species", "start", "end", "ord", buckets.alias("_bucket"))
    ends = _bounded(reads).select("rid", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_node")).withColumn("_bucket", F.expr(f"_node div {width}"))
    hit = ends.join(held, "_bucket").filter("_node between start and end")
    first = hit.groupBy("rid").agg(F.min_by("species", "ord").alias("species"))
    return reads.select("rid").join(first, "rid", "left")


def unique_read_ids(classified: DataFrame) -> DataFrame:
    """Alignments whose read falls in one species only; the k-th alignment of a read is renamed ``id_k`` from the second on.

    ``rid`` orders the alignments of a read.
    """
    read = Window.partitionBy("read_id")
    marked = classified.withColumn("_low", F.min("species").over(read)).withColumn("_high", F.max("species").over(read))
    numbered = marked.filter("_low = _high").withColumn("_k", F.row_number().over(read.orderBy("rid")))
    name = F.when(F.col("_k") == 1, F.col("read_id")).otherwise(F.concat_ws("_", "read_id", "_k"))
    return numbered.withColumn("unique_id", name).drop("_low", "_high", "_k")


def best_alignments(alignments: DataFrame, least_mapq: int = 20, least_span: int = 1000) -> DataFrame:
    """One row per read: of the alignments with most matches, then identity, one that is over both limits.

    The best is taken over all alignments first; a read whose best ones are under a limit gives none.
    """
    read = Window.partitionBy("read_id")
    top = F.max(F.struct("matches", "identity")).over(read)
    best = alignments.withColumn("_top", top).filter((F.col("_top.matches") == F.col("matches")) & (F.col("_top.identity") == F.col("identity")))
    good = best.filter((F.col("mapq") > least_mapq) & (F.col("span") > least_span))
    return good.withColumn("_k", F.row_number().over(read.orderBy("rid"))).filter("_k = 1").drop("_top", "_k")
