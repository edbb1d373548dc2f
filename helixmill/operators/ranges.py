"""Global node ranges from local ones; species tables hold a row per species."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.scan import running_total


def genome_groups(genomes: DataFrame) -> DataFrame:
    """(species, genomes, is_pan): how many genomes a species has, and whether they make a pangenome."""
    counted = genomes.groupBy("species").agg(F.count(F.lit(1)).alias("genomes"))
    return counted.withColumn("is_pan", (F.col("genomes") > 1).cast("int"))


def rebase(local: DataFrame) -> DataFrame:
    """Shift ranges (species, start, end, is_pan, ord) by the ends before them, pangenomes first, then by ``ord``."""
    moved = running_total(local, [F.desc("is_pan"), F.asc("ord")], "end", "_shift")
    return moved.select("species", (F.col("start") + F.col("_shift")).alias("start"), (F.col("end") + F.col("_shift")).alias("end"), "is_pan")


def from_counts(counts: DataFrame) -> DataFrame:
    """Consecutive ranges of ``n`` nodes per species, by ``ord``; species without a flag are left out and take no ids."""
    known = running_total(counts.filter(F.col("is_pan").isNotNull()), [F.asc("ord")], "n", "_before")
    return known.select("species", (F.col("_before") + 1).alias("start"), (F.col("_before") + F.col("n")).alias("end"), "is_pan")


def merge_databases(databases: list[DataFrame]) -> DataFrame:
    """Ranges of several databases one after the other, each shifted by the last ends of those before."""
    tagged = [db.withColumn("_db", F.lit(i)) for i, db in enumerate(databases)]
    every = reduce(DataFrame.unionByName, tagged)
    shifts = running_total(every.groupBy("_db").agg(F.max("end").alias("_last")), [F.asc("_db")], "_last", "_shift")
    moved = every.join(F.broadcast(shifts.select("_db", "_shift")), "_db")  # a row per database
    return moved.select("species", (F.col("start") + F.col("_shift")).alias("start"), (F.col("end") + F.col("_shift")).alias("end"), "is_pan")


def merge_rows(tables: list[DataFrame]) -> DataFrame:
    """Genome lists, statistics or graph tables of several databases under each other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def shift_nodes(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Species-local node ids, from 1, as ids of the combined graph."""
    return nodes.join(ranges.select("species", "start"), "species").withColumn("node_id", F.col("node_id") + F.col("start") - 1).drop("start")
