"""Statistics of sequence files (genome, seq_id, seq), and linear graphs of single genomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024
LEAST_CONTIG = 500


def _count(seq: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(seq, f"[^{letters}]", ""))


def nxx(lengths: DataFrame, keys: list[str], share: float, name: str, ceil: bool = True) -> DataFrame:
    """The length at which the running sum of lengths, longest first, reaches a share of the total.

    Equal lengths are counted before the shuffle, so that a large genome's window holds its distinct lengths only.
    """
    cells = lengths.groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    mass = F.col("len") * F.col("_n")
    asked = F.sum(mass).over(group) * F.lit(share)
    running = F.sum(mass).over(group.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0))
    reached = cells.withColumn("_asked", F.ceil(asked) if ceil else asked).withColumn("_run", running)
    return reached.filter("_run >= _asked").groupBy(*keys).agg(F.max("len").alias(name))


def sequence_stats(seqs: DataFrame, ignore_case: bool = True, keys: tuple[str, ...] = ("genome",)) -> DataFrame:
    """Per genome n, total, gap, avg, n50, n90, longest, shortest, gc (percent of what isn't N)."""
    letters = ("Nn", "GgCc") if ignore_case else ("N", "GC")
    keys = list(keys)
    each = seqs.select(*keys, F.length("seq").cast("bigint").alias("len"), _count(F.col("seq"), letters[0]).alias("_n"), _count(F.col("seq"), letters[1]).alias("_gc"))
    sums = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"), F.sum("_n").cast("bigint").alias("gap"), F.avg("len").alias("avg"),
        F.max("len").alias("longest"), F.min("len").alias("shortest"), F.sum("_gc").alias("_gc"),
    )
    for share, name in ((0.5, "n50"), (0.9, "n90")):
        sums = sums.join(nxx(each.select(*keys, "len"), keys, share, name, ceil=ignore_case), keys, "left")
    gc = F.try_divide(100.0 * F.col("_gc"), F.col("total") - F.col("gap"))
    return sums.select(*keys, "n", "total", "gap", "avg", "n50", "n90", "longest", "shortest", gc.alias("gc"))


def contigs(seqs: DataFrame, least: int = 0) -> DataFrame:
    """Sequences cut at runs of N, those of at least ``least`` letters."""
    parts = F.filter(F.split("seq", "N+"), lambda x: F.length(x) >= max(1, least))
    return seqs.select("genome", "seq_id", F.explode(parts).alias("seq"))


def assembly_report(seqs: DataFrame, least: int = LEAST_CONTIG) -> DataFrame:
    """Statistics of scaffolds, contigs and long contigs under each other, named by ``level``."""
    levels = {"scaffold": seqs, "contig": contigs(seqs), "long_contig": contigs(seqs, least)}
    tagged = [rows.select("genome", F.lit(level).alias("level"), "seq") for level, rows in levels.items()]
    every = tagged[0].union(tagged[1]).union(tagged[2])
    return sequence_stats(every, ignore_case=False, keys=("genome", "level"))


def chunked(seqs: DataFrame, width: int = CHUNK) -> DataFrame:
    """(genome, seq_id, node_id, node_len, chunk): a sequence as consecutive nodes of at most ``width`` letters, from 1."""
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    each = seqs.filter(F.length("seq") > 0).select("genome", "seq_id", F.posexplode(cut).alias("_i", "chunk"))
    return each.select("genome", "seq_id", (F.col("_i") + 1).cast("bigint").alias("node_id"), F.length("chunk").cast("bigint").alias("node_len"), "chunk")


def linear_gfa(seqs: DataFrame, width: int = CHUNK) -> DataFrame:
    """Lines (genome, seq_id, ord, value) of a linear graph per sequence: header, nodes, links and one walk."""
    nodes = chunked(seqs, width)
    s = nodes.select("genome", "seq_id", F.col("node_id").alias("ord"), F.concat_ws("\t", F.lit("S"), "node_id", "chunk").alias("value"), F.lit(1).alias("part"))
    after = F.col("node_id") + 1
    last = F.max("node_id").over(Window.partitionBy("genome", "seq_id"))
    link = F.concat_ws("\t", F.lit("L"), "node_id", F.lit("+"), after, F.lit("+"), F.lit("0M"))
    links = nodes.withColumn("_last", last).filter("node_id < _last").select("genome", "seq_id", F.col("node_id").alias("ord"), link.alias("value"), F.lit(2).alias("part"))
    ids = F.sequence(F.lit(1), F.ceil(F.length("seq") / width).cast("int"))
    steps = F.concat(F.lit(">"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ">"))
    walk = F.concat_ws("\t", F.lit("W"), "genome", F.lit("0"), "seq_id", F.lit("0"), F.length("seq"), steps)
    walks = seqs.filter(F.length("seq") > 0).select("genome", "seq_id", F.lit(0).cast("bigint").alias("ord"), walk.alias("value"), F.lit(3).alias("part"))
    heads = seqs.select("genome", "seq_id", F.lit(0).cast("bigint").alias("ord"), F.lit("H\tVN:Z:1.1").alias("value"), F.lit(0).alias("part"))
    return heads.union(s).union(links).union(walks)


def mean_lengths(genomes: DataFrame) -> DataFrame:
    """(species, len): mean genome length of each species (species, length)."""
    return genomes.groupBy("species").agg(F.avg("length").alias("len"))
