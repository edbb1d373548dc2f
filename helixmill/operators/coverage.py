"""Depth and breadth of graph nodes, and depth of node triples, from classified reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.paths import path_nodes, triple
from helixmill.operators.cut import cut
from helixmill.shipping import ensure_shipped

USED = ("rid", "species", "path", "read_start", "read_end")


def read_nodes(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per read and position: (rid, species, pos, node_id, node_len, bases, first, low, high).

    ``bases`` is what the read aligns to the node at this position: of a single node the read's span, else the rest of
    the first node, all of those between, and on the last what remains of the span. ``first`` marks a node's first
    visit, the only one that counts for depth; [low, high) is what the visit covers. Reads of one node with a negative
    span, and rows with a null, are left out.
    """
    whole = reads.dropna(subset=list(USED)).filter(F.col("species") != "U").withColumn("_ids", path_nodes(F.col("path")))
    whole = whole.withColumn("_n", F.size("_ids")).withColumn("_span", F.col("read_end") - F.col("read_start"))
    whole = whole.filter((F.col("_n") > 1) | (F.col("_span") >= 0))
    each = whole.select("rid", "species", "_n", "_span", "read_start", "read_end", F.posexplode("_ids").alias("pos", "node_id"))
    each = each.join(nodes.select("species", "node_id", "node_len"), ["species", "node_id"])
    last, lone = F.col("pos") == F.col("_n") - 1, F.col("_n") == 1
    ahead = F.when(F.col("pos") == 0, F.col("node_len") - F.col("read_start")).otherwise(F.col("node_len"))
    read = Window.partitionBy("species", "rid")
    seen = F.coalesce(F.sum("_ahead").over(read.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("_ahead", ahead).withColumn("_seen", seen)
    bases = F.when(lone, F.col("_span")).when(last, F.greatest(F.col("_span"), F.col("_seen")) - F.col("_seen")).otherwise(F.col("_ahead"))
    each = each.withColumn("bases", bases)
    fits = (F.col("read_start") < F.col("read_end")) & (F.col("read_end") <= F.col("node_len"))
    low = F.when(F.col("pos") == 0, F.col("read_start")).otherwise(F.lit(0))
    high = F.when(lone, F.when(fits, F.col("read_end"))).when(last, F.least("bases", "node_len")).otherwise(F.col("node_len"))
    visit = F.row_number().over(Window.partitionBy("species", "rid", "node_id").orderBy("pos"))
    return each.select("rid", "species", "pos", "node_id", "node_len", "bases", (visit == 1).alias("first"), low.alias("low"), high.alias("high"))


def visit_sums(visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What depth, breadth and triple depth need of the visits, summed in one pass and kept: reads are gone through once.

    Of nodes (species, node_id, low, bases, high): what first visits aligned and the longest interval, per start of
    intervals. Of three nodes in a row (species, a, b, c, bases): what first visits aligned to them.
    """
    read = Window.partitionBy("species", "rid").orderBy("pos")
    first = F.first(F.when(F.col("first"), F.col("bases")), ignorenulls=True).over(Window.partitionBy("species", "rid", "node_id"))
    steps = visits.withColumn("_own", first)
    for k in (1, 2):
        steps = steps.withColumn(f"_n{k}", F.lead("node_id", k).over(read)).withColumn(f"_o{k}", F.lead("_own", k).over(read))
    none = F.lit(None).cast("bigint")

    def part(three: bool, a, b, c, low, bases, high):
        return F.struct(F.lit(three).alias("three"), a.alias("a"), b.alias("b"), c.alias("c"), *(x.cast("bigint").alias(n) for x, n in ((low, "low"), (bases, "bases"), (high, "high"))))

    spans = F.col("high") > F.col("low")
    node = part(False, F.col("node_id"), none, none, F.when(spans, F.col("low")), F.when(F.col("first"), F.col("bases")), F.when(spans, F.col("high")))
    a, b, c = triple(F.col("node_id"), F.col("_n1"), F.col("_n2"))
    three = part(True, a, b, c, none, F.col("_own") + F.col("_o1") + F.col("_o2"), none)
    rows = steps.select("species", F.explode(F.when(F.col("_n2").isNull(), F.array(node)).otherwise(F.array(node, three))).alias("s")).select("species", "s.*")
    sums = cut(rows.groupBy("species", "three", "a", "b", "c", "low").agg(F.sum("bases").alias("bases"), F.max("high").alias("high")))
    nodes = sums.filter(~F.col("three")).select("species", F.col("a").alias("node_id"), "low", "bases", "high")
    return nodes, sums.filter("three").select("species", "a", "b", "c", "bases")


#: Reads of a species that one task takes, node lengths that travel in one row, species whose shares are broadcast.
MOST_READS, NODE_BLOCK, BROADCAST_SPECIES = 4_000_000, 1 << 16, 100_000
SUMS = "three boolean, a long, b long, c long, low long, bases long, high long"


def _reduced(keys: list[np.ndarray], added: np.ndarray, highest: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sums and maxima by key."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    if not len(at):
        return keys, added, highest
    return [k[at] for k in keys], np.add.reduceat(added[order], at), np.maximum.reduceat(highest[order], at)


def sums_of_reads(read: np.ndarray, ids: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, node_ids: np.ndarray, node_lens: np.ndarray) -> pa.RecordBatch:
    """What ``visit_sums`` says of some reads of a species: their nodes one after the other, and the lengths of its nodes.

    ``read`` numbers the reads; rows of one number, next to each other, are one read, whose visits go by their places.
    """
    steps = np.diff(offsets)
    row = np.repeat(np.arange(len(steps)), steps)
    pos = np.arange(len(ids)) - np.repeat(offsets[:-1] - offsets[0], steps)
    at = np.minimum(np.searchsorted(node_ids, ids), max(len(node_ids) - 1, 0))
    known = node_ids[at] == ids if len(node_ids) else np.zeros(len(ids), bool)
    row, pos, ids, size = row[known], pos[known], ids[known], node_lens[at[known]] if len(node_ids) else node_lens
    if (read[1:] == read[:-1]).any():
        by = np.lexsort((pos, read[row]))
        row, pos, ids, size = row[by], pos[by], ids[by], size[by]
    of = read[row]
    span, n = (end - start)[row], steps[row]
    lone, last, head = n == 1, pos == n - 1, pos == 0
    ahead = np.where(head, size - start[row], size)
    before = np.cumsum(ahead) - ahead
    begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
    seen = before - np.repeat(before[begins], np.diff(np.r_[begins, len(row)]))
    bases = np.where(lone, span, np.where(last, np.maximum(span, seen) - seen, ahead))
    low = np.where(head, start[row], 0)
    fits = (start[row] < end[row]) & (end[row] <= size)
    high = np.where(lone, np.where(fits, end[row], -1), np.where(last, np.minimum(bases, size), size))
    spans = (high > low) & (~lone | fits)
    order = np.lexsort((ids, of))
    first = np.ones(len(order), bool)
    first[1:] = (of[order][1:] != of[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    own, visit = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
    own[order] = bases[order][np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else 0
    visit[order] = first
    none = np.iinfo(np.int64).min
    (node, begin), added, highest = _reduced([ids, np.where(spans, low, none)], np.where(visit, bases, 0), np.where(spans, high, none))
    k = np.flatnonzero(of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, np.int64)
    three, total, _ = _reduced([np.minimum(ids[k], ids[k + 2]), ids[k + 1], np.maximum(ids[k], ids[k + 2])], own[k] + own[k + 1] + own[k + 2], k)
    nulls = lambda x, y, where=None: pa.array(np.r_[x, y], pa.int64(), mask=where)
    m, t = len(node), len(total)
    rest, empty = np.r_[np.ones(m, bool), np.zeros(t, bool)], np.zeros(t, np.int64)
    return pa.record_batch({
        "three": pa.array(~rest), "a": nulls(node, three[0]), "b": nulls(np.zeros(m, np.int64), three[1], rest), "c": nulls(np.zeros(m, np.int64), three[2], rest),
        "low": nulls(begin, empty, np.r_[begin == none, np.ones(t, bool)]), "bases": nulls(added, total), "high": nulls(highest, empty, np.r_[highest == none, np.ones(t, bool)]),
    })


def _changes(column: pa.Array) -> np.ndarray:
    """Which values, from the second on, differ from the one before."""
    return pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0))).fill_null(True).to_numpy(zero_copy_only=False)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (species, salt, reads last, block, rid), (species, salt, block, ids, lens, read_start, read_end, rid) -> sums of reads."""
    now: tuple | None = None
    nodes: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[pa.RecordBatch] = []  # rows of the last read, which may go on

    def told(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal nodes
        if len(nodes) != 1:
            nodes = [tuple(np.concatenate(x) for x in zip(*nodes))] if nodes else [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        table = pa.Table.from_batches(rows).combine_chunks()
        column = lambda i: table.column(i).chunk(0) if table.num_rows else table.column(i).combine_chunks()
        read = np.cumsum(np.r_[0, _changes(column(7))].astype(np.int64))
        start, end = (np.asarray(column(i), np.int64) for i in (5, 6))
        made = sums_of_reads(read, np.asarray(column(3).flatten(), np.int64), np.asarray(column(3).offsets, np.int64), start, end, *nodes[0])
        return pa.record_batch({"species": pa.array([now[0]] * made.num_rows, table.schema.field(0).type)} | {n: made.column(n) for n in made.schema.names})

    for batch in batches:
        if not batch.num_rows:
            continue
        rid, is_read = batch.column(7), batch.column(2).is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(_changes(batch.column(0)) | _changes(batch.column(1)) | (is_read[1:] != is_read[:-1])) + 1
        begins = np.flatnonzero(np.r_[True, _changes(rid)])
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = (batch.column(0)[s].as_py(), batch.column(1)[s].as_py())
            if key != now:
                if waiting:
                    yield told(waiting)
                now, nodes, waiting = key, [], []
            if not is_read[s]:
                part = batch.slice(s, e - s)
                nodes.append(tuple(np.asarray(part.column(i).flatten(), np.int64) for i in (3, 4)))
                continue
            last = max(s, int(begins[np.searchsorted(begins, e) - 1]))
            if last > s or (waiting and waiting[-1].column(7)[-1].as_py() != rid[s].as_py()):
                yield told([*waiting, batch.slice(s, last - s)])
                waiting = []
            waiting.append(batch.slice(last, e - last))
    if waiting:
        yield told(waiting)


def read_sums(reads: DataFrame, nodes: DataFrame, most_reads: int = MOST_READS) -> tuple[DataFrame, DataFrame]:
    """``visit_sums(read_nodes(reads, nodes))`` without a row per visit: a read travels once, to the node lengths of its species.

    A species with many reads is dealt to several tasks, each with the lengths of its nodes, which come first and packed;
    what a read aligns to its nodes is summed along the read, and over the reads of a batch, before anything is shuffled
    again. A task holds the node lengths of one species.
    """
    spark = reads.sparkSession
    ensure_shipped(spark)
    whole = reads.dropna(subset=list(USED)).filter(F.col("species") != "U")
    whole = whole.select("rid", "species", path_nodes(F.col("path")).alias("ids"), F.col("read_start").cast("long").alias("read_start"), F.col("read_end").cast("long").alias("read_end"))
    kept = cut(whole.filter((F.size("ids") > 1) | (F.col("read_end") >= F.col("read_start"))))
    shares = cut(kept.groupBy("species").agg(F.ceil(F.count(F.lit(1)) / most_reads).cast("int").alias("salts")))
    few = shares.limit(BROADCAST_SPECIES + 1).count() <= BROADCAST_SPECIES
    of = F.broadcast(shares) if few else shares
    none = F.lit(None).cast("long")
    salted = kept.join(of, "species").select("species", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int").alias("salt"), none.alias("block"), "ids", F.lit(None).cast("array<bigint>").alias("lens"), "read_start", "read_end", "rid")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("node_id").cast("long").alias("id"), F.col("node_len").cast("long").alias("len"))))
    packed = nodes.filter("node_len is not null").join(of, "species").groupBy("species", "salts", F.expr(f"node_id div {NODE_BLOCK}").alias("block")).agg(pairs.alias("p"))
    packed = packed.select("species", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("block").cast("long").alias("block"), F.col("p.id").alias("ids"), F.col("p.len").alias("lens"), none.alias("read_start"), none.alias("read_end"), F.lit(None).cast(reads.schema["rid"].dataType).alias("rid"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed.union(salted).repartition(tasks, "species", "salt").sortWithinPartitions("species", "salt", F.col("block").asc_nulls_last(), "rid")
    kind = reads.schema["species"].dataType.simpleString()
    rows = dealt.mapInArrow(_summed, f"species {kind}, {SUMS}")
    sums = cut(rows.groupBy("species", "three", "a", "b", "c", "low").agg(F.sum("bases").alias("bases"), F.max("high").alias("high")))
    return sums.filter(~F.col("three")).select("species", F.col("a").alias("node_id"), "low", "bases", "high"), sums.filter("three").select("species", "a", "b", "c", "bases")


def depth_of_sums(node_sums: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_depth`` from the sums of ``visit_sums``."""
    return node_depth(node_sums.withColumn("first", F.lit(True)), nodes)


def breadth_of_sums(node_sums: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_breadth`` from the sums of ``visit_sums``."""
    return node_breadth(node_sums, nodes)


def triple_depth_of_sums(triple_sums: DataFrame, haps: DataFrame) -> DataFrame:
    """``triple_depth`` from the sums of ``visit_sums``."""
    out = haps.join(triple_sums, ["species", "a", "b", "c"], "left").withColumn("bases", F.coalesce("bases", F.lit(0)))
    return out.withColumn("depth", F.try_divide("bases", "trio_len"))


def node_depth(visits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(species, node_id, node_len, bases, depth) of every node of the graph."""
    sums = visits.filter("first").groupBy("species", "node_id").agg(F.sum("bases").alias("bases"))
    every = nodes.join(sums, ["species", "node_id"], "left").withColumn("bases", F.coalesce("bases", F.lit(0)))
    return every.select("species", "node_id", "node_len", "bases", F.try_divide("bases", "node_len").alias("depth"))


def node_breadth(visits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(species, node_id, covered): positions of a node that some read covers.

    Intervals are merged in order of their starts. Those that start together are reduced to the longest before the
    shuffle, so that a node's window holds at most as many rows as the node has positions.
    """
    spans = visits.filter("high > low").groupBy("species", "node_id", "low").agg(F.max("high").alias("high"))
    before = Window.partitionBy("species", "node_id").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    added = F.greatest(F.lit(0), F.col("high") - F.greatest(F.col("low"), F.coalesce(F.max("high").over(before), F.lit(0))))
    sums = spans.withColumn("_new", added).groupBy("species", "node_id").agg(F.sum("_new").alias("covered"))
    return nodes.join(sums, ["species", "node_id"], "left").select("species", "node_id", F.coalesce("covered", F.lit(0)).alias("covered"))


def walk_triples(walks: DataFrame) -> DataFrame:
    """(species, hap_id, pos, a, b, c): every three consecutive nodes of a walk."""
    walk = Window.partitionBy("species", "hap_id").orderBy("pos")
    ahead = walks.withColumn("_b", F.lead("node_id", 1).over(walk)).withColumn("_c", F.lead("node_id", 2).over(walk))
    return ahead.filter("_c is not null").select("species", "hap_id", "pos", *triple(F.col("node_id"), F.col("_b"), F.col("_c")))


def incidence(walks: DataFrame) -> DataFrame:
    """(species, hap_id, node_id): which nodes a haplotype visits, however often.

    Rows are dealt out before equal ones are dropped: few are equal, and a task of the input would hold almost all of its own.
    """
    keys = ["species", "hap_id", "node_id"]
    tasks = int(walks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return walks.select(*keys).repartition(tasks, *keys).distinct()


def path_index(walks: DataFrame) -> DataFrame:
    """(species, hap_id, path_index): haplotypes of a species numbered in the order of their names."""
    order = Window.partitionBy("species").orderBy("hap_id")
    return walks.select("species", "hap_id").distinct().withColumn("path_index", F.row_number().over(order) - 1)


def unique_triples(triples: DataFrame) -> DataFrame:
    """(species, a, b, c, hap_id) of triples that occur once in all walks of the species."""
    return triples.groupBy("species", "a", "b", "c").agg(F.count(F.lit(1)).alias("_n"), F.min("hap_id").alias("hap_id")).filter("_n = 1").drop("_n")


def triple_haps(unique: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unique triples with ``trio_len``, the sum of their nodes' lengths: the incidence of triples and haplotypes in long form."""
    out = unique
    for end in "abc":
        out = out.join(nodes.select("species", F.col("node_id").alias(end), F.col("node_len").alias(f"_{end}")), ["species", end])
    return out.select("species", "a", "b", "c", "hap_id", (F.col("_a") + F.col("_b") + F.col("_c")).alias("trio_len"))


def triple_depth(visits: DataFrame, haps: DataFrame) -> DataFrame:
    """(species, a, b, c, hap_id, trio_len, bases, depth) of the unique triples; a node counts what its first visit aligned."""
    first = F.first(F.when(F.col("first"), F.col("bases")), ignorenulls=True).over(Window.partitionBy("species", "rid", "node_id"))
    read = Window.partitionBy("species", "rid").orderBy("pos")
    steps = visits.withColumn("_own", first)
    for k in (1, 2):
        steps = steps.withColumn(f"_n{k}", F.lead("node_id", k).over(read)).withColumn(f"_o{k}", F.lead("_own", k).over(read))
    seen = steps.filter("_n2 is not null").select("species", *triple(F.col("node_id"), F.col("_n1"), F.col("_n2")), (F.col("_own") + F.col("_o1") + F.col("_o2")).alias("_bases"))
    sums = seen.groupBy("species", "a", "b", "c").agg(F.sum("_bases").alias("bases"))
    return triple_depth_of_sums(sums, haps)


def path_breadth(walks: DataFrame, nodes: DataFrame, breadth: DataFrame) -> DataFrame:
    """(species, hap_id, path_base_cov): covered share of a walk's distinct nodes."""
    held = walks.select("species", "hap_id", "node_id").distinct().join(nodes, ["species", "node_id"]).join(breadth, ["species", "node_id"])
    sums = held.groupBy("species", "hap_id").agg(F.sum("covered").alias("_c"), F.sum("node_len").alias("_l"))
    return sums.select("species", "hap_id", F.try_divide("_c", "_l").alias("path_base_cov"))
