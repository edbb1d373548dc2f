"""Containment of sequences in reads by shared k-mers, whole or as FracMinHash sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.cluster import components
from helixmill.operators.cut import cut
from helixmill.shipping import ensure_shipped

#: Letters per block when k-mers are cut, so that a long sequence isn't searched from its start for each.
BLOCK = 256
#: k-mers of items up to this many are broadcast.
BROADCAST_GRAMS = 500_000


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once per row and not for each step of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_grams(text: Column, k: int) -> Column:
    """Distinct runs of k words."""

    def cut(words: Column) -> Column:
        ahead = F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
        return F.array_distinct(F.transform(ahead, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, k)])))

    return _once(F.split(text, " "), cut)


def letter_grams(seq: Column, k: int) -> Column:
    """Distinct k-mers; blocks of the sequence are continued by the start of the next."""

    def cut(blocks: Column) -> Column:
        wide = F.transform(blocks, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(blocks, i + 1), 1, k - 1), F.lit(""))))

        def of(block: Column) -> Column:
            last = F.length(block) - (k - 1)
            starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.substring(block, i, F.lit(k)))

        return F.array_distinct(F.flatten(F.transform(wide, of)))

    return _once(F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{max(BLOCK, k)}}}"), F.lit(0)), cut)


def sketched(rows: DataFrame, grams: Column, scale: int = 1) -> DataFrame:
    """One row per distinct k-mer hash; of ``scale`` hashes one is kept, the same ones in every sketch."""
    hashed = rows.withColumn("gram", F.explode(F.transform(grams, lambda g: F.xxhash64(g))))
    return hashed.filter(F.pmod("gram", F.lit(scale)) == 0) if scale > 1 else hashed


def containment(items: DataFrame, corpus: DataFrame, k: int | None = None) -> DataFrame:
    """(item_id, grams, shared, containment, ani): share of an item's k-mers (item_id, gram) found in the corpus (gram).

    Of the corpus only k-mers that some item has are kept before any of it moves; the items' are broadcast if a count
    finds them few. With the k-mer length the average nucleotide identity follows as containment ** (1/k).
    """
    asked = items.select("gram").distinct()
    few = asked.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    known = corpus.select("gram").join(F.broadcast(asked) if few else asked, "gram", "left_semi").distinct().withColumn("_hit", F.lit(1))
    sums = items.select("item_id", "gram").distinct().join(known, "gram", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("grams"), F.count("_hit").alias("shared"))
    share = F.col("shared") / F.col("grams")
    out = sums.withColumn("containment", share)
    return out.withColumn("ani", F.pow(share, F.lit(1.0 / k)) * 100) if k else out


def retain(hits: DataFrame, least: float = 99.0) -> DataFrame:
    """Sketch hits (genome_path, seq_name, ani) of at least an identity."""
    return hits.filter(F.col("ani") >= least)


#: Min-hash bands and hashes per band: sketches whose Jaccard similarity is 0.64, some 95 % identity at k = 5, share none once in 200,000.
BANDS, BAND_HASHES = 40, 3
#: Genomes of a band that one task compares with as many others, and genomes whose whole sketches a task holds beside as many others.
BAND_BLOCK = 256
#: Genomes up to this many are broadcast, and only after a count.
BROADCAST_GENOMES = 500_000

_ODD = np.random.default_rng(20_240_229).integers(1 << 62, 1 << 63, BANDS * BAND_HASHES + 2).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits stirred."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, genome, grams) -> (label, genome, n, x, s, t, keys) of those with grams: size, three digests of the set, a key for each band."""
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))  # a null goes too
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        size = np.asarray(lists.value_lengths(), np.int64)
        first = np.r_[0, np.cumsum(size)[:-1]]
        gram = np.asarray(lists.flatten(), np.int64).view(np.uint64)
        mixed = _mixed(gram)
        part = np.empty_like(mixed)
        sums = [np.add.reduceat(_mixed(np.multiply(mixed, odd, out=part)), first) for odd in _ODD[-2:]]
        keys = np.empty((len(size), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(size), band, np.uint64)
            for odd in _ODD[band * BAND_HASHES : (band + 1) * BAND_HASHES]:
                np.multiply(mixed, odd, out=part)
                part ^= part >> np.uint64(32)
                key = _mixed(key ^ np.minimum.reduceat(part, first)) + odd
            keys[:, band] = key
        told = [np.bitwise_xor.reduceat(gram, first), *sums]
        at = np.arange(0, keys.size + 1, BANDS, dtype=np.int32)
        yield pa.record_batch({
            "label": batch.column(0), "genome": batch.column(1), "n": pa.array(size), **{k: pa.array(v.view(np.int64)) for k, v in zip("xst", told)},
            "keys": pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64)))})


def packed(rows: DataFrame) -> DataFrame:
    """Whole sketches (label, genome, grams) of rows (label, genome, grams), each gram once; nothing moves if no genome has several rows."""
    rows = rows.filter("label is not null and genome is not null")
    if rows.groupBy("label", "genome").count().filter("count > 1").limit(1).count():
        rows = cut(rows.groupBy("label", "genome").agg(F.flatten(F.collect_list("grams")).alias("grams")))
    return rows.select("label", "genome", F.array_distinct("grams").alias("grams"))  # a filter by size would make the grams twice


def _beside(few: DataFrame, n: int) -> DataFrame:
    return F.broadcast(few) if n <= BROADCAST_GENOMES else few


def sketch_classes(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genomes (label, genome, rep) by equal sketches (label, genome, grams), and each representative's size ``n`` and band keys.

    Sketches are equal that have their size, the exclusive or of their hashes and two sums of these, stirred, in common.
    """
    ensure_shipped(sketches.sparkSession)
    kind = sketches.schema["label"].dataType.simpleString()
    rows = sketches.select("label", F.col("genome").cast("bigint").alias("genome"), "grams")
    signed = cut(rows.mapInArrow(_signed, f"label {kind}, genome bigint, n bigint, x bigint, s bigint, t bigint, keys array<bigint>"))
    classes = cut(signed.groupBy("label", "n", "x", "s", "t").agg(F.min("genome").alias("rep")))
    members = signed.join(classes, ["label", "n", "x", "s", "t"]).select("label", "genome", "rep")
    reps = classes.select("label", F.col("rep").alias("genome"))
    return members, signed.select("label", "genome", "n", "keys").join(_beside(reps, classes.count()), ["label", "genome"], "left_semi")


def _met(ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, genomes and sizes of two blocks of a band, whether they are one block) -> pairs whose sizes let them reach a similarity."""
        for batch in batches:
            left, n_left, right, n_right = (batch.column(k) for k in range(1, 5))
            place, low, high = [], [], []
            for i, same in enumerate(batch.column(5).to_pylist()):
                a, m, b, n = (np.asarray(x[i].values, np.int64) for x in (left, n_left, right, n_right))
                x, y = np.nonzero(np.minimum(m[:, None], n) >= ratio * np.maximum(m[:, None], n))
                x, y = (x[x < y], y[x < y]) if same else (x, y)
                place.append(np.full(len(x), i))
                low.append(np.minimum(a[x], b[y]))
                high.append(np.maximum(a[x], b[y]))
            if place:
                yield pa.record_batch({"label": batch.column(0).take(pa.array(np.concatenate(place))), "query": pa.array(np.concatenate(low)), "refer": pa.array(np.concatenate(high))})

    return run


def _candidates(signed: DataFrame, ratio: float) -> DataFrame:
    """Pairs (label, query, refer) of genomes that share a band, whose sizes are in a ratio at least."""
    spark, kind = signed.sparkSession, signed.schema["label"].dataType.simpleString()
    banded = signed.select("label", "genome", "n", F.explode("keys").alias("key"))
    held = cut(banded.groupBy("label", "key").agg(F.collect_list(F.struct("genome", "n")).alias("g")).filter("size(g) > 1").select("label", "g"))
    last = F.ceil(F.size("g") / BAND_BLOCK).cast("int") - 1
    many = held.filter(F.size("g") > BAND_BLOCK).withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("j", F.explode(F.sequence("i", last)))
    block = lambda x: F.slice("g", F.col(x) * BAND_BLOCK + 1, F.lit(BAND_BLOCK)).alias(f"g_{x}")
    dealt = many.select("label", block("i"), block("j"), (F.col("i") == F.col("j")).alias("same")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = held.filter(F.size("g") <= BAND_BLOCK).select("label", F.col("g").alias("g_i"), F.col("g").alias("g_j"), F.lit(True).alias("same"))
    rows = few.union(dealt).select("label", "g_i.genome", "g_i.n", "g_j.genome", "g_j.n", "same").toDF("label", "a", "m", "b", "n", "same")
    return cut(rows.mapInArrow(_met(ratio), f"label {kind}, query bigint, refer bigint").distinct())


def _shared(sketches: pa.Table, pairs: pa.Table) -> pa.Table:
    """Common grams of pairs (label, query, refer), from the sketches (label, genome, grams) of all their genomes."""
    labels, genomes, lists = sketches["label"].to_pylist(), sketches["genome"].to_pylist(), sketches["grams"].combine_chunks()
    at = {x: i for i, x in enumerate(zip(labels, genomes))}
    end = np.cumsum(np.asarray(lists.value_lengths(), np.int64))
    number = np.unique(np.asarray(lists.flatten(), np.int64), return_inverse=True)[1]
    own = np.split(number, end[:-1])
    asked = pairs.sort_by([("label", "ascending"), ("query", "ascending")])
    mark, marked, out = np.zeros(len(number) + 1, bool), None, []
    for label, query, refer in zip(*(asked[x].to_pylist() for x in ("label", "query", "refer"))):
        if marked is not (q := own[at[label, query]]):
            if marked is not None:
                mark[marked] = False
            mark[q] = True
            marked = q
        out.append(int(np.count_nonzero(mark[own[at[label, refer]]])))
    kept = asked.select(["label", "query", "refer"]).append_column("shared", pa.array(out, pa.int64()))
    size = dict(zip(at, np.diff(np.r_[0, end]).tolist()))
    for name in ("query", "refer"):
        kept = kept.append_column(f"_{name}", pa.array([size[x] for x in zip(kept["label"].to_pylist(), kept[name].to_pylist())], pa.int64()))
    return kept


def _counted(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (label, query, refer) with their common grams ``shared`` and both sizes.

    Components of the pairs are dealt to cells, large ones as pairs of blocks, so that the sketch of a genome travels once for
    a cell that has pairs of it, and not for each pair.
    """
    kind = sketches.schema["label"].dataType.simpleString()
    nodes = cut(pairs.select("label", F.explode(F.array("query", "refer")).alias("genome")).distinct())
    n = nodes.count()
    found = cut(components(nodes, pairs.withColumn("ani", F.lit(100.0)), 0.0))
    sizes = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BAND_BLOCK).cast("int").alias("blocks"))
    placed = found.join(sizes, "component").select("label", "genome", "component", "blocks", F.pmod(F.xxhash64("genome"), F.col("blocks")).alias("block"))
    side = lambda x: _beside(placed, n).select("label", F.col("genome").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("component", "blocks", "block")])
    both = pairs.join(side("query"), ["label", "query"]).join(side("refer").drop("refer_component", "refer_blocks"), ["label", "refer"])
    alone = F.pmod(F.xxhash64("query_component"), F.lit(-(-n // BAND_BLOCK) or 1))
    across = F.xxhash64("query_component", F.least("query_block", "refer_block"), F.greatest("query_block", "refer_block"))
    dealt = cut(both.select("label", "query", "refer", F.when(F.col("query_blocks") == 1, alone).otherwise(across).alias("cell")))
    cells = dealt.select("label", F.explode(F.array("query", "refer")).alias("genome"), "cell").groupBy("label", "genome").agg(F.collect_set("cell").alias("cells"))
    whole = sketches.join(_beside(nodes, n), ["label", "genome"], "left_semi").join(_beside(cells, n), ["label", "genome"])
    whole = whole.select(F.explode("cells").alias("cell"), "label", F.col("genome").cast("bigint").alias("genome"), "grams")
    schema = f"label {kind}, query bigint, refer bigint, shared bigint, _query bigint, _refer bigint"
    return whole.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInArrow(_shared, schema)


def banded_pairs(sketches: DataFrame, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Similar genomes without comparing all: pairs (label, query, refer, shared, ani) of representatives of at least an
    identity, and the members (label, genome, rep) that each stands for; sketches are rows (label, genome, gram), or whole
    ones (label, genome, grams) as by ``packed``, which are made once for the bands and once, of genomes that have pairs, to count.

    Genomes of a label are compared that agree in all hashes of one band at least. A band that many share is dealt out by
    blocks of its genomes, every block with every other; sizes too far apart make no pair. Shared k-mers are then counted in
    whole sketches; identity is 1 + ln(2 j / (1 + j)) / k for a Jaccard similarity j.
    """
    if "gram" in sketches.columns:
        sketches = cut(packed(sketches.groupBy("label", "genome").agg(F.collect_set("gram").alias("grams"))))
    members, signed = sketch_classes(sketches)
    grown = math.exp((least / 100 - 1) * k)  # 2 j / (1 + j) at the bound; j is the smaller size over the larger at most
    counted = _counted(_candidates(signed, grown / (2 - grown) * (1 - 1e-9)), sketches)
    j = F.col("shared") / (F.col("_query") + F.col("_refer") - F.col("shared"))
    ani = 100 * (1 + F.log(2 * j / (1 + j)) / k)
    return counted.filter("shared > 0").select("label", "query", "refer", "shared", ani.alias("ani")).filter(F.col("ani") >= least), members
