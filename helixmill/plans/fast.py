"""Fast mode as queries: benchmark items are genomes whose sketches are stored, documents the sample that is asked for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators import index, sketch
from helixmill.operators.cut import scratch_path, settled
from helixmill.plans import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STORED, ASKED, WORDS, LEAST = 2, 4, 5, 60.0


def query(f):
    QUERIES[f.__name__] = lambda s, d: settled(s, lambda: f(s, d))
    return f


def _md5_hash(gram: Column) -> Column:
    """63 bits that SQL has too."""
    return F.conv(F.substring(F.md5(gram), 1, 15), 16, 10).cast("bigint") * 8


def _sketch(rows: DataFrame, scale: int) -> DataFrame:
    return index.sketch(rows, sketch.word_grams(F.col("text"), WORDS), scale, _md5_hash).drop("text")


def _stored(s, d) -> index.Index:
    path = scratch_path(s, "index")
    genomes = b.table(s, d, "benchmark").select(F.concat(F.lit("/g/"), "item_id", F.lit(".fna")).alias("genome"), "text")
    index.write_index(_sketch(genomes, STORED), path, WORDS, STORED, buckets=8)
    return index.open_index(s, path)


def _found(s, d, **options) -> DataFrame:
    sample = _sketch(b.table(s, d, "documents").select("text"), STORED)
    return index.genomes_in_sample(_stored(s, d), sample, ASKED, **options)


@query
def gr19_stored_index(s, d):
    """Containment of every genome, the index of scale 2 asked at scale 4."""
    return _found(s, d).select("genome", "grams", "shared", F.round("containment", 6).alias("containment"), F.round("ani", 6).alias("ani"))


@query
def fast_filter(s, d):
    """The genome list without genomes that the sample doesn't hold; no side of the join is broadcast."""
    item = b.table(s, d, "benchmark")
    info = item.select(F.concat(F.lit("G"), "item_id").alias("genome_ID"), F.concat(F.lit("/g/"), "item_id", F.lit(".fna")).alias("id"))
    return index.retained(info, _found(s, d, broadcast=0), LEAST)


@query
def gr20_banded_pairs(s, d):
    """Similar documents of a language by whole sketches, one of equal ones, candidates by min-hash bands."""
    docs = b.table(s, d, "documents").select(F.col("lang").alias("label"), F.col("doc_id").alias("genome"), "text")
    grams = F.transform(sketch.word_grams(F.col("text"), WORDS), index.letter_hash)
    pairs, _ = sketch.banded_pairs(sketch.packed(docs.select("label", "genome", grams.alias("grams"))), WORDS, 95.0)
    return pairs.select("label", "query", "refer", "shared", F.round("ani", 6).alias("ani"))
