"""Fast mode: a stored index of sketched k-mers, and which of its genomes a sample holds.

A sketch keeps the k-mers whose 63-bit hash lies below 2**63 / scale (FracMinHash), so a sketch of a coarser scale is the
lower end of a finer one. The index is a Parquet table of postings (gram, genome), bucketed and sorted by the hash: a
query of a coarser scale reads the row groups below its bound only, and joins the sample's sketch bucket by bucket. The
index is never shuffled; the sample's sketch, which is small beside it, is dealt to its buckets, or broadcast if a count
finds it small enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.cut import cut

HASHES = 1 << 63
BUCKETS = 64
#: Hashes of a sample up to this many are broadcast.
BROADCAST_GRAMS = 500_000
#: Bytes of a row group, the smallest part that a query of a coarser scale can leave out.
ROW_GROUP = 4 << 20


def letter_hash(gram: Column) -> Column:
    """63 bits of a k-mer."""
    return F.shiftrightunsigned(F.xxhash64(gram), 1)


def sketch(rows: DataFrame, grams: Column, scale: int = 1, hashed: Callable[[Column], Column] = letter_hash) -> DataFrame:
    """The rows once for each of their k-mers (a column of arrays) that the scale keeps, ``gram`` its hash."""
    each = rows.withColumn("gram", F.explode(F.transform(grams, hashed)))
    return each.filter(F.col("gram") < F.lit(HASHES // scale)) if scale > 1 else each


@dataclass(frozen=True)
class Index:
    """A stored index: its postings (gram, genome), the k-mer length, the scale it was built with."""

    postings: DataFrame
    k: int
    scale: int


def _register(spark: SparkSession, path: str, kind: str, buckets: int) -> DataFrame:
    """The postings as a table of this session, so that Spark knows their buckets; the files stay where they are."""
    name = f"helixmill_index_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} (gram BIGINT, genome {kind}) USING parquet CLUSTERED BY (gram) SORTED BY (gram) INTO {buckets} BUCKETS LOCATION '{place}/postings'")
    return spark.table(name)


def write_index(sketches: DataFrame, path: str, k: int, scale: int = 1, buckets: int = BUCKETS) -> None:
    """Store sketches (genome, gram) of a scale. A bucket is one file sorted by hash, so that its row groups are ranges of hashes."""
    spark = sketches.sparkSession
    name = f"helixmill_writing_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = sketches.select("gram", "genome").distinct().repartition(buckets, "gram")
    written = dealt.write.mode("overwrite").bucketBy(buckets, "gram").sortBy("gram").format("parquet")
    written.option("path", f"{path}/postings").option("parquet.block.size", str(ROW_GROUP)).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    kind = sketches.schema["genome"].dataType.simpleString()
    facts = spark.createDataFrame([(k, scale, buckets, kind)], "k int, scale int, buckets int, kind string")
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def open_index(spark: SparkSession, path: str) -> Index:
    facts = spark.read.parquet(f"{path}/facts").first()
    return Index(_register(spark, path, facts.kind, facts.buckets), facts.k, facts.scale)


def close_index(spark: SparkSession, path: str) -> None:
    """Forget the session's table; the files stay."""
    spark.sql(f"DROP TABLE IF EXISTS helixmill_index_{hashlib.md5(path.encode()).hexdigest()}")


def genomes_in_sample(index: Index, sample: DataFrame, scale: int | None = None, broadcast: int = BROADCAST_GRAMS) -> DataFrame:
    """(genome, grams, shared, containment, ani): how much of each genome's sketch a sample's sketch (gram) holds.

    ``scale`` may be coarser than the index's; both sketches are then cut at its bound. Identity is the containment to
    the power 1/k, in percent.
    """
    scale = index.scale if scale is None else scale
    if scale < index.scale:
        raise ValueError(f"an index of scale {index.scale} can't be asked at scale {scale}")
    postings, asked = index.postings, sample.select("gram")
    if scale > 1:
        bound = F.col("gram") < F.lit(HASHES // scale)
        postings, asked = postings.filter(bound), asked.filter(bound)
    asked = cut(asked.distinct())  # so that a sample is sketched once, not for the count and for the join
    few = asked.limit(broadcast + 1).count() <= broadcast
    hits = (F.broadcast(asked) if few else asked.hint("merge")).withColumn("_hit", F.lit(1))
    sums = postings.join(hits, "gram", "left").groupBy("genome").agg(F.count(F.lit(1)).alias("grams"), F.count("_hit").alias("shared"))
    share = F.col("shared") / F.col("grams")
    return sums.select("genome", "grams", "shared", share.alias("containment"), (F.pow(share, F.lit(1.0 / index.k)) * 100).alias("ani"))


def retained(info: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """The genome list (id, ...) without genomes (genome, ani; genome is an id of the list) below an identity."""
    return info.join(found.filter(F.col("ani") >= least).select(F.col("genome").alias("id")), "id", "left_semi").select(*info.columns)
