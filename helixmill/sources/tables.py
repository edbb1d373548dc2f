"""Tab-separated tables: genome lists, ranges, reports, statistics, similarities, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column layouts.
GENOMES_INFO = "genome_ID string, strain_taxid string, species_taxid string, organism_name string, id string"
SPECIES_RANGE = "species string, start bigint, end bigint, is_pan int"
SPECIES_LENGTH = "species string, len double"
READ_CLASS = "read_id string, mapq int, species string, read_len int"
SPECIES_ABUNDANCE = "species_taxid string, predicted_abundance double, predicted_coverage double"
GENOME_STATS = "file string, n bigint, total bigint, gap bigint, avg double, n50 bigint, n90 bigint, longest bigint, shortest bigint, gc double"
MOST_GAP = 10_000_000


def _tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=header, quote="", mode="PERMISSIVE")


def genomes_info(spark, path) -> DataFrame:
    """All columns as strings: strain 24.10 is not 24.1."""
    return _tsv(spark, path, GENOMES_INFO, header=True)


def species_range(spark, path) -> DataFrame:
    return _tsv(spark, path, SPECIES_RANGE)


def species_lengths(spark, path) -> DataFrame:
    return _tsv(spark, path, SPECIES_LENGTH)


def read_classes(spark, path) -> DataFrame:
    """Saved classifications by read id; rows are matched by key, never by position."""
    return _tsv(spark, path, READ_CLASS)


def species_abundance(spark, path) -> DataFrame:
    return _tsv(spark, path, SPECIES_ABUNDANCE, header=True)


def genome_stats(spark, path) -> DataFrame:
    """Genomes with an N50 and few gaps."""
    return _tsv(spark, path, GENOME_STATS).filter((F.col("n50") > 0) & (F.col("gap") < MOST_GAP))


def ani_pairs(spark, path) -> DataFrame:
    return _tsv(spark, path, "query string, refer string, ani double, _m string, _f string").select("query", "refer", "ani")


def ani_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, dist) of a lower-triangular similarity matrix: symmetric, 100 minus the similarity, 0 on the diagonal.

    The first line holds the number of rows; a row holds a name and its similarities to all rows before it.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(place.alias("line"), F.split(F.trim("value"), r"[\t ]+").alias("f")).filter("f[0] <> ''")
    rows = lines.select("line", "f", (F.size("f") - 1).alias("at"))  # a row's number is how many values it holds
    head = rows.filter("at = 0").agg(F.min("line").alias("line"))
    rows = rows.join(F.broadcast(head), "line", "left_anti").select("at", "f")
    names = rows.select("at", F.element_at("f", 1).alias("name"))
    cells = rows.select(F.element_at("f", 1).alias("i"), F.posexplode(F.slice("f", 2, F.size("f"))).alias("at", "v")).filter("v <> ''")
    low = cells.join(names, "at").select("i", F.col("name").alias("j"), (100 - F.expr("try_cast(v as double)")).alias("dist"))
    return low.union(low.select("j", "i", "dist")).union(names.select("name", "name", F.lit(0.0)))


def assembly_summary(spark: SparkSession, path: str, level: str = "all", species: list[str] | None = None) -> DataFrame:
    """(taxid, species_taxid, organism, level, is_ref, file) of an assembly summary; comment lines are skipped."""
    raw = spark.read.csv(path, sep="\t", comment="#", quote="")
    rows = raw.select(
        F.col("_c5").alias("taxid"), F.col("_c6").alias("species_taxid"), F.col("_c7").alias("organism"), F.col("_c11").alias("level"),
        F.col("_c4").eqNullSafe("reference genome").alias("is_ref"),
        F.concat(F.element_at(F.split("_c19", "/"), -1), F.lit("_genomic.fna")).alias("file"),
    )
    rows = rows if level == "all" else rows.filter(F.col("level") == level)
    return (rows.filter(F.col("species_taxid").isin(species)) if species else rows).distinct()


def gtdb_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(accession, species, level, assembly, organism) of a metadata table with a header."""
    raw = spark.read.csv(path, sep="\t", header=False, quote="").filter("_c0 <> 'accession'")
    species = F.element_at(F.split(F.element_at(F.split("_c19", ";"), -1), "__"), -1)
    accession = F.regexp_replace("_c0", "^[^_]*_", "")
    return raw.select(accession.alias("accession"), F.replace(species, F.lit(" "), F.lit("_")).alias("species"), F.col("_c48").alias("level"), F.col("_c49").alias("assembly"), F.col("_c65").alias("organism")).distinct()


def with_info(genomes: DataFrame, info: DataFrame) -> DataFrame:
    """Genomes (genome_ID, ...) beside their line of a genome list, whether there is one or not."""
    return genomes.join(info, "genome_ID", "left")


def in_set(info: DataFrame, genomes: DataFrame) -> DataFrame:
    """Lines of a genome list whose genome is in a set (genome_ID)."""
    return info.join(genomes.select("genome_ID"), "genome_ID", "left_semi")


def existing_files(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose ``file``, plain or compressed, is in a listing (path)."""
    names = listing.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.gz$", "").alias("file")).distinct()
    return rows.join(names, "file", "left_semi")


def only_file(spark: SparkSession, path: str, pattern: str) -> str:
    """The one file of a folder that matches; none or several are an error."""
    found = [r.path for r in list_files(spark, path, pattern).select("path").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no file' if not found else 'more than one file'} matches {pattern} in {path}")
    return found[0]


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
