"""FASTA files, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.names import basename, file_stem


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq_id, seq): ids end at the first white space, lines of a sequence are joined.

    A record starts at a > that starts a line; further ones are part of the header or sequence.
    """
    records = spark.read.text(path, lineSep="\n>").select(F.input_file_name().alias("file"), F.regexp_replace("value", "^>", "").alias("value")).filter("trim(value) <> ''")
    head = F.regexp_extract("value", r"^[^\r\n]*", 0)
    body = F.regexp_replace(F.substring(F.col("value"), F.length(head) + 1, F.length("value")), r"\s", "")
    return records.select(basename(F.col("file")).alias("file"), F.element_at(F.split(head, r"\s"), 1).alias("seq_id"), body.alias("seq"))


def pan_name(file: Column) -> Column:
    """Prefix of a genome in a merged file: the first two tokens of its stem, or the stem."""
    stem = file_stem(file)
    two = F.regexp_extract(stem, r"[^_]+_[^_]+", 0)
    return F.when(two != "", two).otherwise(stem)


def merged_lines(seqs: DataFrame) -> DataFrame:
    """Lines of one merged FASTA: names ``prefix#0#id``, letters in upper case."""
    return seqs.select(F.concat(F.lit(">"), pan_name(F.col("file")), F.lit("#0#"), "seq_id", F.lit("\n"), F.upper("seq")).alias("value"))


def long_scaffolds(seqs: DataFrame, least: int, names: Column | None = None) -> DataFrame:
    """Sequences of at least ``least`` letters whose name doesn't say plasmid."""
    return seqs.filter((F.length("seq") >= least) & ~F.lower(names if names is not None else F.col("seq_id")).contains("plasmid"))


def read_bases(spark: SparkSession, path: str) -> DataFrame:
    """(seq): the letters of reads in FASTQ files, plain or gzipped: lines of nucleotide letters only, which no quality line is in practice."""
    return spark.read.text(path).select(F.upper("value").alias("seq")).filter(F.col("seq").rlike("^[ACGTUN]+$"))
