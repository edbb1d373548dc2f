"""Columns over file and genome names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sequence file suffixes, and threads by number of genomes.
FASTA_SUFFIX = r"\.(fa|fna|fasta)(\.gz)?$"
THREAD_STEPS = ((5, 8), (11, 16), (26, 32), (51, 48))
MOST_THREADS = 64


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def first_tokens(name: Column) -> Column:
    """The first two tokens between underscores; a name without one as it is."""
    return F.when(name.contains("_"), F.array_join(F.slice(F.split(name, "_"), 1, 2), "_")).otherwise(name)


def hap_id(path: Column) -> Column:
    """Haplotype id of a genome file."""
    return first_tokens(file_stem(path))


def genome_name(path: Column, two_tokens: bool = False) -> Column:
    """Genome id of a downloaded file: its suffix stripped, or its first two tokens."""
    base = basename(path)
    return first_tokens(base) if two_tokens else F.regexp_replace(base, r"_genomic\.fna(\.gz)?$", "")


def is_fasta(path: Column) -> Column:
    return path.rlike(FASTA_SUFFIX)


def underscored(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


# Share of a read that must align, by the kind of reads; others take the caller's.
PRECISE_CLIPPING = {"clr": 0.75, "ontr9": 0.75, "ontr10": 0.8, "hifi": 0.9}


def precise_clipping(kind: str, otherwise: float = 0.66) -> float:
    return PRECISE_CLIPPING.get(kind, otherwise)


def version_at_least(have: Column, want: Column) -> Column:
    """Whether a dotted version reaches another; a missing or unreadable part is 0."""

    def parts(version: Column) -> Column:
        return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))

    a, b = parts(have), parts(want)
    width = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.slice(F.concat(x, F.array_repeat(F.lit(0), width)), 1, width)
    return pad(a) >= pad(b)


def last_field(tag: Column) -> Column:
    """What follows the last colon of a tag."""
    return F.element_at(F.split(tag, ":"), -1)


def threads_for(genomes: Column, fold: float = 1.0, most: int = MOST_THREADS) -> Column:
    """Threads for a graph build of so many genomes, times ``fold``, capped."""
    steps = F.lit(MOST_THREADS)
    for below, threads in reversed(THREAD_STEPS):
        steps = F.when(genomes < below, F.lit(threads)).otherwise(steps)
    return F.least(F.ceil(steps * fold), F.lit(most)).cast("int")


def number_repeats(rows: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """``key`` with ``.1``, ``.2``, ... where it occurs more than once, in ``order``."""
    same = Window.partitionBy(key)
    many = F.count(F.lit(1)).over(same) > 1
    numbered = F.concat_ws(".", key, F.row_number().over(same.orderBy(order)))
    return rows.withColumn(out, F.when(many, numbered).otherwise(F.col(key).cast("string")))
