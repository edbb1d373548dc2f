"""Species coverage and abundance from classified reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW_MAPQ, UNIQUE_MAPQ = 3, 60


def species_bases(classified: DataFrame, equal_len: int | None = None, filtered: bool = True) -> DataFrame:
    """(species, bases) of classified reads in one aggregation.

    Bases are read lengths, or reads times ``equal_len``. With ``filtered`` a species needs a uniquely mapped read, and
    reads of quality 3 to 60 must be over a tenth of all its reads; bases still count all reads.
    """
    known = classified.filter(F.col("species") != "U")
    bases = F.sum("read_len") if equal_len is None else F.count(F.lit(1)) * equal_len
    per = known.groupBy("species").agg(
        bases.cast("bigint").alias("bases"),
        F.count(F.lit(1)).alias("_reads"),
        F.count_if(F.col("mapq").between(LOW_MAPQ, UNIQUE_MAPQ)).alias("_placed"),
        F.count_if(F.col("mapq") == UNIQUE_MAPQ).alias("_unique"),
    )
    if filtered:
        per = per.filter((F.col("_unique") > 0) & (F.col("_placed") > F.col("_reads") / 10.0))
    return per.select("species", "bases")


def species_profile(bases: DataFrame, lengths: DataFrame) -> DataFrame:
    """(species_taxid, predicted_abundance, predicted_coverage), most abundant first; coverage is bases per genome length."""
    covered = bases.join(lengths, "species", "left").withColumn("predicted_coverage", F.try_divide(F.col("bases").cast("double"), "len"))
    total = F.sum("predicted_coverage").over(Window.partitionBy(F.lit(1)))  # one row per species
    out = covered.select(F.col("species").alias("species_taxid"), F.try_divide("predicted_coverage", total).alias("predicted_abundance"), "predicted_coverage")
    return out.orderBy(F.desc_nulls_last("predicted_abundance"), "species_taxid")


def candidate_species(profile: DataFrame, ranges: DataFrame, mode: int = 2, designated: str | None = None, least: float = 1e-4) -> DataFrame:
    """Ranges of the species to be resolved to strains.

    Mode 0 keeps single-genome species, 1 pangenomes, others all; ``designated`` is a comma list of species.
    """
    wanted = [x.strip() for x in (designated or "").split(",") if x.strip() and x.strip() != "None"]
    held = ranges.filter(F.col("is_pan") == mode) if mode in (0, 1) else ranges
    held = held.filter(F.col("species").isin(wanted)) if wanted else held
    kept = profile.filter(F.col("predicted_abundance") > least).withColumnRenamed("species_taxid", "species")
    return kept.join(held, "species").select("species", "predicted_abundance", "predicted_coverage", "start", "end")
