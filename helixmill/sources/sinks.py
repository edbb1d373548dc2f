"""Reports and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(frame: DataFrame, path: str, header: bool = True, single: bool = False) -> None:
    """Tab-separated text; ``single`` makes one file, for reports of a few rows."""
    (frame.coalesce(1) if single else frame).write.mode("overwrite").csv(path, sep="\t", header=header, quote="", escape="")


def write_read_report(classified: DataFrame, path: str) -> None:
    write_tsv(classified.select("read_id", "mapq", "species", "read_len"), path, header=False)


def write_species_report(profile: DataFrame, path: str) -> None:
    write_tsv(profile, path, single=True)


def write_strain_report(strains: DataFrame, path: str, digits: int | None = None) -> None:
    out = strains if digits is None else strains.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in strains.dtypes])
    write_tsv(out, path, single=True)


def write_lines(frame: DataFrame, path: str, compression: str | None = None) -> None:
    """A ``value`` column as text: graphs, alignments and merged sequences."""
    frame.select("value").write.mode("overwrite").text(path, compression=compression)
