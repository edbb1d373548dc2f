"""Alignments in GAF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.names import last_field

# 0-based fields of an alignment line.
COLUMNS = {"read_id": 0, "read_len": 1, "path": 5, "path_len": 6, "read_start": 7, "read_end": 8, "mapq": 11}
NUMBERS = {"read_len", "path_len", "read_start", "read_end", "mapq"}
WIDTH = 13


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Seven typed columns; lines that start with @ are comments, * is null, nothing is quoted."""
    schema = ", ".join(f"_c{i} string" for i in range(WIDTH))
    raw = spark.read.schema(schema).csv(path, sep="\t", comment="@", nullValue="*", quote="")
    return raw.select(*[F.expr(f"try_cast(_c{i} as bigint)").alias(n) if n in NUMBERS else F.col(f"_c{i}").alias(n) for n, i in COLUMNS.items()])


def zero_for_bad(alignments: DataFrame) -> DataFrame:
    """Numbers that can't be read as 0."""
    return alignments.fillna(0, subset=sorted(NUMBERS))


def read_long_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Lines with what the best-alignment filter needs: rid, read_id, mapq, matches, identity, span, line.

    A line of fewer than 16 fields, or with a number that can't be read, is dropped; ``identity`` follows the last
    colon of field 16. ``rid`` is the line itself: of equal lines either may stay.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.col("value").alias("line"), F.split("value", "\t").alias("f")).filter(F.size("f") >= 16)

    def number(i: int, kind: str):
        return F.element_at("f", i + 1).try_cast(kind)

    out = lines.select(
        F.col("line").alias("rid"), F.element_at("f", 1).alias("read_id"), number(11, "int").alias("mapq"), number(9, "int").alias("matches"),
        last_field(F.element_at("f", 16)).try_cast("double").alias("identity"), (number(3, "int") - number(2, "int")).alias("span"), "line",
    )
    return out.dropna(subset=["mapq", "matches", "identity", "span"])
