"""Columns over graph paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_nodes(path: Column) -> Column:
    """Node ids of a path such as ``>1<22>3``: every run of digits. Without a lambda, so that what uses them twice parses once."""
    return F.regexp_extract_all(path, F.lit(r"(\d+)"), F.lit(1)).cast("array<bigint>")


def node_bounds(path: Column) -> tuple[Column, Column]:
    """Smallest and largest node id; -1 for a path without nodes."""
    ids = path_nodes(path)
    return F.coalesce(F.array_min(ids), F.lit(-1)), F.coalesce(F.array_max(ids), F.lit(-1))


def triple(a: Column, b: Column, c: Column) -> list[Column]:
    """A node triple read in the direction whose first end is not larger."""
    return [F.least(a, c).alias("a"), b.alias("b"), F.greatest(a, c).alias("c")]
