"""Seeded draws that depend on their key alone: any row order or partitioning gives the same values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def rank_key(*parts) -> Column:
    """SHA-256 of the parts joined by '|': the order in which groups and items are visited."""
    return F.sha2(F.concat_ws("|", *map(_column, parts)).cast("binary"), 256)


def draw_int(*parts) -> Column:
    """A 60-bit whole number from the parts."""
    return F.conv(F.substring(rank_key(*parts), 1, 15), 16, 10).cast("long")


def draw(*parts) -> Column:
    """A number in [0, 1) from the parts."""
    return draw_int(*parts) / F.lit(float(1 << 60))


def draw_below(n: Column | int, *parts) -> Column:
    """A whole number in [0, n) from the parts."""
    return F.floor(draw(*parts) * n).cast("long")
