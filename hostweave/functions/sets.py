"""Column functions on host sets and time ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two sets: 1 when both are empty, 0 when only one is."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ranges_near(a0: Column, a1: Column, b0: Column, b1: Column, gap: int | Column) -> Column:
    """True when two ranges are at most ``gap`` apart, or either is unknown."""
    unknown = a0.isNull() | a1.isNull() | b0.isNull() | b1.isNull()
    return F.when(unknown, F.lit(True)).otherwise(((b0 - a1) <= gap) & ((a0 - b1) <= gap))


def quiet_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Quiet time between two ranges; 0 when they overlap or either is unknown."""
    return F.coalesce(
        F.when(
            a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull(),
            F.greatest(F.lit(0), b0 - a1, a0 - b1),
        ),
        F.lit(0),
    )
