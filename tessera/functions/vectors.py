"""Column functions on vectors. Sums are taken in double precision, in order of the components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, all of them numbers."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def similarity(distance: Column) -> Column:
    """1 - d * d / 2 held to 0 .. 1: for unit vectors the cosine. Null where there is no distance."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance * distance / 2))
    return F.when(distance.isNotNull() & ~F.isnan(distance), held)


def literal(vector) -> Column:
    """A vector as a constant, in one expression: a call for each component would take longer than the search."""
    return F.expr("array(" + ", ".join(f"double('{float(x)!r}')" for x in vector) + ")")
