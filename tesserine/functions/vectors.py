"""Vector columns (array<float>) as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors of no greater length than this cannot be normalised.
MIN_NORM = 1.1920929e-7


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision; vectors of unlike lengths have none."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def usable(v: Column) -> Column:
    """Whether a vector can be searched: not null or empty, all values finite, and not shorter than MIN_NORM."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & (norm(v) > MIN_NORM), F.lit(False))


def normalise(v: Column) -> Column:
    """A vector of unit length, in double precision; null if it is not usable."""
    length = norm(v)
    return F.when(usable(v), F.transform(v, lambda x: x.cast("double") / length))
