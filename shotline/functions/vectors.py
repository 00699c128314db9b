"""Vector arithmetic on array columns, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """L2 normalisation; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance of two already normalised vectors."""
    return 1.0 - dot(a, b)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def euclidean_unit(a: Column, b: Column) -> Column:
    return euclidean(unit(a), unit(b))


def manhattan(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


Distance = Callable[[Column, Column], Column]

# name -> column expression over two raw vectors
DISTANCES: dict[str, Distance] = {
    "cosine": lambda a, b: cosine(unit(a), unit(b)),
    "euclidean": euclidean,
    "euclidean_l2norm": euclidean_unit,
    "manhattan": manhattan,
}


def register_distance(name: str, distance: Distance) -> None:
    """Make a further distance available by name to the paired (row-wise) operators."""
    DISTANCES[name] = distance
