"""Vector expressions on ``ARRAY<FLOAT>`` columns; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(v: Column) -> Column:
    """Unit vector of ``v``; a zero vector stays zero."""

    def scaled(v: Column, norm: Column) -> Column:
        unit = F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))
        return F.when(norm == 0, v.cast("array<float>")).otherwise(unit)

    return let(v, lambda v: let(F.sqrt(squared_norm(v)), lambda norm: scaled(v, norm)))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
