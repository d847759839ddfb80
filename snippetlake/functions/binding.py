"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once.

    A lambda evaluates the outer expressions it mentions anew for every element, and the
    optimizer may inline a projected column into it, so values that lambdas use are bound
    to a lambda variable of their own.
    """
    return F.transform(F.array(value), body)[0]
