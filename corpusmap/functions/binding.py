"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row.

    Spark repeats an expression at each place that mentions it, and does not share work between the branches
    of a CASE. A variable of a lambda is computed once.
    """
    return F.transform(F.array(value), body)[0]
