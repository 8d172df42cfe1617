"""Name an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst merges stacked projections and then repeats a column's expression
    wherever it is used, inside array lambdas once per element. A lambda
    variable is never expanded.
    """
    return F.transform(F.array(value), body)[0]
