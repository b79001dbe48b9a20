"""Values that an expression needs more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, made: Callable[[Column], Column]) -> Column:
    """`made(x)`, where x is computed once however often it is named, also inside functions over arrays."""
    return F.get(F.transform(F.array(x), made), 0)
