"""Values that a lambda uses many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: inside a lambda an expression would be computed anew for each element."""
    return F.transform(F.array(value), body)[0]
