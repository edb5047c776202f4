"""Building blocks for Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row.

    Inside lambdas Spark evaluates an expression wherever it stands; a column that is
    bound as a lambda's argument is only read there.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
