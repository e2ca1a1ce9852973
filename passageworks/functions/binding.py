"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    An expression written out several times, or inside a lambda, is computed
    each time; and intermediate columns can be merged into their users by the
    optimizer, for instance below a pushed filter, with the same effect. A
    lambda argument is bound to its value.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
