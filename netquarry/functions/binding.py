"""Naming an intermediate value inside one expression.

A Column used n times is n copies of its expression; nested helpers multiply. ``let`` evaluates
the value once and hands the result to the rest of the expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
