"""Evaluating a costly column once where an expression needs it several times.

Inside a lambda, and where two functions take the same input, Spark evaluates the
input again for every use.  ``once`` passes its value on as a lambda variable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def kept(value: Column) -> Column:
    """A column to select that is computed once a row, whatever asks for it later.

    Filters on a projected column, those that Spark adds for an ``explode`` too, move below the projection and compute
    the column again for every mention.  They stay above a generator.
    """
    return F.explode(F.array(value))
