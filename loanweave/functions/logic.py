"""Two-valued comparisons.

The linking rules treat a missing value as "not equal to anything": a test
for inequality succeeds on it and a test for equality fails. These helpers
are the only place where that is spelled out.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def not_true(test: Column) -> Column:
    return ~is_true(test)


def differs(column: Column, value) -> Column:
    """``column != value`` that holds when either side is missing."""
    return not_true(column == value)


def none_of(column: Column, values: Iterable) -> Column:
    return not_true(column.isin(list(values)))


def within_or_unknown(difference: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(difference) <= F.lit(float(tolerance)), F.lit(True))


def exceeds(difference: Column, tolerance: float) -> Column:
    return is_true(F.abs(difference) > F.lit(float(tolerance)))


def all_of(tests: Iterable[Column]) -> Column:
    return reduce(and_, tests, F.lit(True))


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def count_true(tests: Iterable[Column]) -> Column:
    return reduce(lambda total, test: total + is_true(test).cast("int"), tests, F.lit(0))
