"""Expressions that turn coded register text into numbers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(column: Column, dtype: str) -> Column:
    """The numeric value, or null where there is none.

    Integer columns keep their type; NaN counts as missing.
    """
    if dtype in ("double", "float"):
        return F.nanvl(column, F.lit(None).cast(dtype))
    if dtype != "string":
        return column
    # The cast would also read "12d", "5f", "NaN" and "Infinity". Numbers need none
    # of these letters, so spoiling them leaves only digits, signs and exponents.
    return F.translate(column, "dDfFnN", "######").try_cast("double")


def coded_number(column: Column, dtype: str, codes: Mapping[str, float | None]) -> Column:
    """Look the text up in ``codes``; anything else is read as a number."""
    if dtype != "string":
        return number(column, dtype)
    lookup = None
    for text, code in codes.items():
        value = F.lit(code).cast("double")
        lookup = F.when(column == text, value) if lookup is None else lookup.when(column == text, value)
    return lookup.otherwise(number(column, dtype))


def without_sentinels(column: Column, sentinels: Iterable[int], positive_only: bool) -> Column:
    if positive_only:
        bad = (column <= 0) | column.isin([s for s in sentinels if s > 0])
    else:
        bad = column.isin(list(sentinels))
    return F.when(bad, None).otherwise(column)


def recoded(column: Column, recodes: Mapping[int, Iterable[int]]) -> Column:
    """Replace subcategory codes by their main category."""
    result = column
    for main, subcodes in recodes.items():
        result = F.when(column.isin(list(subcodes)), F.lit(main).cast("double")).otherwise(result)
    return result
