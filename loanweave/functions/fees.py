"""Fee agreement between the two records of a candidate pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanweave.functions.logic import any_of, count_true, is_true
from loanweave.schema import FEE_COLUMNS


def _side(side: str, fees: Sequence[str]) -> list[Column]:
    return [F.col(f"{fee}_{side}") for fee in fees]


def same_fee_count(fees: Sequence[str] = FEE_COLUMNS) -> Column:
    """How many of the fees are reported alike under the same name."""
    return count_true(s == p for s, p in zip(_side("s", fees), _side("p", fees)))


def reported_fee_count(suffix: str = "", fees: Sequence[str] = FEE_COLUMNS) -> Column:
    return count_true(F.col(f"{fee}{suffix}").isNotNull() for fee in fees)


def any_fee_agrees(fees: Sequence[str] = FEE_COLUMNS) -> Column:
    """Whether some seller fee equals some purchaser fee, under any name."""
    return is_true(any_of(s.isin(*_side("p", fees)) for s in _side("s", fees)))


def no_fees_on_a_side(fees: Sequence[str] = FEE_COLUMNS) -> Column:
    return (reported_fee_count("_s", fees) == 0) | (reported_fee_count("_p", fees) == 0)
