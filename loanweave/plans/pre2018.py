"""The two linking rounds for the register of 2007-2017.

Both settle uniqueness on place, amount and income and check everything else
afterwards, pair by pair; so a pair is reduced to its ids and one flag before
the first shuffle by sale or purchase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions import people
from loanweave.functions.logic import all_of, is_true, within_or_unknown
from loanweave.operators import candidates, cleaning
from loanweave.operators import pair_filters as pf
from loanweave.operators.candidates import Blocking
from loanweave.operators.uniqueness import composite_ids, unique_pairs_pre2018
from loanweave.session import cut_lineage
from loanweave.sources.results import append_crosswalk_pre2018

BIN_KEYS = ("loan_type", "census_tract", "occupancy_type", "loan_purpose", "LoanAmountBin")
EXACT_KEYS = ("loan_type", "loan_amount", "census_tract", "occupancy_type", "property_type", "loan_purpose")
INCOME_TOLERANCE = 5
PREPARED_COLUMNS = (
    *schema.PRE2018_ID_COLUMNS, "action_taken", "purchaser_type", "loan_type", "loan_purpose", "occupancy_type",
    "property_type", "loan_amount", "census_tract", "income", "people_needs", "people_offers",
)


def prepare(loans: DataFrame) -> DataFrame:
    """Blank the code for unknown income and condense the borrowers to two longs."""
    clean = cleaning.drop_nonmatch_columns(loans, pre2018_round=True)
    missing = [c for c in schema.people_columns("race", 5) if c not in clean.columns]
    clean = clean.withColumns({c: F.lit(None).cast("double") for c in missing})
    clean = cleaning.null_income_9999(clean, ["income"]).withColumns(people.people_bits(people.PEOPLE_PRE2018))
    return clean.select([c for c in PREPARED_COLUMNS if c in clean.columns])


def _ids(loans: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in schema.PRE2018_ID_COLUMNS if c in loans.columns)


def _pairs(loans: DataFrame, blocking: Blocking) -> DataFrame:
    pairs = candidates.blocked_pairs(*candidates.split_sides(loans), blocking)
    # A key both records share belongs to both of their ids.
    shared = {f"{c}_{side}": F.col(c) for c in blocking.keys for side in ("s", "p")}
    pairs = pairs.withColumns(shared)
    close_income = within_or_unknown(pf.difference("income"), INCOME_TOLERANCE)
    return candidates.different_lenders(pairs.filter(close_income))


def _links(pairs: DataFrame, fits: Column) -> DataFrame:
    ids = [c for side in composite_ids(pairs).values() for c in side]
    narrow = cut_lineage(pairs.select(*ids, is_true(fits).alias("fits")))
    return unique_pairs_pre2018(narrow, carried={"fits": F.col("fits")}).filter("fits").select(*ids)


def link_round1(loans: DataFrame, max_block_pairs: int | None = candidates.MAX_BLOCK_PAIRS) -> DataFrame:
    """Sales and purchases of the same year in overlapping amount bins."""
    usable = cleaning.require_keys(cleaning.loan_amount_bin(loans), BIN_KEYS, ("",))
    blocking = Blocking(
        keys=(*BIN_KEYS, "activity_year"),
        spread=candidates.overlapping_bins(),
        bands={"income": INCOME_TOLERANCE},
        ids=_ids(loans),
        max_block_pairs=max_block_pairs,
    )
    pairs = _pairs(usable, blocking)
    fits = all_of(
        [
            pf.difference("loan_amount").isin(0, 1),
            within_or_unknown(pf.difference("income"), 0),
            people.bits_agree(),
            F.col("purchaser_type_s") > 0,
            F.col("purchaser_type_p") <= schema.LAST_PRIMARY_PURCHASER_TYPE,
            F.col("property_type_s") == F.col("property_type_p"),
        ]
    )
    return _links(pairs, fits)


def link_round2(
    loans: DataFrame, crosswalk: DataFrame, max_block_pairs: int | None = candidates.MAX_BLOCK_PAIRS
) -> DataFrame:
    """Equal amounts, purchases up to a year later, among loans not linked before."""
    usable = candidates.anti_matched_composite(cleaning.require_keys(loans, EXACT_KEYS, ("",)), crosswalk)
    blocking = Blocking(
        keys=EXACT_KEYS,
        bands={"income": INCOME_TOLERANCE},
        ids=_ids(loans),
        max_block_pairs=max_block_pairs,
    )
    pairs = candidates.year_window(_pairs(usable, blocking), max_gap=1)
    fits = all_of(
        [
            people.bits_agree(),
            within_or_unknown(pf.difference("income"), 1),
            pf.year_fits_type(),
            F.col("purchaser_type_p") <= schema.LAST_PRIMARY_PURCHASER_TYPE,
        ]
    )
    return _links(pairs, fits)


def crosswalk_round1(loans: DataFrame) -> DataFrame:
    return append_crosswalk_pre2018(link_round1(loans), 1)


def crosswalk_round2(loans: DataFrame, previous: DataFrame) -> DataFrame:
    return append_crosswalk_pre2018(link_round2(loans, previous), 2, previous)
