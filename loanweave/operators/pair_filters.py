"""Filters on candidate pairs.

The first group looks at one pair at a time. The second compares a pair with
the other candidates of the same sale and of the same purchase; its steps
depend on what earlier steps left, so their order matters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions import fees, people
from loanweave.functions.logic import all_of, any_of, exceeds, is_true, not_true, within_or_unknown
from loanweave.operators import rivals
from loanweave.operators.cleaning import main_categories


def difference(column: str) -> Column:
    return F.col(f"{column}_s") - F.col(f"{column}_p")


def present(df: DataFrame, tolerances: Mapping[str, float]) -> dict[str, float]:
    """The tolerances whose column both sides have."""
    return {c: t for c, t in tolerances.items() if {f"{c}_s", f"{c}_p"} <= set(df.columns)}


# --- one pair at a time -----------------------------------------------------
def within_tolerances(tolerances: Mapping[str, float]) -> Column:
    return all_of(within_or_unknown(difference(c), t) for c, t in tolerances.items())


def numeric_matches(df: DataFrame, tolerances: Mapping[str, float], drop_differences: bool = True) -> DataFrame:
    """Pairs whose values differ by no more than the tolerance or are missing."""
    tolerances = present(df, tolerances)
    if not drop_differences:
        df = df.withColumns({f"{c}_difference": difference(c) for c in tolerances})
    return df.filter(within_tolerances(tolerances))


def fee_match_counts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "NumberFeeMatches": fees.same_fee_count(),
            "NumberNonmissingFees_s": fees.reported_fee_count("_s"),
            "NumberNonmissingFees_p": fees.reported_fee_count("_p"),
            "i_GenerousFeeMatch": fees.any_fee_agrees().cast("int"),
        }
    )


def fee_filter_strict(df: DataFrame) -> DataFrame:
    return df.filter((fees.same_fee_count() >= 1) | fees.no_fees_on_a_side())


def fee_filter_generous(df: DataFrame) -> DataFrame:
    return df.filter(fees.any_fee_agrees() | fees.no_fees_on_a_side())


def match_sex(df: DataFrame) -> DataFrame:
    return df.filter(people.agree_on("sex", df.columns, people.SEX))


def match_sex_pre2018(df: DataFrame) -> DataFrame:
    return df.filter(people.agree_on("sex_pre2018", df.columns, people.SEX_PRE2018))


def match_age(df: DataFrame) -> DataFrame:
    return df.filter(people.age_agrees())


def _strictly(df: DataFrame, trait: str, unknown: Sequence[int], strict: bool) -> DataFrame:
    return df.filter(people.primary_equal(trait, unknown)) if strict else df


def match_race(df: DataFrame, strict: bool = False) -> DataFrame:
    """Compatible races; subcategories are recoded in the output too."""
    same = people.agree_on("race", df.columns, people.RACE_PRE2018)
    agreed = main_categories(df, ("_s", "_p"), ("race",)).filter(same)
    return _strictly(agreed, "race", schema.UNKNOWN_RACES, strict)


def match_race_pre2018(df: DataFrame, strict: bool = False) -> DataFrame:
    return _strictly(df.filter(people.agree_on("race_pre2018", df.columns, people.RACE_PRE2018)), "race", schema.UNKNOWN_RACES, strict)


def match_ethnicity(df: DataFrame, strict: bool = False) -> DataFrame:
    """Compatible ethnicities; subcategories are recoded in the output too."""
    same = people.agree_on("ethnicity", df.columns, people.ETHNICITY)
    agreed = main_categories(df, ("_s", "_p"), ("ethnicity",)).filter(same)
    return _strictly(agreed, "ethnicity", schema.UNKNOWN_ETHNICITY_STRICT, strict)


def match_ethnicity_pre2018(df: DataFrame) -> DataFrame:
    return df.filter(people.agree_on("ethnicity_pre2018", df.columns, people.ETHNICITY_PRE2018))


def purposes_compatible(mode: str) -> Column:
    """Equal purposes, or refinance codes on ``either`` or on ``both`` sides."""
    s, p = F.col("loan_purpose_s"), F.col("loan_purpose_p")
    refinance = [is_true(c.isin(*schema.REFINANCE_PURPOSES)) for c in (s, p)]
    if mode not in ("either", "both"):
        raise ValueError(f"unknown purpose rule {mode!r}")
    return is_true(s == p) | (any_of(refinance) if mode == "either" else all_of(refinance))


def purpose_compat(df: DataFrame, mode: str = "either") -> DataFrame:
    return df.filter(purposes_compatible(mode))


def affiliate_sales(df: DataFrame) -> DataFrame:
    """Purchases, and sales that are reported as made to an affiliate."""
    return df.filter(
        (F.col("action_taken") == schema.PURCHASED) | (F.col("purchaser_type") == schema.AFFILIATE_PURCHASER_TYPE)
    )


def known_sales(df: DataFrame) -> DataFrame:
    """Purchases, and originations that were not kept; an unreported type stays."""
    return df.filter((F.col("action_taken") == schema.PURCHASED) | not_true(F.col("purchaser_type") == 0))


def primary_purchase() -> Column:
    return is_true(F.col("purchaser_type_p").isin(0, 1, 2, 3, 4))


def primary_purchases(df: DataFrame) -> DataFrame:
    return df.filter(primary_purchase())


def sold_to_primary_pre2018(df: DataFrame) -> DataFrame:
    return df.filter(
        (F.col("purchaser_type_s") > 0) & (F.col("purchaser_type_p") <= schema.LAST_PRIMARY_PURCHASER_TYPE)
    )


def amount_direction(df: DataFrame) -> DataFrame:
    """The purchased amount does not exceed the sold one."""
    return df.filter(difference("loan_amount") >= 0)


def amount_direction_pre2018(df: DataFrame) -> DataFrame:
    """Equal amounts, or one thousand less at the purchaser."""
    return df.filter(difference("loan_amount").isin(0, 1))


def income_band_pre2018(df: DataFrame, tolerance: float) -> DataFrame:
    return df.filter(within_or_unknown(difference("income"), tolerance))


def property_type_equal(df: DataFrame) -> DataFrame:
    return df.filter(F.col("property_type_s") == F.col("property_type_p"))


def year_fits_type() -> Column:
    """Sold within the year needs a purchaser type; sold later must lack one."""
    same_year = is_true(F.col("activity_year_s") == F.col("activity_year_p"))
    kept = is_true(F.col("purchaser_type_s") == 0)
    return same_year != kept


def year_type_consistency(df: DataFrame) -> DataFrame:
    return df.filter(year_fits_type())


# --- a pair among its rivals ------------------------------------------------
def over_sides(df: DataFrame, facts: Mapping[str, Column], sides: Sequence[str] = ("s", "p"), ids: rivals.Ids = rivals.BY_ID) -> DataFrame:
    """Add ``<fact>_<side>``: the aggregate over all pairs of the same sale (s)
    or purchase (p)."""
    wide = df
    for side in sides:
        wide = rivals.with_facts(wide, {f"{name}_{side}": fact for name, fact in facts.items()}, side, ids)
    return wide


def closest_rule(gap: Column, tolerance: float) -> rivals.Rule:
    return not_true(gap > F.lit(tolerance)), is_true(gap == 0)


def closest(df: DataFrame, gap: Column, tolerance: float) -> DataFrame:
    """Drop pairs off by more than the tolerance where a rival agrees exactly."""
    return rivals.contest(df, *closest_rule(gap, tolerance))


def weak_numeric_matches(df: DataFrame, tolerances: Mapping[str, float], drop_differences: bool = True) -> DataFrame:
    """`closest` for one column after the other."""
    for column, tolerance in present(df, tolerances).items():
        gap = F.abs(difference(column))
        if drop_differences:
            df = closest(df, gap, tolerance)
        else:
            df = over_sides(df.withColumn(f"{column}_difference", difference(column)), {f"min_{column}_difference": F.min(gap)})
            exact = any_of(is_true(F.col(f"min_{column}_difference_{side}") == 0) for side in ("s", "p"))
            df = df.filter(not_true(gap > F.lit(tolerance)) | ~exact)
    return df


def fee_rule(matches: Column, generous: Column) -> rivals.Rule:
    return is_true(generous), is_true(matches >= 2)


def fee_dominance(df: DataFrame, matches: Column | None = None, generous: Column | None = None) -> DataFrame:
    """Drop pairs without any fee agreement where a rival agrees on two fees."""
    matches = F.col("NumberFeeMatches") if matches is None else matches
    generous = F.col("i_GenerousFeeMatch") == 1 if generous is None else generous
    return rivals.contest(df, *fee_rule(matches, generous))


def income_rule(gap: Column) -> rivals.Rule:
    return is_true(gap <= 1), is_true(gap == 0)


def income_dominance(df: DataFrame, gap: Column | None = None) -> DataFrame:
    """Drop pairs off by more than one (or unknown) where a rival's income is equal."""
    gap = F.abs(difference("income")) if gap is None else gap
    return rivals.contest(df, *income_rule(gap))


def rate_rule(gap: Column) -> rivals.Rule:
    alike = is_true(gap < 0.001)
    return alike, alike


def rate_dominance(df: DataFrame, gap: Column | None = None) -> DataFrame:
    """Drop pairs whose rates differ (or are unknown) where a rival's rate is alike."""
    gap = F.abs(difference("interest_rate")) if gap is None else gap
    return rivals.contest(df, *rate_rule(gap))


def beyond_tolerances(tolerances: Mapping[str, float]) -> Column:
    return any_of(exceeds(difference(c), t) for c, t in tolerances.items())


def drop_sales_where(df: DataFrame, violated: Column) -> DataFrame:
    """Drop every pair of a sale that has one violating pair."""
    return rivals.without_records(df, is_true(violated), "s")


def numeric_matches_post_unique(df: DataFrame, tolerances: Mapping[str, float]) -> DataFrame:
    return drop_sales_where(df, beyond_tolerances(tolerances))


def untidy() -> Column:
    """A rate off by half a basis point or more, or a key fact missing at the seller."""
    return is_true(F.abs(difference("interest_rate")) >= 0.005) | any_of(
        F.col(f"{c}_s").isNull() for c in ("income", "interest_rate", "property_value")
    )


def seller_cleanup(df: DataFrame) -> DataFrame:
    return drop_sales_where(df, untidy())
