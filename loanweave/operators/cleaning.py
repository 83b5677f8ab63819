"""Cleaning and projecting loan tables. All steps are row-local."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions.codes import coded_number, number, recoded, without_sentinels
from loanweave.functions.logic import all_of, any_of, is_true, none_of


def linkage_columns(df: DataFrame) -> DataFrame:
    """All columns but those never used for linking."""
    return df.select([c for c in df.columns if c not in schema.UNUSED_COLUMNS])


def convert_numerics(df: DataFrame) -> DataFrame:
    """Turn coded text columns into numbers. Safe to apply twice."""
    tables = {c: schema.EXEMPT_CODES for c in schema.EXEMPTABLE_COLUMNS}
    tables["total_units"] = schema.UNIT_CODES
    tables["debt_to_income_ratio"] = schema.DEBT_RATIO_CODES
    tables["conforming_loan_limit"] = schema.CONFORMING_CODES
    for who in schema.PEOPLE:
        tables[f"{who}_age"] = schema.AGE_CODES
        tables[f"{who}_age_above_62"] = schema.YES_NO_CODES
    types = dict(df.dtypes)
    updates = {c: number(F.col(c), types[c]) for c in schema.PLAIN_NUMERIC_COLUMNS if c in types}
    updates |= {c: coded_number(F.col(c), types[c], codes) for c, codes in tables.items() if c in types}
    return df.withColumns(updates) if updates else df


def fee_exemption_flags(df: DataFrame) -> DataFrame:
    """Loans exempt from fee reporting: all fees (strict) or any fee (weak)."""
    exempt = [is_true(F.col(fee) == schema.FEE_EXEMPT_CODE) for fee in schema.FEE_COLUMNS]
    return df.withColumns({"i_ExemptFromFeesStrict": all_of(exempt), "i_ExemptFromFeesWeak": any_of(exempt)})


def null_sentinels(df: DataFrame) -> DataFrame:
    """Flag fee exemption, then blank sentinel codes and values of zero or less."""
    if set(schema.FEE_COLUMNS) <= set(df.columns):
        df = fee_exemption_flags(df)
    df = df.withColumns(
        {
            c: without_sentinels(F.col(c), schema.SENTINELS, positive_only=True)
            for c in schema.SENTINEL_COLUMNS
            if c in df.columns
        }
    )
    if {"intro_rate_period", "loan_term"} <= set(df.columns):
        period = F.col("intro_rate_period")
        df = df.withColumn("intro_rate_period", F.when(period == F.col("loan_term"), None).otherwise(period))
    return df


def null_sentinels_pre2018(df: DataFrame) -> DataFrame:
    """The 2007-2017 form: sentinel codes only."""
    return df.withColumns(
        {
            c: without_sentinels(F.col(c), schema.SENTINELS, positive_only=False)
            for c in schema.SENTINEL_COLUMNS_PRE2018
            if c in df.columns
        }
    )


def null_income_9999(df: DataFrame, columns: Sequence[str] = ("income_s", "income_p")) -> DataFrame:
    return df.withColumns(
        {c: F.when(F.col(c) == schema.UNKNOWN_INCOME_PRE2018, None).otherwise(F.col(c)) for c in columns}
    )


def drop_nonmatch_columns(df: DataFrame, pre2018_round: bool = False) -> DataFrame:
    """Drop register columns not used for matching, as far as they exist."""
    return df.drop(*(schema.PRE2018_DROPPED_COLUMNS if pre2018_round else schema.NONMATCH_COLUMNS))


def require_keys(df: DataFrame, keys: Sequence[str], excluded_tracts: Sequence[str] = ()) -> DataFrame:
    """Drop rows without a complete blocking key or with an unusable tract."""
    complete = df.dropna(subset=list(keys))
    return complete.filter(none_of(F.col("census_tract"), excluded_tracts)) if excluded_tracts else complete


def purchase_purpose_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("i_Purchase", is_true(F.col("loan_purpose") == 1).cast("int"))


def amount_bin(amount: Column) -> Column:
    """Middle of the ten-wide bin that holds the amount."""
    return (F.lit(10) * F.floor(amount / 10) + F.lit(5)).cast("double")


def loan_amount_bin(df: DataFrame) -> DataFrame:
    return df.withColumn("LoanAmountBin", amount_bin(F.col("loan_amount")))


def suffix_columns(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keep})


def main_categories(df: DataFrame, suffixes: Sequence[str] = ("",), traits: Sequence[str] = ("race", "ethnicity")) -> DataFrame:
    """Recode race and ethnicity subcategories in all slots of both people."""
    recodes = {"race": schema.RACE_RECODES, "ethnicity": schema.ETHNICITY_RECODES}
    names = {
        f"{c}{suffix}": recodes[trait]
        for trait in traits
        for c in schema.people_columns(trait, 5)
        for suffix in suffixes
    }
    return df.withColumns({c: recoded(F.col(c), r) for c, r in names.items() if c in df.columns})


def income_unit_features(df: DataFrame, keep: bool = False) -> DataFrame:
    """Income differences that allow for one side reporting in units instead
    of thousands. Not part of any linking rule, so dropped unless kept."""
    if not keep:
        return df
    s, p = F.col("income_s"), F.col("income_p")
    fixed = {x: F.when(F.col(f"income_{x}") <= 10000, F.col(f"income_{x}") / 1000) for x in ("s", "p")}
    return df.withColumns(
        {
            "income_fix_s": fixed["s"],
            "income_fix_p": fixed["p"],
            "income_diff": s - p,
            "income_diff_fix_1": fixed["s"] - p,
            "income_diff_fix_2": s - fixed["p"],
        }
    )


def product_label(df: DataFrame) -> DataFrame:
    """Readable product name for the loan type."""
    if "loan_type" not in df.columns:
        return df.withColumn("product", F.lit(None).cast("string"))
    label = F.lit(schema.OTHER_PRODUCT)
    for code, name in schema.PRODUCT_LABELS.items():
        label = F.when(F.col("loan_type") == code, F.lit(name)).otherwise(label)
    return df.withColumn("product", label)


def rural_flag(df: DataFrame) -> DataFrame:
    """Boolean rural indicator from whichever source column exists."""
    source = next((c for c in ("is_rural_county", "rural_indicator") if c in df.columns), None)
    if source is None:
        return df.withColumn("is_rural_county", F.lit(None).cast("boolean"))
    column, dtype = F.col(source), dict(df.dtypes)[source]
    if dtype == "boolean":
        flag = column
    elif dtype == "string":
        flag = F.when(column.isin(*schema.TRUE_WORDS), True).when(column.isin(*schema.FALSE_WORDS), False)
    else:
        flag = column != 0
    return df.withColumn("is_rural_county", flag)
