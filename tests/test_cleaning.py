from __future__ import annotations

import pytest
from rows import ids
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions.codes import number
from loanweave.operators import cleaning


def test_number_reads_only_numbers(table):
    texts = ["12", " 7 ", "1e3", "-2.5", "12d", "5f", "NaN", "inf", "Infinity", "", "Exempt", "5-24", None]
    df = table([{"x": t} for t in texts], "x string").select(number(F.col("x"), "string").alias("v"))
    assert [r.v for r in df.collect()] == [12.0, 7.0, 1000.0, -2.5] + [None] * 9


def test_convert_numerics_codes_and_is_idempotent(table):
    rows = [
        {"income": "Exempt", "total_units": "5-24", "applicant_age": "<25", "applicant_age_above_62": "yes", "debt_to_income_ratio": "<20%", "conforming_loan_limit": "NC"},
        {"income": "55", "total_units": ">149", "applicant_age": ">74", "applicant_age_above_62": "No", "debt_to_income_ratio": "41", "conforming_loan_limit": "C"},
        {"income": "x", "total_units": "2", "applicant_age": "8888", "applicant_age_above_62": "NA", "debt_to_income_ratio": "50%-60%", "conforming_loan_limit": "U"},
        {"total_units": "100-149", "applicant_age": "55-64", "debt_to_income_ratio": "Exempt", "conforming_loan_limit": "NA"},
    ]
    columns = "income string, total_units string, applicant_age string, applicant_age_above_62 string, debt_to_income_ratio string, conforming_loan_limit string"
    once = cleaning.convert_numerics(table(rows, columns))
    expected = [
        (-99999.0, 5.0, 1.0, 1.0, 10.0, 0.0),
        (55.0, 9.0, 7.0, 0.0, 41.0, 1.0),
        (None, 2.0, 8888.0, None, 50.0, 1111.0),
        (None, 8.0, 5.0, None, -99999.0, -1111.0),
    ]
    assert [tuple(r) for r in once.collect()] == expected
    assert [tuple(r) for r in cleaning.convert_numerics(once).collect()] == expected


def test_null_sentinels_flags_use_values_before_blanking(table):
    fees = {f: 1111.0 for f in schema.FEE_COLUMNS}
    rows = [
        {"id": "all", **fees, "income": 5.0, "intro_rate_period": 360.0, "loan_term": 360.0},
        {"id": "one", "discount_points": 1111.0, "total_loan_costs": 7.0, "income": 0.0, "intro_rate_period": 60.0, "loan_term": 360.0},
        {"id": "none", "income": -5.0, "intro_rate_period": -1111.0, "loan_term": -1111.0},
        {"id": "nulls", "income": 99999.0},
    ]
    columns = "id string, income double, intro_rate_period double, loan_term double, " + ", ".join(f"{f} double" for f in schema.FEE_COLUMNS)
    out = {r.id: r for r in cleaning.null_sentinels(table(rows, columns)).collect()}
    assert [(out[i].i_ExemptFromFeesStrict, out[i].i_ExemptFromFeesWeak) for i in ("all", "one", "none", "nulls")] == [
        (True, True), (False, True), (False, False), (False, False),
    ]
    assert out["all"].discount_points is None and out["one"].total_loan_costs == 7.0
    assert [out[i].income for i in out] == [5.0, None, None, None]
    # An introductory period as long as the loan is none; missing is not equal to missing.
    assert [out[i].intro_rate_period for i in out] == [None, 60.0, None, None]
    # A zero conforming flag is blanked by the rule for values of zero or less.
    zero = table([{"conforming_loan_limit": 0.0}, {"conforming_loan_limit": 1.0}], "conforming_loan_limit double")
    assert [r[0] for r in cleaning.null_sentinels(zero).collect()] == [None, 1.0]
    assert [r[0] for r in cleaning.null_sentinels_pre2018(zero).collect()] == [0.0, 1.0]


def test_keys_tracts_and_flags(table):
    rows = [{"k": 1.0, "census_tract": t, "loan_purpose": p} for t, p in (("A", 1.0), ("", 2.0), ("NA", None), (None, 1.0))]
    df = table(rows, "k double, census_tract string, loan_purpose double")
    assert ids(cleaning.require_keys(df, ["k", "census_tract"], ("", "NA")), "census_tract") == ["A"]
    assert ids(cleaning.require_keys(df, ["k", "census_tract"], ("",)), "census_tract") == ["A", "NA"]
    assert cleaning.require_keys(df, ["k"]).count() == 4
    assert [r.i_Purchase for r in cleaning.purchase_purpose_flag(df).collect()] == [1, 0, 0, 1]


def test_bins_suffixes_and_labels(table):
    amounts = table([{"loan_amount": a} for a in (0.0, 9.0, 10.0, 14.9, None)], "loan_amount double")
    assert [r.LoanAmountBin for r in cleaning.loan_amount_bin(amounts).collect()] == [5.0, 5.0, 15.0, 15.0, None]
    assert cleaning.suffix_columns(amounts.withColumn("k", F.lit(1)), "_s", ["k"]).columns == ["loan_amount_s", "k"]
    types = table([{"loan_type": x} for x in (1.0, 2.0, 3.0, 4.0, 9.0, None)], "loan_type double")
    labels = [r["product"] for r in cleaning.product_label(types).collect()]
    assert labels == ["Conventional", "FHA", "VA", "USDA", "Other/Unknown", "Other/Unknown"]
    assert cleaning.product_label(amounts).first()["product"] is None


@pytest.mark.parametrize(
    ("column", "dtype", "values", "flags"),
    [
        ("is_rural_county", "string", ["1", "Y", "no", "FALSE", "maybe", None], [True, True, False, False, None, None]),
        ("rural_indicator", "int", [1, 0, 5, None], [True, False, True, None]),
        ("rural_indicator", "boolean", [True, False, None], [True, False, None]),
        ("other", "int", [1], [None]),
    ],
)
def test_rural_flag(table, column, dtype, values, flags):
    df = table([{column: v} for v in values], f"{column} {dtype}")
    assert [r.is_rural_county for r in cleaning.rural_flag(df).collect()] == flags


def test_income_unit_features(table):
    df = table([{"income_s": 55000.0, "income_p": 55.0}, {"income_s": 5000.0, "income_p": 5.0}], "income_s double, income_p double")
    assert cleaning.income_unit_features(df).columns == df.columns
    kept = cleaning.income_unit_features(df, keep=True).collect()
    assert [(r.income_fix_s, r.income_diff_fix_1) for r in kept] == [(None, None), (5.0, 0.0)]
