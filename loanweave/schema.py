"""Column lists and code tables of the loan register.

Everything in this module is a fixed value: results depend on these exact
names, codes and thresholds.
"""

from __future__ import annotations

LOAN_ID = "HMDAIndex"
ORIGINATED = 1
PURCHASED = 6

# Purchaser types whose sales are not searched for a purchase record.
AGENCY_PURCHASER_TYPES = (1, 2, 3, 4)

# Columns never used for linking (left out of the scan).
UNUSED_COLUMNS = (
    "denial_reason", "denial_reason_1", "denial_reason_2", "denial_reason_3", "denial_reason_4",
    "aus", "aus_1", "aus_2", "aus_3", "aus_4", "aus_5",
    "applicant_credit_score_type", "co_applicant_credit_score_type",
    "initially_payable_to_institution", "submission_of_application",
    "tract_population", "tract_minority_population_percent", "ffiec_msa_md_median_family_income",
    "tract_to_msa_income_percentage", "tract_owner_occupied_units", "tract_one_to_four_family_homes",
    "tract_median_age_of_housing_units",
    "derived_loan_product_type", "derived_dwelling_category", "derived_ethnicity", "derived_race", "derived_sex",
)

# The shorter list for general register files, and the one the 2007-2017 rounds drop.
NONMATCH_COLUMNS = (
    "denial_reason", "denial_reason_1", "denial_reason_2", "denial_reason_3", "denial_reason_4",
    "aus", "aus_1", "aus_2", "aus_3", "aus_4", "aus_5",
    "applicant_credit_score_type", "co_applicant_credit_score_type",
    "initially_payable_to_institution", "submission_of_application",
)
PRE2018_DROPPED_COLUMNS = (
    "denial_reason_1", "denial_reason_2", "denial_reason_3", "edit_status", "application_date_indicator",
    "tract_one_to_four_family_units", "derived_loan_product_type", "derived_dwelling_category",
    "derived_ethnicity", "derived_race", "derived_sex", "lien_status", "rate_spread", "hoepa_status",
)

# --- coded text columns -----------------------------------------------------
EXEMPT_CODES = {"Exempt": -99999}
EXEMPTABLE_COLUMNS = (
    "combined_loan_to_value_ratio", "interest_rate", "rate_spread", "loan_term", "prepayment_penalty_term",
    "intro_rate_period", "income", "multifamily_affordable_units", "property_value", "total_loan_costs",
    "total_points_and_fees", "origination_charges", "discount_points", "lender_credits",
)
UNIT_CODES = {"5-24": 5, "25-49": 6, "50-99": 7, "100-149": 8, ">149": 9}
AGE_CODES = {"<25": 1, "25-34": 2, "35-44": 3, "45-54": 4, "55-64": 5, "65-74": 6, ">74": 7}
YES_NO_CODES = {
    "No": 0, "no": 0, "NO": 0, "Yes": 1, "yes": 1, "YES": 1, "Na": None, "na": None, "NA": None,
}
DEBT_RATIO_CODES = {
    "<20%": 10, "20%-<30%": 20, "30%-<36%": 30, "50%-60%": 50, ">60%": 60, "Exempt": -99999,
}
CONFORMING_CODES = {"NC": 0, "C": 1, "U": 1111, "NA": -1111}

PLAIN_NUMERIC_COLUMNS = (
    "activity_year", "loan_type", "loan_purpose", "occupancy_type", "loan_amount", "action_taken", "msa_md",
    "county_code", "applicant_race_1", "applicant_race_2", "applicant_race_3", "applicant_race_4",
    "applicant_race_5", "co_applicant_race_1", "co_applicant_race_2", "co_applicant_race_3",
    "co_applicant_race_4", "co_applicant_race_5", "applicant_sex", "co_applicant_sex", "income",
    "purchaser_type", "denial_reason_1", "denial_reason_2", "denial_reason_3", "edit_status",
    "sequence_number", "rate_spread", "tract_population", "tract_minority_population_percent",
    "ffiec_msa_md_median_family_income", "tract_to_msa_income_percentage", "tract_owner_occupied_units",
    "tract_one_to_four_family_homes", "tract_median_age_of_housing_units",
)

# --- missing-value sentinels ------------------------------------------------
SENTINELS = (-1111, 1111, 99999, -99999)
SENTINEL_COLUMNS = (
    "conforming_loan_limit", "construction_method", "income", "total_units", "lien_status",
    "multifamily_affordable_units", "total_loan_costs", "total_points_and_fees", "discount_points",
    "lender_credits", "origination_charges", "interest_rate", "intro_rate_period", "loan_term",
    "property_value", "balloon_payment", "interest_only_payment", "negative_amortization",
    "open_end_line_of_credit", "other_nonamortizing_features", "prepayment_penalty_term",
    "reverse_mortgage", "business_or_commercial_purpose", "manufactured_home_land_property_",
    "manufactured_home_secured_proper",
)
SENTINEL_COLUMNS_PRE2018 = (
    "conforming_loan_limit", "construction_method", "income", "total_units", "lien_status",
    "open_end_line_of_credit", "multifamily_affordable_units", "discount_points", "lender_credits",
    "origination_charges", "interest_rate", "intro_rate_period", "loan_term", "property_value",
)
FEE_COLUMNS = (
    "total_loan_costs", "total_points_and_fees", "origination_charges", "discount_points", "lender_credits",
)
FEE_EXEMPT_CODE = 1111
UNKNOWN_INCOME_PRE2018 = 9999

# --- borrower codes ---------------------------------------------------------
PEOPLE = ("applicant", "co_applicant")
REPORTED_SEXES = (1, 2, 3, 5, 6)
UNKNOWN_AGES = (8888, 9999)
NO_CO_APPLICANT_AGE = 9999
RACE_RECODES = {2: (21, 22, 23, 24, 25, 26, 27), 4: (41, 42, 43, 44)}
REPORTED_RACES = (1, 2, 3, 4, 5, 6)
UNKNOWN_RACES = (7, 8)
NO_CO_APPLICANT_RACE = 8
ETHNICITY_RECODES = {1: (11, 12, 13, 14)}
REPORTED_ETHNICITIES = (1, 2, 3)
UNKNOWN_ETHNICITIES = (4, 5)
NO_CO_APPLICANT_ETHNICITY = 5
UNKNOWN_ETHNICITY_STRICT = (4,)
REFINANCE_PURPOSES = (31, 32)
LAST_PRIMARY_PURCHASER_TYPE = 4
AFFILIATE_PURCHASER_TYPE = 8

PRODUCT_LABELS = {1: "Conventional", 2: "FHA", 3: "VA", 4: "USDA"}
OTHER_PRODUCT = "Other/Unknown"
TRUE_WORDS = ("1", "Y", "y", "yes", "YES", "true", "TRUE")
FALSE_WORDS = ("0", "N", "n", "no", "NO", "false", "FALSE")

# --- identity ---------------------------------------------------------------
PRE2018_ID_COLUMNS = ("activity_year", "respondent_id", "agency_code", "sequence_number", "HMDAIndex")


def people_columns(trait: str, slots: int) -> list[str]:
    """``applicant_race_1`` ... ``co_applicant_race_<slots>`` for a trait."""
    return [f"{who}_{trait}_{n}" for who in PEOPLE for n in range(1, slots + 1)]
