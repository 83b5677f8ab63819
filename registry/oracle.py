"""SQL that states each registered query a second time, for the checking engine.

Written from the rules rather than from the Spark code: borrower rules as one
test per code, rounds as one statement per step.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from loanweave import schema
from registry.loans import LOANS_SQL

ORACLE: dict[str, str] = {}

K5 = ("loan_type", "loan_amount", "census_tract", "occupancy_type", "loan_purpose")
K5_FLAG = ("loan_type", "loan_amount", "census_tract", "occupancy_type", "i_Purchase")
FEES = schema.FEE_COLUMNS
IDS = "HMDAIndex_s, HMDAIndex_p"


# --- building blocks ----------------------------------------------------------
def in_list(values) -> str:
    return "(" + ", ".join(repr(v) for v in values) + ")"


def case(column: str, codes: Mapping) -> str:
    lines = " ".join(f"WHEN {column} = '{text}' THEN {'NULL' if v is None else v}" for text, v in codes.items())
    return f"CAST(CASE {lines} ELSE TRY_CAST({column} AS DOUBLE) END AS DOUBLE)"


def true(test: str) -> str:
    return f"coalesce({test}, false)"


def ne(column: str, value) -> str:
    return f"({column} IS DISTINCT FROM {value})"


def statement(*parts: str) -> str:
    """CTEs followed by the final select."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


EXEMPTABLE = ("interest_rate", "loan_term", "intro_rate_period", "income", "property_value", *FEES)
CONVERSIONS = {c: case(c, schema.EXEMPT_CODES) for c in EXEMPTABLE} | {
    "total_units": case("total_units", schema.UNIT_CODES),
    "applicant_age": case("applicant_age", schema.AGE_CODES),
    "co_applicant_age": case("co_applicant_age", schema.AGE_CODES),
    "applicant_age_above_62": case("applicant_age_above_62", schema.YES_NO_CODES),
    "co_applicant_age_above_62": case("co_applicant_age_above_62", schema.YES_NO_CODES),
    "debt_to_income_ratio": case("debt_to_income_ratio", schema.DEBT_RATIO_CODES),
    "conforming_loan_limit": case("conforming_loan_limit", schema.CONFORMING_CODES),
}
BLANKED = (
    "conforming_loan_limit", "construction_method", "income", "total_units", "lien_status", *FEES,
    "interest_rate", "intro_rate_period", "loan_term", "property_value", "open_end_line_of_credit",
)


def replaced(source: str, expressions: Mapping[str, str], more: str = "") -> str:
    items = ", ".join(f"{e} AS {c}" for c, e in expressions.items())
    return f"SELECT * REPLACE ({items}){more} FROM {source}"


def converted(source: str) -> str:
    return replaced(source, CONVERSIONS)


def blanked(source: str) -> str:
    expressions = {c: f"CASE WHEN {c} IN (-1111, 1111, 99999, -99999) OR {c} <= 0 THEN NULL ELSE {c} END" for c in BLANKED}
    period = "CASE WHEN intro_rate_period = loan_term THEN NULL ELSE intro_rate_period END"
    return replaced(f"({replaced(source, expressions)})", {"intro_rate_period": period})


LOANS = f"loans AS MATERIALIZED ({LOANS_SQL})"
LINKABLE = (
    "linkable AS (SELECT * FROM loans WHERE action_taken IN (1, 6) AND "
    "(purchaser_type IS NULL OR purchaser_type NOT IN (1, 2, 3, 4) OR action_taken = 6))"
)
CONVERTED = f"converted AS ({converted('linkable')})"
CLEAN = f"clean AS MATERIALIZED ({blanked('converted')})"
BASE = (LOANS, LINKABLE, CONVERTED, CLEAN)


def present(keys) -> str:
    return " AND ".join(f"{k} IS NOT NULL" for k in keys)


def sides(source: str, prefix: str, on: str, seller_extra: str = "") -> list[str]:
    """Sellers, purchasers and their join; every column is suffixed."""
    return [
        f"{prefix}_sellers AS (SELECT COLUMNS('(.*)') AS '\\1_s' FROM {source} WHERE action_taken = 1)",
        f"{prefix}_purchasers AS (SELECT COLUMNS('(.*)') AS '\\1_p' FROM {source} WHERE action_taken = 6)",
        f"{prefix} AS MATERIALIZED (SELECT * FROM {prefix}_sellers JOIN {prefix}_purchasers ON {on})",
    ]


def equal(keys) -> str:
    return " AND ".join(f"{k}_s = {k}_p" for k in keys)


USABLE = f"usable AS (SELECT * FROM clean WHERE {present(K5)} AND census_tract NOT IN ('', 'NA'))"
PAIRS = (*BASE, USABLE, *sides("usable", "pairs", equal(K5)))


def tolerance(column: str, limit: float) -> str:
    return f"coalesce(abs({column}_s - {column}_p) <= {limit!r}, true)"


def tolerances(limits: Mapping[str, float]) -> str:
    return " AND ".join(tolerance(c, limit) for c, limit in limits.items())


INCOME_AND_RATE = {"income": 1, "interest_rate": 0.0625}
CORE = {
    "interest_rate": 0.0625, "conforming_loan_limit": 0, "construction_method": 0, "intro_rate_period": 6,
    "lien_status": 0, "open_end_line_of_credit": 0, "total_units": 0,
}
FULL = {
    "conforming_loan_limit": 0, "construction_method": 0, "discount_points": 5, "income": 1,
    "interest_rate": 0.0625, "intro_rate_period": 6, "lender_credits": 5, "lien_status": 0, "loan_term": 12,
    "open_end_line_of_credit": 0, "origination_charges": 5, "property_value": 20000, "total_units": 0,
    "applicant_age_above_62": 0, "co_applicant_age_above_62": 0,
}
AFTER = {"income": 1, "interest_rate": 0.0625, "loan_term": 12, "property_value": 20000}
CLOSE = (*PAIRS, f"close_pairs AS MATERIALIZED (SELECT * FROM pairs WHERE {tolerances(INCOME_AND_RATE)})")


# --- borrower rules, one test per code ----------------------------------------
def sex() -> str:
    tests = []
    for who in schema.PEOPLE:
        for code in (1, 2, 3, 5, 6):
            others = [c for c in (1, 2, 3, 5, 6) if c != code]
            tests.append(f"NOT ({true(f'{who}_sex_s = {code}')} AND {true(f'{who}_sex_p IN {in_list(others)}')})")
    return " AND ".join(tests)


def sex_pre2018() -> str:
    tests = [
        f"({ne(f'{who}_sex_s', a)} OR {ne(f'{who}_sex_p', b)})" for who in schema.PEOPLE for a, b in ((1, 2), (2, 1))
    ]
    for a, b in (("s", "p"), ("p", "s")):
        one_or_two = true(f"co_applicant_sex_{b} IN (1, 2)")
        tests.append(f"({ne(f'co_applicant_sex_{a}', 5)} OR NOT {one_or_two})")
    return " AND ".join(tests)


def age() -> str:
    tests = [
        true(f"{who}_age_s = {who}_age_p OR {who}_age_s IN (8888, 9999) OR {who}_age_p IN (8888, 9999)")
        for who in schema.PEOPLE
    ]
    for a, b in (("s", "p"), ("p", "s")):
        known = true(f"co_applicant_age_{b} IN (8888, 9999)")
        tests.append(f"({ne(f'co_applicant_age_{a}', 9999)} OR {known})")
    return " AND ".join(tests)


def trait(name: str, codes, wild, absent: int, strict_wild=None) -> str:
    tests = []
    for who in schema.PEOPLE:
        for a, b in (("s", "p"), ("p", "s")):
            for code in codes:
                found = [f"{who}_{name}_1_{b} IN {in_list((code, *wild))}"]
                found += [f"{who}_{name}_{n}_{b} = {code}" for n in (2, 3, 4, 5)]
                tests.append(f"({ne(f'{who}_{name}_1_{a}', code)} OR {true(' OR '.join(found))})")
    for a, b in (("s", "p"), ("p", "s")):
        known = true(f"co_applicant_{name}_1_{b} IN {in_list(wild)}")
        tests.append(f"({ne(f'co_applicant_{name}_1_{a}', absent)} OR {known})")
    if strict_wild:
        for who in schema.PEOPLE:
            s, p, wild_list = f"{who}_{name}_1_s", f"{who}_{name}_1_p", "(" + ", ".join(map(str, strict_wild)) + ")"
            tests.append(true(f"{s} = {p} OR {s} IN {wild_list} OR {p} IN {wild_list}"))
    return " AND ".join(tests)


def race(strict: bool = False) -> str:
    return trait("race", range(1, 7), (7, 8), 8, (7, 8) if strict else None)


def ethnicity(strict: bool = False) -> str:
    return trait("ethnicity", range(1, 4), (4, 5), 5, (4,) if strict else None)


def ethnicity_pre2018() -> str:
    tests = []
    for who in schema.PEOPLE:
        for a, b in (("s", "p"), ("p", "s")):
            for code in (1, 2, 3):
                known = true(f"{who}_ethnicity_{b} IN ({code}, 4)")
                tests.append(f"({ne(f'{who}_ethnicity_{a}', code)} OR {known})")
    for a, b in (("s", "p"), ("p", "s")):
        known = true(f"co_applicant_ethnicity_{b} IN (4, 5)")
        tests.append(f"({ne(f'co_applicant_ethnicity_{a}', 5)} OR {known})")
    return " AND ".join(tests)


def main_codes(source: str, traits=("race", "ethnicity")) -> str:
    codes = {
        "race": "CASE WHEN {c} BETWEEN 21 AND 27 THEN 2 WHEN {c} BETWEEN 41 AND 44 THEN 4 ELSE {c} END",
        "ethnicity": "CASE WHEN {c} BETWEEN 11 AND 14 THEN 1 ELSE {c} END",
    }
    columns = {
        f"{who}_{t}_{n}_{side}": t for t in traits for who in schema.PEOPLE for n in range(1, 6) for side in ("s", "p")
    }
    return replaced(source, {c: codes[t].replace("{c}", c) for c, t in columns.items()})


# --- fees ---------------------------------------------------------------------
SAME_FEES = "(" + " + ".join(f"CASE WHEN {f}_s = {f}_p THEN 1 ELSE 0 END" for f in FEES) + ")"


def fee_count(side: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {f}_{side} IS NOT NULL THEN 1 ELSE 0 END" for f in FEES) + ")"


ANY_FEE = true(" OR ".join(f"{a}_s = {b}_p" for a in FEES for b in FEES))
NO_FEES = f"({fee_count('s')} = 0 OR {fee_count('p')} = 0)"


# --- steps over rivals --------------------------------------------------------
def rivals(source: str, fact: str, keep: str) -> str:
    """Rows to keep given ``of_sale`` and ``of_purchase``, the aggregate over each."""
    return (
        f"SELECT * EXCLUDE (of_sale, of_purchase) FROM (SELECT *, {fact} OVER (PARTITION BY HMDAIndex_s) AS of_sale, "
        f"{fact} OVER (PARTITION BY HMDAIndex_p) AS of_purchase FROM {source}) WHERE {keep}"
    )


def weak(source: str, column: str, limit: float) -> str:
    gap = f"abs({column}_s - {column}_p)"
    off = true(f"{gap} > {limit!r}")
    return rivals(source, f"min({gap})", f"NOT ({off} AND ({true('of_sale = 0')} OR {true('of_purchase = 0')}))")


def fee_contest(source: str) -> str:
    return rivals(source, f"max(CASE WHEN {SAME_FEES} >= 2 THEN 1 ELSE 0 END)", f"{ANY_FEE} OR (of_sale = 0 AND of_purchase = 0)")


def income_contest(source: str) -> str:
    good = "max(CASE WHEN income_s IS NULL OR income_p IS NULL THEN NULL WHEN income_s = income_p THEN 1 ELSE 0 END)"
    near = true("abs(income_s - income_p) <= 1")
    return rivals(source, good, f"{near} OR ({ne('of_sale', 1)} AND {ne('of_purchase', 1)})")


def rate_contest(source: str) -> str:
    near = "abs(interest_rate_s - interest_rate_p) < 0.001"
    good = f"max(CASE WHEN {near} THEN 1 WHEN NOT ({near}) THEN 0 END)"
    return rivals(source, good, f"{true(near)} OR ({ne('of_sale', 1)} AND {ne('of_purchase', 1)})")


def uniques(source: str, one_to_one: bool = True) -> str:
    counts = (
        f"SELECT *, count(*) OVER (PARTITION BY HMDAIndex_s) AS n_s, count(*) OVER (PARTITION BY HMDAIndex_p) AS n_p FROM {source}"
    )
    if one_to_one:
        return f"SELECT * EXCLUDE (n_s, n_p) FROM ({counts}) WHERE n_s = 1 AND n_p = 1"
    resold = (
        "SELECT *, max(CASE WHEN purchaser_type_p > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY HMDAIndex_s) AS resold "
        f"FROM ({counts}) WHERE n_p = 1"
    )
    return f"SELECT * EXCLUDE (n_s, n_p, resold) FROM ({resold}) WHERE n_s = 1 OR (n_s = 2 AND resold = 1)"


def no_bad_sale(source: str, bad: str) -> str:
    return (
        f"SELECT * EXCLUDE (bad) FROM (SELECT *, max(CASE WHEN {bad} THEN 1 ELSE 0 END) OVER (PARTITION BY HMDAIndex_s) AS bad "
        f"FROM {source}) WHERE bad = 0"
    )


def beyond(limits: Mapping[str, float]) -> str:
    return " OR ".join(true(f"abs({c}_s - {c}_p) > {limit!r}") for c, limit in limits.items())


UNTIDY = (
    f"({true('abs(interest_rate_s - interest_rate_p) >= 0.005')} OR income_s IS NULL OR interest_rate_s IS NULL "
    "OR property_value_s IS NULL)"
)


def where(test: str) -> Callable[[str], str]:
    return lambda source: f"SELECT * FROM {source} WHERE {test}"


def chain(prefix: str, source: str, steps: list[Callable[[str], str]]) -> tuple[list[str], str]:
    parts = []
    for n, step in enumerate(steps):
        parts.append(f"{prefix}_{n} AS ({step(source)})")
        source = f"{prefix}_{n}"
    return parts, source


# --- rounds -------------------------------------------------------------------
def people_steps() -> list[Callable[[str], str]]:
    return [where(age()), where(sex()), main_codes, where(race()), where(ethnicity())]


def purpose(mode: str) -> str:
    both = [true(f"loan_purpose_{x} IN (31, 32)") for x in ("s", "p")]
    refinance = f"({both[0]} {'OR' if mode == 'either' else 'AND'} {both[1]})"
    return f"({true('loan_purpose_s = loan_purpose_p')} OR {refinance})"


YEARS = "activity_year_s <= activity_year_p"


def early_round(rate: float, last: Mapping[str, float], first: list) -> list[Callable[[str], str]]:
    limits = FULL | {"interest_rate": rate} | dict(last)
    return [
        *first,
        where(tolerances(INCOME_AND_RATE)),
        lambda s: weak(s, "interest_rate", 0.01),
        where(f"({SAME_FEES} >= 1 OR {NO_FEES})"),
        uniques,
        *people_steps(),
        where(tolerances(limits)),
        lambda s: no_bad_sale(s, UNTIDY),
    ]


def late_round(first: list, limits: Mapping, contests: list, last: Mapping) -> list[Callable[[str], str]]:
    return [
        where(YEARS),
        *first,
        where(tolerances(limits)),
        *people_steps(),
        where(f"({ANY_FEE} OR {NO_FEES})"),
        *contests,
        lambda s: uniques(s, one_to_one=False),
        lambda s: no_bad_sale(s, beyond(last)),
    ]


def weak_rate(source: str) -> str:
    return weak(source, "interest_rate", 0.01)


RIVAL_STEPS = [rate_contest, fee_contest, income_contest]
TYPE_KNOWN = (
    "(purchaser_type_s = 0 OR EXISTS (SELECT 1 FROM types k WHERE k.lei_s = q.lei_s AND k.lei_p = q.lei_p "
    "AND k.activity_year_s = q.activity_year_s AND k.purchaser_type_s = q.purchaser_type_s))"
)
ROUND_RULES = {
    1: (K5, "census_tract NOT IN ('', 'NA')", "true", 0, True, early_round(0.0625, {}, [])),
    2: (K5, "census_tract <> ''", "true", 1, False, early_round(0.01, {}, [where(YEARS)])),
    3: (K5, "census_tract <> ''", "true", 2, False, late_round([], CORE | {"income": 1}, [weak_rate], AFTER)),
    4: (
        K5_FLAG, "census_tract <> ''", "true", 3, False,
        late_round([], CORE | {"income": 1}, [weak_rate], AFTER) + [],
    ),
    5: (
        ("loan_type", "census_tract", "occupancy_type", "i_Purchase", "LoanAmountMatch"), "census_tract <> ''", "true", 4, True,
        early_round(0.0625, {"loan_amount": 10000}, [])
        + [where("loan_amount_s - loan_amount_p >= 0"), where(true("purchaser_type_p IN (0, 1, 2, 3, 4)"))],
    ),
    6: (
        ("loan_type", "loan_amount", "county_code", "occupancy_type", "i_Purchase"), "true",
        "(action_taken = 6 OR purchaser_type = 8)", 4, False,
        late_round(
            [], CORE,
            [fee_contest, income_contest, weak_rate, lambda s: f"SELECT q.* FROM {s} q JOIN affiliates a ON a.lei_s = q.lei_s AND a.lei_p = q.lei_p"],
            AFTER,
        ),
    ),
    7: (
        K5_FLAG, "census_tract <> ''", "true", 6, False,
        late_round(
            [lambda s: f"SELECT * FROM {s} q WHERE {TYPE_KNOWN}", where(purpose("both"))], CORE, RIVAL_STEPS,
            {"income": 1, "interest_rate": 0.01, "loan_term": 0, "property_value": 10000},
        ),
    ),
    8: (
        K5_FLAG, "census_tract <> ''", f"(action_taken = 6 OR {ne('purchaser_type', 0)})", 7, False,
        late_round(
            [where(purpose("both"))], CORE, RIVAL_STEPS,
            {"income": 2, "interest_rate": 0.01, "loan_term": 12, "property_value": 30000},
        ),
    ),
}
for _n in (4, 6):
    ROUND_RULES[_n][5].insert(2, where(purpose("either")))


def round_parts(number: int, excluded: str | None = None, prefix: str | None = None) -> list[str]:
    """CTEs of one round; the last is named like the prefix and holds its links."""
    keys, tracts, scope, previous, same_year, steps = ROUND_RULES[number]
    name = prefix or f"links{number}"
    crosswalk = excluded or f"crosswalk{previous}"
    unused = "true"
    if excluded or previous:
        unused = f"HMDAIndex NOT IN (SELECT HMDAIndex_s FROM {crosswalk}) AND HMDAIndex NOT IN (SELECT HMDAIndex_p FROM {crosswalk})"
    flagged = "SELECT *, CASE WHEN loan_purpose = 1 THEN 1 ELSE 0 END AS i_Purchase, loan_amount AS LoanAmountMatch FROM clean"
    source = (
        f"{name}_in AS MATERIALIZED (SELECT * FROM ({flagged}) WHERE {present(keys)} AND {tracts} AND {scope} AND {unused})"
    )
    on = equal([*keys, "activity_year"] if same_year else keys)
    if number == 5:
        on = on.replace(
            "LoanAmountMatch_s = LoanAmountMatch_p",
            "LoanAmountMatch_p IN (LoanAmountMatch_s - 10000, LoanAmountMatch_s, LoanAmountMatch_s + 10000)",
        )
    parts, last = chain(f"{name}_step", f"{name}_pairs", steps)
    return [source, *sides(f"{name}_in", f"{name}_pairs", on), *parts, f"{name} AS MATERIALIZED (SELECT {IDS} FROM {last})"]


MATCHED5 = (
    "matched5 AS MATERIALIZED (SELECT c.HMDAIndex_s, c.HMDAIndex_p, c.match_round, s.lei AS lei_s, p.lei AS lei_p, "
    "s.activity_year AS activity_year_s, p.activity_year AS activity_year_p, s.purchaser_type AS purchaser_type_s "
    "FROM crosswalk5 c JOIN loans s ON s.HMDAIndex = c.HMDAIndex_s AND s.action_taken = 1 "
    "JOIN loans p ON p.HMDAIndex = c.HMDAIndex_p AND p.action_taken = 6)"
)
SINGLE = "single AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY HMDAIndex_s) AS n FROM matched5) WHERE n = 1)"
TYPE_COUNTS = (
    "type_counts AS (SELECT *, count(*) OVER (PARTITION BY lei_s, lei_p, activity_year_s) AS CountLEIMatches, "
    "count(*) OVER (PARTITION BY lei_s, lei_p, activity_year_s, purchaser_type_s) AS CountLEIPurchaserTypeMatches "
    f"FROM single WHERE {ne('purchaser_type_s', 0)})"
)
AFFILIATES_ALL = (
    "affiliates_all AS (SELECT DISTINCT lei_s, lei_p FROM type_counts WHERE purchaser_type_s = 8 "
    "AND CountLEIPurchaserTypeMatches / CountLEIMatches >= 0.5 AND CountLEIPurchaserTypeMatches >= 2)"
)
AFFILIATES = "affiliates AS MATERIALIZED (SELECT * FROM affiliates_all WHERE lei_s <> 'L3' AND lei_p <> 'L3')"
TYPES = (
    "types AS MATERIALIZED (SELECT DISTINCT lei_s, lei_p, purchaser_type_s, activity_year_s, CountLEIMatches, "
    "CountLEIPurchaserTypeMatches FROM type_counts WHERE CountLEIPurchaserTypeMatches / CountLEIMatches >= 0.5 "
    "AND CountLEIPurchaserTypeMatches >= 2)"
)


def crosswalk_part(number: int) -> str:
    rounds = " UNION ALL ".join(
        f"SELECT {IDS}, CAST({n} AS INTEGER) AS match_round FROM links{n}" for n in range(1, number + 1)
    )
    return f"crosswalk{number} AS MATERIALIZED ({rounds})"


def upto(number: int) -> list[str]:
    """CTEs of all rounds up to this one and of what they need."""
    parts = list(BASE)
    for n in range(1, number + 1):
        if n == 6:
            parts += RELATIONS
        parts += [*round_parts(n), crosswalk_part(n)]
    return parts


RELATIONS = [MATCHED5, SINGLE, TYPE_COUNTS, AFFILIATES_ALL, AFFILIATES, TYPES]


def related() -> list[str]:
    return upto(5) + RELATIONS


for _n in ROUND_RULES:
    ORACLE[f"post_r{_n}"] = statement(*upto(_n), f"SELECT {IDS}, CAST({_n} AS INTEGER) AS match_round FROM links{_n}")
ORACLE["post_all"] = statement(*upto(8), "SELECT * FROM crosswalk8")
ORACLE["post_r7_after_r2"] = statement(*related(), *round_parts(7, "crosswalk2", "extra"), f"SELECT {IDS} FROM extra")
for _n in (1, 3, 5):
    ORACLE[f"post_r{_n}_crowded"] = statement(*upto(_n), f"SELECT {IDS} FROM links{_n}")

# --- sources and sinks --------------------------------------------------------
ORACLE["resolve_deliveries"] = statement(
    LOANS,
    "SELECT DISTINCT CAST(activity_year AS INTEGER) AS \"Year\", "
    "'delivery=' || CAST(activity_year AS VARCHAR) || '/file=lar.parquet' AS path FROM loans",
)
ORACLE["load_deliveries"] = statement(
    LOANS,
    "SELECT HMDAIndex, activity_year, lei FROM loans WHERE (action_taken = 6 AND purchaser_type IN (0, 1)) OR loan_type > 3",
)
ORACLE["match_columns"] = statement(LOANS, "SELECT HMDAIndex, income, lei FROM loans")
ORACLE["load_linkage_input"] = statement(
    LOANS, LINKABLE, "SELECT HMDAIndex, activity_year, action_taken, purchaser_type, income FROM linkable WHERE loan_type IN (1, 2)"
)
LEGACY = (
    "legacy AS MATERIALIZED (SELECT * EXCLUDE (loan_amount, loan_amount_thousands, income, applicant_ethnicity_1, "
    "co_applicant_ethnicity_1), loan_amount_thousands AS loan_amount, applicant_ethnicity_1 AS applicant_ethnicity, "
    "co_applicant_ethnicity_1 AS co_applicant_ethnicity, "
    "CASE WHEN income = 'Exempt' THEN 9999e0 ELSE TRY_CAST(income AS DOUBLE) END AS income FROM loans)"
)
LEGACY_LINKABLE = LINKABLE.replace("linkable AS", "legacy_linkable AS").replace("FROM loans", "FROM legacy")
LEGACY_BASE = (LOANS, LEGACY, LEGACY_LINKABLE)
ORACLE["load_linkage_input_pre2018"] = statement(
    *LEGACY_BASE, "SELECT HMDAIndex, respondent_id, activity_year, loan_amount, income FROM legacy_linkable"
)
ORACLE["filter_from_tuples"] = statement(
    *BASE,
    "SELECT HMDAIndex, loan_type, loan_amount FROM clean WHERE purchaser_type <> 6 "
    "AND (loan_type IS NULL OR loan_type NOT IN (2, 3)) AND loan_amount >= 50000 AND loan_amount < 300000",
)
for _name in ("append_crosswalk", "append_crosswalk_csv"):
    ORACLE[_name] = statement(*upto(2), "SELECT * FROM crosswalk2")
ORACLE["read_lender_names"] = statement(
    LOANS,
    "SELECT DISTINCT lei, 'BANK ' || lei AS respondent_name_panel, 'BANK ' || lei AS respondent_name_ts FROM loans WHERE lei <> 'L3'",
)
ORACLE["affiliates_sink"] = statement(*related(), "SELECT lei_s, lei_p FROM affiliates_all")
ORACLE["affiliates"] = statement(*related(), "SELECT lei_s, lei_p FROM affiliates")
for _name in ("typed_relationships", "typed_relationships_sink"):
    ORACLE[_name] = statement(*related(), "SELECT * FROM types")
LARGE = (
    "counted AS (SELECT lei_s, lei_p, count(*) OVER (PARTITION BY lei_s) AS cs, count(*) OVER (PARTITION BY lei_p) AS cp, "
    "count(*) OVER (PARTITION BY lei_s, lei_p) AS m FROM single)"
)
LARGE_SELECT = (
    "SELECT DISTINCT lei_s, lei_p FROM counted WHERE (m / cs >= 0.001 OR m / cp >= 0.001) AND (m / cs >= 0.005 OR m / cp >= 0.0005) "
    "AND (m / cs >= 0.0005 OR m / cp >= 0.005) AND (m / cs >= 0.0001 OR m / cp >= 0.01) "
    "AND (m / cs >= 0.01 OR m / cp >= 0.0001) AND cs >= 100 AND cp >= 100"
)
for _name in ("large_relationships", "large_relationships_sink"):
    ORACLE[_name] = statement(*related(), LARGE, LARGE_SELECT)
ORACLE["large_relationships_published"] = ORACLE["large_relationships"].replace("cs >= 100 AND cp >= 100", "cs >= 1000 AND cp >= 1000")
ORACLE["affiliates_published"] = ORACLE["affiliates_sink"].replace(
    "CountLEIPurchaserTypeMatches / CountLEIMatches >= 0.5 AND CountLEIPurchaserTypeMatches >= 2)",
    "CountLEIPurchaserTypeMatches / CountLEIMatches >= 0.95 AND CountLEIPurchaserTypeMatches >= 10)", 1,
)
ORACLE["typed_relationships_published"] = statement(
    *related(),
    "SELECT DISTINCT lei_s, lei_p, purchaser_type_s, activity_year_s, CountLEIMatches, CountLEIPurchaserTypeMatches FROM type_counts "
    "WHERE CountLEIPurchaserTypeMatches / CountLEIMatches >= 0.99 AND CountLEIPurchaserTypeMatches >= 50",
)
ORACLE["single_sale_links"] = statement(*related(), f"SELECT {IDS} FROM single")
ORACLE["matched_loans_sink"] = statement(*related(), f"SELECT {IDS}, match_round, lei_s, lei_p FROM matched5")

# --- cleaning -----------------------------------------------------------------
CONVERTED_ALL = f"converted_all AS ({converted('loans')})"
ORACLE["convert_numerics"] = statement(
    LOANS, CONVERTED_ALL, f"SELECT HMDAIndex, {', '.join(CONVERSIONS)} FROM converted_all"
)
_STRICT = " AND ".join(true(f"{f} = 1111") for f in FEES)
_WEAK = " OR ".join(true(f"{f} = 1111") for f in FEES)
ORACLE["fee_exemption_flags"] = statement(
    LOANS, CONVERTED_ALL,
    f"SELECT HMDAIndex, ({_STRICT}) AS \"i_ExemptFromFeesStrict\", ({_WEAK}) AS \"i_ExemptFromFeesWeak\" FROM converted_all",
)
ORACLE["null_sentinels"] = statement(
    LOANS, CONVERTED_ALL, f"SELECT HMDAIndex, {', '.join(BLANKED)} FROM ({blanked('converted_all')})"
)
_PRE = ("conforming_loan_limit", "income", "discount_points", "lender_credits", "interest_rate")
ORACLE["null_sentinels_pre2018"] = statement(
    LOANS, CONVERTED_ALL,
    "SELECT HMDAIndex, "
    + ", ".join(f"CASE WHEN {c} IN (-1111, 1111, 99999, -99999) THEN NULL ELSE {c} END AS {c}" for c in _PRE)
    + " FROM converted_all",
)
ORACLE["null_income_9999"] = statement(
    LOANS, LEGACY, "SELECT HMDAIndex, CASE WHEN income = 9999 THEN NULL ELSE income END AS income FROM legacy"
)
ORACLE["drop_nonmatch_columns"] = statement(LOANS, "SELECT HMDAIndex, lien_status FROM loans")
ORACLE["drop_nonmatch_columns_pre2018"] = statement(LOANS, "SELECT HMDAIndex, property_type FROM loans")
ORACLE["require_keys"] = statement(*BASE, USABLE, "SELECT HMDAIndex, census_tract FROM usable")
ORACLE["require_keys_blank_tract"] = statement(
    *BASE, f"SELECT HMDAIndex, census_tract FROM clean WHERE {present(K5)} AND census_tract <> ''"
)
ORACLE["require_keys_county"] = statement(
    *BASE,
    f"SELECT HMDAIndex, census_tract FROM clean WHERE {present(('loan_type', 'loan_amount', 'county_code', 'occupancy_type'))}",
)
ORACLE["purchase_purpose_flag"] = statement(
    *BASE, "SELECT HMDAIndex, CASE WHEN loan_purpose = 1 THEN 1 ELSE 0 END AS \"i_Purchase\" FROM clean"
)
ORACLE["loan_amount_bin"] = statement(
    LOANS, LEGACY, "SELECT HMDAIndex, CAST(10 * floor(loan_amount / 10) + 5 AS DOUBLE) AS \"LoanAmountBin\" FROM legacy"
)
ORACLE["suffix_columns"] = statement(*BASE, "SELECT HMDAIndex AS \"HMDAIndex_s\", lei AS lei_s, loan_type FROM clean")
_FIX = {x: f"CASE WHEN income_{x} > 10000 THEN NULL ELSE income_{x} / 1000 END" for x in ("s", "p")}
ORACLE["income_unit_features"] = statement(
    *PAIRS,
    f"SELECT {IDS}, {_FIX['s']} AS income_fix_s, {_FIX['p']} AS income_fix_p, income_s - income_p AS income_diff, "
    f"({_FIX['s']}) - income_p AS income_diff_fix_1, income_s - ({_FIX['p']}) AS income_diff_fix_2 FROM pairs",
)
PRODUCT = (
    "CASE loan_type WHEN 1 THEN 'Conventional' WHEN 2 THEN 'FHA' WHEN 3 THEN 'VA' WHEN 4 THEN 'USDA' ELSE 'Other/Unknown' END"
)
RURAL = (
    "CASE WHEN rural_indicator IN ('1', 'Y', 'y', 'yes', 'YES', 'true', 'TRUE') THEN true "
    "WHEN rural_indicator IN ('0', 'N', 'n', 'no', 'NO', 'false', 'FALSE') THEN false END"
)
ORACLE["product_label"] = statement(LOANS, f"SELECT HMDAIndex, {PRODUCT} AS product FROM loans")
ORACLE["rural_flag"] = statement(LOANS, f"SELECT HMDAIndex, {RURAL} AS is_rural_county FROM loans")

# --- candidate pairs ----------------------------------------------------------
_BOTH = " AND ".join(f"o.{k} = c.{k}" for k in K5)
ORACLE["keep_potential_matches"] = statement(
    *BASE,
    "SELECT HMDAIndex, action_taken FROM clean c WHERE "
    + " AND ".join(f"EXISTS (SELECT 1 FROM clean o WHERE o.action_taken = {a} AND {_BOTH})" for a in (1, 6)),
)
ORACLE["split_sides"] = statement(
    *upto(1),
    "SELECT HMDAIndex, CASE WHEN action_taken = 1 THEN 's' ELSE 'p' END AS side FROM clean WHERE HMDAIndex NOT IN "
    "(SELECT HMDAIndex_s FROM links1) AND HMDAIndex NOT IN (SELECT HMDAIndex_p FROM links1)",
)
ORACLE["block_join"] = statement(*PAIRS, f"SELECT {IDS} FROM pairs")
ORACLE["block_join_crowded"] = statement(*PAIRS, f"SELECT {IDS} FROM pairs WHERE {tolerance('interest_rate', 0.0625)}")
K4 = ("loan_type", "census_tract", "occupancy_type", "loan_purpose")
BANDED = (
    *BASE, USABLE,
    *sides("usable", "banded", equal(K4) + " AND loan_amount_p IN (loan_amount_s - 10000, loan_amount_s, loan_amount_s + 10000)"),
)
ORACLE["band_join_amount"] = statement(*BANDED, f"SELECT {IDS} FROM banded")
ORACLE["amount_direction"] = statement(*BANDED, f"SELECT {IDS} FROM banded WHERE loan_amount_s >= loan_amount_p")
KP = ("loan_type", "loan_amount", "census_tract", "occupancy_type", "property_type", "loan_purpose")
LEGACY_USABLE = (
    f"legacy_usable AS ({replaced('legacy_linkable', {'income': 'CASE WHEN income = 9999 THEN NULL ELSE income END'})} "
    f"WHERE {present(KP)} AND census_tract <> '')"
)
_BIN = "10 * floor(loan_amount_{x} / 10) + 5"
IN_BINS = (
    f"({_BIN.format(x='p')} = {_BIN.format(x='s')} OR "
    f"(loan_amount_s % 10 < 5 AND {_BIN.format(x='p')} = {_BIN.format(x='s')} - 10))"
)
BINNED = (
    *LEGACY_BASE, LEGACY_USABLE,
    *sides("legacy_usable", "binned", f"{equal((*K4, 'activity_year'))} AND {IN_BINS}"),
)
ORACLE["bin_overlap_join"] = statement(*BINNED, f"SELECT {IDS} FROM binned")
ORACLE["amount_direction_pre2018"] = statement(
    *BINNED, f"SELECT {IDS} FROM binned WHERE loan_amount_s - loan_amount_p IN (0, 1)"
)
LEGACY_PAIRS = (*LEGACY_BASE, LEGACY_USABLE, *sides("legacy_usable", "legacy_pairs", equal(KP)))
OTHER_LENDER = (
    "(respondent_id_s IS NULL OR respondent_id_p IS NULL OR respondent_id_s <> respondent_id_p "
    "OR agency_code_s IS NULL OR agency_code_p IS NULL OR agency_code_s <> agency_code_p)"
)
ORACLE["different_lenders"] = statement(*LEGACY_PAIRS, f"SELECT {IDS} FROM legacy_pairs WHERE {OTHER_LENDER}")


def related_pairs() -> list[str]:
    return [*related(), USABLE, *sides("usable", "pairs", equal(K5))]


ORACLE["affiliate_restrict"] = statement(
    *related_pairs(), f"SELECT {IDS}, q.lei_s, q.lei_p FROM pairs q JOIN affiliates a ON a.lei_s = q.lei_s AND a.lei_p = q.lei_p"
)
ORACLE["purchaser_type_check"] = statement(*related_pairs(), f"SELECT {IDS} FROM pairs q WHERE {TYPE_KNOWN}")
ORACLE["year_window"] = statement(*PAIRS, f"SELECT {IDS} FROM pairs WHERE {YEARS}")
ORACLE["year_window_one_year"] = statement(
    *PAIRS, f"SELECT {IDS} FROM pairs WHERE {YEARS} AND activity_year_s + 1 >= activity_year_p"
)
ORACLE["matched_loans"] = statement(
    *upto(2),
    f"SELECT {IDS}, match_round, s.activity_year AS activity_year_s, p.activity_year AS activity_year_p, "
    "s.income AS income_s, p.income AS income_p, s.lei AS lei_s, p.lei AS lei_p FROM crosswalk2 "
    "JOIN loans s ON s.HMDAIndex = HMDAIndex_s JOIN loans p ON p.HMDAIndex = HMDAIndex_p "
    "WHERE s.action_taken = 1 AND p.action_taken = 6",
)


# --- filters on pairs ---------------------------------------------------------
def on_pairs(name: str, test: str, more: str = "") -> None:
    ORACLE[name] = statement(*PAIRS, f"SELECT {IDS}{more} FROM pairs WHERE {test}")


def on_legacy_pairs(name: str, test: str) -> None:
    ORACLE[name] = statement(*LEGACY_PAIRS, f"SELECT {IDS} FROM legacy_pairs WHERE {test}")


def on_rivals(name: str, base: tuple, select: str) -> None:
    ORACLE[name] = statement(*base, f"SELECT {IDS} FROM ({select})")


on_pairs("numeric_matches", tolerances(FULL))
on_pairs(
    "numeric_matches_with_differences", tolerances({"income": 1, "loan_term": 12}),
    ", income_s - income_p AS income_difference, loan_term_s - loan_term_p AS loan_term_difference",
)
on_rivals("weak_numeric_matches", PAIRS, weak("pairs", "interest_rate", 0.01))
on_rivals(
    "weak_numeric_matches_two_columns", (*PAIRS, f"first AS ({weak('pairs', 'interest_rate', 0.01)})"), weak("first", "income", 1)
)
on_rivals("numeric_matches_post_unique", CLOSE, no_bad_sale("close_pairs", beyond(AFTER)))
ORACLE["fee_match_counts"] = statement(
    *PAIRS,
    f"SELECT {IDS}, {SAME_FEES} AS \"NumberFeeMatches\", {fee_count('s')} AS \"NumberNonmissingFees_s\", "
    f"{fee_count('p')} AS \"NumberNonmissingFees_p\", CASE WHEN {ANY_FEE} THEN 1 ELSE 0 END AS \"i_GenerousFeeMatch\" FROM pairs",
)
on_pairs("fee_filter_strict", f"{SAME_FEES} >= 1 OR {NO_FEES}")
on_pairs("fee_filter_generous", f"{ANY_FEE} OR {NO_FEES}")
on_rivals("fee_dominance", PAIRS, fee_contest("pairs"))
on_rivals("income_dominance", PAIRS, income_contest("pairs"))
on_rivals("rate_dominance", PAIRS, rate_contest("pairs"))
on_rivals("seller_cleanup", CLOSE, no_bad_sale("close_pairs", UNTIDY))
on_pairs("match_sex", sex())
on_legacy_pairs("match_sex_pre2018", sex_pre2018())
on_pairs("match_age", age())
_RACE_OUT = ", applicant_race_1_s, applicant_race_1_p"
for _name, _test, _more in (
    ("match_race", race(), _RACE_OUT), ("match_race_strict", race(True), _RACE_OUT),
    ("match_ethnicity", ethnicity(), ", applicant_ethnicity_1_s"),
    ("match_ethnicity_strict", ethnicity(True), ", applicant_ethnicity_1_s"),
):
    ORACLE[_name] = statement(*PAIRS, f"SELECT {IDS}{_more} FROM ({main_codes('pairs')}) WHERE {_test}")
on_legacy_pairs("match_race_pre2018", race())
on_legacy_pairs("match_ethnicity_pre2018", ethnicity_pre2018())
FLAGGED = (
    *BASE,
    "flagged AS (SELECT * FROM (SELECT *, CASE WHEN loan_purpose = 1 THEN 1 ELSE 0 END AS i_Purchase FROM clean) "
    f"WHERE {present(K5_FLAG)} AND census_tract NOT IN ('', 'NA'))",
    *sides("flagged", "flag_pairs", equal(K5_FLAG)),
)
for _mode in ("either", "both"):
    ORACLE[f"purpose_compat_{_mode}"] = statement(*FLAGGED, f"SELECT {IDS} FROM flag_pairs WHERE {purpose(_mode)}")
ORACLE["affiliate_sales"] = statement(*BASE, "SELECT HMDAIndex FROM clean WHERE action_taken = 6 OR purchaser_type = 8")
ORACLE["known_sales"] = statement(
    *BASE, f"SELECT HMDAIndex FROM clean WHERE action_taken = 6 OR {ne('purchaser_type', 0)}"
)
on_pairs("primary_purchases", true("purchaser_type_p IN (0, 1, 2, 3, 4)"))
on_legacy_pairs("sold_to_primary_pre2018", "purchaser_type_s > 0 AND purchaser_type_p <= 4")
on_legacy_pairs("income_band_pre2018", tolerance("income", 5))
on_pairs("property_type_equal", "property_type_s = property_type_p")
on_legacy_pairs(
    "year_type_consistency",
    f"({true('activity_year_s = activity_year_p')} OR {true('purchaser_type_s = 0')}) AND "
    f"(NOT {true('activity_year_s = activity_year_p')} OR {ne('purchaser_type_s', 0)})",
)

# --- uniqueness ---------------------------------------------------------------
on_rivals("keep_uniques", CLOSE, uniques("close_pairs"))
on_rivals("keep_uniques_secondary", CLOSE, uniques("close_pairs", one_to_one=False))
COMPOSITE = ("activity_year", "respondent_id", "agency_code", "sequence_number", "HMDAIndex")


def by_composite(sql: str) -> str:
    for side in ("s", "p"):
        columns = ", ".join(f"{c}_{side}" for c in COMPOSITE)
        sql = sql.replace(f"count(*) OVER (PARTITION BY HMDAIndex_{side})", f"count(activity_year_{side}) OVER (PARTITION BY {columns})")
        sql = sql.replace(f"PARTITION BY HMDAIndex_{side})", f"PARTITION BY {columns})")
    return sql


LEGACY_CLOSE = (*LEGACY_PAIRS, f"legacy_close AS (SELECT * FROM legacy_pairs WHERE {tolerance('income', 5)})")
on_rivals("keep_uniques_pre2018", LEGACY_CLOSE, by_composite(uniques("legacy_close")))
on_rivals("keep_uniques_pre2018_secondary", LEGACY_CLOSE, by_composite(uniques("legacy_close", one_to_one=False)))
ORACLE["match_cardinality"] = statement(
    *CLOSE,
    "SELECT count_index_s, count_index_p, count(*) AS pairs FROM (SELECT count(*) OVER (PARTITION BY HMDAIndex_s) AS count_index_s, "
    "count(*) OVER (PARTITION BY HMDAIndex_p) AS count_index_p FROM close_pairs) GROUP BY ALL",
)


def attrition() -> str:
    lines, alive = [], "true"
    for column, limit in FULL.items():
        test = tolerance(column, limit)
        lines.append(f"SELECT '{column}' AS \"column\", CAST(count(*) FILTER (WHERE {alive} AND NOT {test}) AS BIGINT) AS dropped FROM pairs")
        alive += f" AND {test}"
    return " UNION ALL ".join(lines)


ORACLE["filter_attrition"] = statement(*PAIRS, attrition())
ORACLE["crosswalk_by_round"] = statement(*upto(5), "SELECT match_round, count(*) AS links FROM crosswalk5 GROUP BY 1")

# --- pre-2018 rounds ----------------------------------------------------------
_LEGACY_IDS = ", ".join(f"{c}_{side}" for side in ("s", "p") for c in COMPOSITE)
_KEYS1 = ("loan_type", "census_tract", "occupancy_type", "loan_purpose", "loan_amount")
LEGACY_IN1 = LEGACY_USABLE.replace("legacy_usable", "legacy_in1").replace(present(KP), present(_KEYS1))
_SAME_PEOPLE = f"{sex_pre2018()} AND {race()} AND {ethnicity_pre2018()}"
_parts1, _last1 = chain(
    "legacy1_step", "legacy1_pairs",
    [
        where(tolerance("income", 5)), where(OTHER_LENDER), lambda s: by_composite(uniques(s)),
        where("loan_amount_s - loan_amount_p IN (0, 1)"), where(tolerance("income", 0)), where(_SAME_PEOPLE),
        where("purchaser_type_s > 0"), where("purchaser_type_p <= 4"), where("property_type_s = property_type_p"),
    ],
)
LEGACY_R1 = (
    *LEGACY_BASE, LEGACY_IN1, *sides("legacy_in1", "legacy1_pairs", f"{equal((*K4, 'activity_year'))} AND {IN_BINS}"), *_parts1,
    f"legacy1 AS MATERIALIZED (SELECT {_LEGACY_IDS} FROM {_last1})",
)
_R1_SELECT = f"SELECT {_LEGACY_IDS}, CAST(1 AS INTEGER) AS \"MatchRound\" FROM legacy1"
ORACLE["pre_r1"] = statement(*LEGACY_R1, _R1_SELECT)
ORACLE["write_crosswalk_pre2018"] = ORACLE["pre_r1"]


def not_linked(alias: str) -> str:
    tests = []
    for side in ("s", "p"):
        same = " AND ".join(f"k.{c}_{side} IS NOT DISTINCT FROM {alias}.{c}" for c in COMPOSITE)
        tests.append(f"NOT EXISTS (SELECT 1 FROM legacy1 k WHERE {same})")
    return " AND ".join(tests)


ORACLE["anti_matched_composite"] = statement(
    *LEGACY_R1, f"SELECT HMDAIndex FROM legacy_linkable l WHERE {not_linked('l')}"
)
_parts2, _last2 = chain(
    "legacy2_step", "legacy2_pairs",
    [
        where(YEARS), where("activity_year_s + 1 >= activity_year_p"), where(tolerance("income", 5)), where(OTHER_LENDER),
        lambda s: by_composite(uniques(s)), where(_SAME_PEOPLE), where(tolerance("income", 1)),
        where(f"({true('activity_year_s = activity_year_p')} OR {true('purchaser_type_s = 0')})"),
        where(f"(NOT {true('activity_year_s = activity_year_p')} OR {ne('purchaser_type_s', 0)})"),
        where("purchaser_type_p <= 4"),
    ],
)
ORACLE["pre_r2"] = statement(
    *LEGACY_R1, LEGACY_USABLE, f"legacy_in2 AS (SELECT * FROM legacy_usable l WHERE {not_linked('l')})",
    *sides("legacy_in2", "legacy2_pairs", equal(KP)), *_parts2,
    f"{_R1_SELECT} UNION ALL SELECT {_LEGACY_IDS}, CAST(2 AS INTEGER) AS \"MatchRound\" FROM {_last2}",
)

# --- reports ------------------------------------------------------------------
SCORED = (
    *CLOSE,
    f"scored AS (SELECT {IDS}, HMDAIndex_s AS origination_id, HMDAIndex_p AS purchase_id, "
    "CAST(sequence_number_p * 37 % 100 AS DOUBLE) / 100 AS match_score FROM close_pairs)",
    "best AS MATERIALIZED (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY origination_id "
    "ORDER BY match_score DESC, purchase_id) = 1)",
)
ORACLE["unique_links"] = statement(*SCORED, "SELECT origination_id, purchase_id, match_score FROM best")
ORACLE["unique_links_unscored"] = statement(*SCORED, "SELECT DISTINCT origination_id, purchase_id FROM scored")
ORACLE["unique_matches"] = statement(*SCORED, f"SELECT {IDS} FROM best")
ORACLE["origination_attrs_join"] = statement(
    *SCORED,
    "SELECT origination_id, purchase_id, s.activity_year AS orig_activity_year, s.lei, s.loan_type, "
    "p.activity_year AS purc_activity_year, p.purchaser_type FROM best LEFT JOIN loans s ON s.HMDAIndex = origination_id "
    "AND s.action_taken = 1 LEFT JOIN loans p ON p.HMDAIndex = purchase_id AND p.action_taken = 6",
)
ORACLE["overall_match_rates"] = statement(
    *SCORED,
    "n AS (SELECT (SELECT count(*) FROM loans WHERE action_taken = 1) AS o, (SELECT count(*) FROM loans WHERE action_taken = 6) AS p, "
    "(SELECT count(*) FROM best) AS l, (SELECT count(DISTINCT origination_id) FROM best) AS mo, "
    "(SELECT count(DISTINCT purchase_id) FROM best) AS mp)",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM n"
        for m, v in (
            ("originations_total", "o"), ("purchases_total", "p"), ("links_total", "l"), ("originations_matched", "mo"),
            ("purchases_matched", "mp"), ("match_rate_originations", "mo / o"), ("match_rate_purchases", "mp / p"),
            ("links_per_matched_origination", "l / mo"),
        )
    ),
)


def rate_by(name: str, groups: str, action: int, key: str) -> None:
    columns = groups.split(", ")
    on = " AND ".join(f"t.{g} = m.{g}" for g in columns)
    listed = ", ".join(f"t.{g}" for g in columns)
    ORACLE[name] = statement(
        *SCORED,
        f"t AS (SELECT {groups}, count(*) AS N_total FROM loans WHERE action_taken = {action} GROUP BY ALL)",
        f"m AS (SELECT {groups}, count(DISTINCT {key}) AS n FROM best JOIN loans ON HMDAIndex = {key} GROUP BY ALL)",
        f"SELECT {listed}, N_total AS \"N_total\", coalesce(n, 0) AS \"N_matched\", coalesce(n, 0) / N_total AS match_rate FROM t LEFT JOIN m ON {on}",
    )


rate_by("match_rate_by_year", "activity_year", 1, "origination_id")
rate_by("match_rate_by_lei", "lei", 1, "origination_id")
rate_by("match_rate_by_loan_type", "loan_type", 1, "origination_id")
rate_by("match_rate_by_year_lei", "activity_year, lei", 1, "origination_id")
rate_by("match_rate_by_purchaser_type", "purchaser_type", 6, "purchase_id")

PROFILE = (
    *upto(2),
    f"profiled AS MATERIALIZED (SELECT *, {PRODUCT} AS product, {RURAL} AS is_rural_county, TRY_CAST(property_value AS DOUBLE) AS value2, "
    "HMDAIndex IN (SELECT HMDAIndex_s FROM crosswalk2) AS is_matched FROM loans WHERE action_taken = 1)",
    "unmatched AS (SELECT * FROM profiled WHERE NOT is_matched)",
)
ORACLE["unmatched_originations"] = statement(
    *PROFILE,
    "SELECT HMDAIndex, activity_year, lei, loan_type, product, loan_amount, census_tract, is_rural_county FROM unmatched",
)
ORACLE["unmatched_overall"] = statement(
    *PROFILE,
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM unmatched"
        for m, v in (
            ("N_unmatched", "count(*)"), ("loan_amount_mean", "avg(loan_amount)"), ("loan_amount_median", "median(loan_amount)"),
            ("property_value_mean", "avg(value2)"), ("property_value_median", "median(value2)"),
        )
    ),
)
ORACLE["unmatched_by_year"] = statement(
    *PROFILE,
    "SELECT activity_year, count(*) AS \"N_unmatched\", avg(loan_amount) AS loan_amount_mean, avg(value2) AS property_value_mean, "
    "median(loan_amount) AS loan_amount_median, median(value2) AS property_value_median FROM unmatched GROUP BY 1",
)
for _name, _column in (("product", "product"), ("rural", "is_rural_county")):
    ORACLE[f"unmatched_mix_{_name}"] = statement(
        *PROFILE, f"SELECT {_column}, count(*) AS \"N\", count(*) / (SELECT count(*) FROM unmatched) AS share FROM unmatched GROUP BY 1"
    )


def compared(column: str) -> str:
    return (
        f"SELECT {column}, count(*) FILTER (WHERE is_matched) AS \"N_matched\", "
        "count(*) FILTER (WHERE is_matched) / (SELECT count(*) FROM profiled WHERE is_matched) AS share_matched, "
        "count(*) FILTER (WHERE NOT is_matched) AS \"N_unmatched\", "
        "count(*) FILTER (WHERE NOT is_matched) / (SELECT count(*) FROM unmatched) AS share_unmatched FROM profiled GROUP BY 1"
    )


ORACLE["compare_mix"] = statement(*PROFILE, compared("product"))
ORACLE["mix_outer_join"] = statement(*PROFILE, compared("is_rural_county"))


def numeric_comparison(variable: str, column: str) -> str:
    m, u = f"{column}) FILTER (WHERE is_matched)", f"{column}) FILTER (WHERE NOT is_matched)"
    return (
        f"SELECT '{variable}' AS variable, avg({m} AS matched_mean, avg({u} AS unmatched_mean, median({m} AS matched_median, "
        f"median({u} AS unmatched_median, round((avg({m} - avg({u}) / sqrt((var_samp({m} + var_samp({u}) / 2), 9) AS std_mean_diff FROM profiled"
    )


ORACLE["compare_numeric"] = statement(
    *PROFILE, numeric_comparison("loan_amount", "loan_amount") + " UNION ALL " + numeric_comparison("property_value", "value2")
)
PURCHASES = (
    *upto(2),
    "unbought AS (SELECT HMDAIndex, activity_year, 'Bank ' || lei AS respondent_name, purchaser_type FROM loans "
    "WHERE action_taken = 6 AND HMDAIndex NOT IN (SELECT HMDAIndex_p FROM crosswalk2))",
)
ORACLE["unmatched_purchases"] = statement(*PURCHASES, "SELECT * FROM unbought")
ORACLE["unmatched_purchases_by_year"] = statement(
    *PURCHASES, "SELECT activity_year, count(*) AS \"N_unmatched\" FROM unbought GROUP BY 1"
)
_SHARE = "count(*) AS \"N_unmatched\", count(*) / (SELECT count(*) FROM unbought) AS share FROM unbought GROUP BY 1"
ORACLE["unmatched_purchases_top_inst"] = statement(
    *PURCHASES, f"SELECT respondent_name, {_SHARE} ORDER BY count(*) DESC, respondent_name LIMIT 7"
)
ORACLE["unmatched_purchases_by_type"] = statement(*PURCHASES, f"SELECT purchaser_type, {_SHARE}")


def counterparties(own: str, partner: str, top: int = 5) -> str:
    return (
        f"SELECT {own}, {partner}, match_count, CAST(place AS INTEGER) AS counterparty_rank FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {own} ORDER BY match_count DESC, {partner}) AS place FROM (SELECT {own}, {partner}, count(*) AS match_count "
        f"FROM close_pairs GROUP BY ALL)) WHERE place <= {top}"
    )


ORACLE["top_counterparties_by_seller"] = statement(*CLOSE, counterparties("lei_s", "lei_p"))
ORACLE["top_counterparties_by_purchaser"] = statement(*CLOSE, counterparties("lei_p", "lei_s"))


def spelled(side: str, name: str) -> str:
    return (
        f"{side}_names AS (SELECT DISTINCT lei_{side}, CASE WHEN lei_{side} <> 'L7' OR loan_type_{side} > 2 THEN 'Bank ' ELSE 'bank ' END "
        f"|| lei_{side} AS {name} FROM close_pairs)"
    )


NAMES = (*CLOSE, spelled("s", "seller_name"), spelled("p", "purchaser_name"))
ORACLE["attach_names"] = statement(
    *NAMES,
    "SELECT c.*, seller_name, purchaser_name FROM (SELECT lei_s, lei_p, count(*) AS match_count FROM close_pairs GROUP BY ALL) c "
    "JOIN s_names USING (lei_s) JOIN p_names USING (lei_p)",
)
ORACLE["top_counterparties_named"] = statement(
    *NAMES,
    f"SELECT c.*, seller_name, purchaser_name FROM ({counterparties('lei_s', 'lei_p', 3)}) c JOIN s_names USING (lei_s) JOIN p_names USING (lei_p)",
)
ORACLE["top_counterparties_named_by_purchaser"] = statement(
    *NAMES,
    f"SELECT c.*, seller_name, purchaser_name FROM ({counterparties('lei_p', 'lei_s', 3)}) c JOIN s_names USING (lei_s) JOIN p_names USING (lei_p)",
)
