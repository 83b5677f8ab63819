"""The eight linking rounds for the register from 2018 on.

A round is described by data (`Round`) and run by one plan (`link`):

1. block the loans and keep the pairs that pass every single-pair test. Spark
   folds these tests into the join, so rejected pairs are never materialised;
2. keep of each pair only its two ids and a few facts;
3. let rivals of the same sale or purchase compete, then settle uniqueness. The
   pairs are formed anew for this and not written; what moves are marks on the
   records;
4. apply the tests that come after uniqueness, which were already evaluated
   as one flag in step 2.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions import fees, people
from loanweave.functions.logic import all_of, is_true
from loanweave.operators import candidates, cleaning, rivals
from loanweave.operators import pair_filters as pf
from loanweave.operators.candidates import Blocking, LoanLayout
from loanweave.operators.rivals import Rule
from loanweave.session import cut_lineage, small_methods

SAME_PURPOSE = ("loan_type", "loan_amount", "census_tract", "occupancy_type", "loan_purpose")
SAME_PURCHASE_FLAG = ("loan_type", "loan_amount", "census_tract", "occupancy_type", "i_Purchase")

INCOME_AND_RATE = {"income": 1, "interest_rate": 0.0625}
CORE_TOLERANCES = {
    "interest_rate": 0.0625, "conforming_loan_limit": 0, "construction_method": 0, "intro_rate_period": 6,
    "lien_status": 0, "open_end_line_of_credit": 0, "total_units": 0,
}
FULL_TOLERANCES = {
    "conforming_loan_limit": 0, "construction_method": 0, "discount_points": 5, "income": 1,
    "interest_rate": 0.0625, "intro_rate_period": 6, "lender_credits": 5, "lien_status": 0, "loan_term": 12,
    "open_end_line_of_credit": 0, "origination_charges": 5, "property_value": 20000, "total_units": 0,
    "applicant_age_above_62": 0, "co_applicant_age_above_62": 0,
}
AFTER_UNIQUE = {"income": 1, "interest_rate": 0.0625, "loan_term": 12, "property_value": 20000}
CLOSEST_RATE = 0.01
# Tolerances by which blocks are subdivided: those with many values, calm blocks by the first.
BAND_COLUMNS = ("income", "interest_rate")


@dataclass(frozen=True)
class Round:
    """What distinguishes one round from the others.

    Early rounds (``tidy``) settle uniqueness on income, rate and fees and
    check borrowers and the other values afterwards, pair by pair. Later
    rounds check borrowers first, let rivals compete (``contests``, in order)
    and drop a sale altogether if one of its links is off.
    """

    number: int
    keys: tuple[str, ...]
    tolerances: Mapping[str, float]
    final_tolerances: Mapping[str, float]
    tidy: bool = False
    same_year: bool = False
    excluded_tracts: tuple[str, ...] = ("",)
    scope: str | None = None
    amount_step: float | None = None
    purposes: str | None = None
    contests: tuple[str, ...] = ("closest_rate",)
    needs_affiliates: bool = False
    needs_types: bool = False
    excludes_round: int | None = None

    @property
    def one_to_one(self) -> bool:
        return self.tidy

    @property
    def previous(self) -> int:
        """The round whose crosswalk is excluded; 0 for none."""
        return self.number - 1 if self.excludes_round is None else self.excludes_round


TYPE_KNOWN_CONTESTS = ("rate", "fees", "income")
ROUNDS = {
    r.number: r
    for r in (
        Round(1, SAME_PURPOSE, INCOME_AND_RATE, FULL_TOLERANCES, tidy=True, same_year=True, excluded_tracts=("", "NA")),
        Round(2, SAME_PURPOSE, INCOME_AND_RATE, FULL_TOLERANCES | {"interest_rate": 0.01}, tidy=True),
        Round(3, SAME_PURPOSE, CORE_TOLERANCES | {"income": 1}, AFTER_UNIQUE),
        Round(4, SAME_PURCHASE_FLAG, CORE_TOLERANCES | {"income": 1}, AFTER_UNIQUE, purposes="either"),
        Round(
            5, ("loan_type", "census_tract", "occupancy_type", "i_Purchase", "LoanAmountMatch"), INCOME_AND_RATE,
            FULL_TOLERANCES | {"loan_amount": 10000}, tidy=True, same_year=True, amount_step=10000,
        ),
        # Round 6 excludes the loans of round 4 only, so it may link round 5's again.
        Round(
            6, ("loan_type", "loan_amount", "county_code", "occupancy_type", "i_Purchase"), CORE_TOLERANCES,
            AFTER_UNIQUE, excluded_tracts=(), scope="affiliate", purposes="either",
            contests=("fees", "income", "closest_rate"), needs_affiliates=True, excludes_round=4,
        ),
        Round(
            7, SAME_PURCHASE_FLAG, CORE_TOLERANCES,
            {"income": 1, "interest_rate": 0.01, "loan_term": 0, "property_value": 10000},
            purposes="both", contests=TYPE_KNOWN_CONTESTS, needs_types=True,
        ),
        Round(
            8, SAME_PURCHASE_FLAG, CORE_TOLERANCES,
            {"income": 2, "interest_rate": 0.01, "loan_term": 12, "property_value": 30000},
            scope="known_sale", purposes="both", contests=TYPE_KNOWN_CONTESTS,
        ),
    )
}


# Shared by the keys of all rounds but the fifth and sixth; `block` is their
# combination in one text, as Spark does not co-locate joins on doubles.
LAYOUT_KEYS = ("loan_type", "loan_amount", "occupancy_type", "census_tract")
BLOCK = "block"
PREPARED_COLUMNS = (
    schema.LOAN_ID, BLOCK, "action_taken", "activity_year", "purchaser_type", "lei", "loan_type", "loan_purpose",
    "i_Purchase", "occupancy_type", "loan_amount", "LoanAmountMatch", "census_tract", "county_code",
    *FULL_TOLERANCES, "applicant_age", "co_applicant_age", *schema.FEE_COLUMNS, "fees_reported",
    "people_needs", "people_offers",
)


def _text(keys: Sequence[str]) -> Column:
    """The keys as one text, the tract last; null if one is missing."""
    codes = [(F.col(c) + F.lit(0.0)).cast("string") for c in keys if c != "census_tract"]
    parts = [*codes, *(F.col(c) for c in keys if c == "census_tract")]
    return F.concat(parts[0], *[part for key in parts[1:] for part in (F.lit("|"), key)])


def prepare(loans: DataFrame) -> DataFrame:
    """The cleaning that all rounds share, done once and not per round.

    Codes become numbers and sentinels become nulls. Borrowers' sexes, races
    and ethnicities become two longs, and reported fees a count.
    """
    clean = cleaning.null_sentinels(cleaning.convert_numerics(cleaning.linkage_columns(loans)))
    reported = [*schema.people_columns("race", 5), *schema.people_columns("ethnicity", 5)]
    clean = clean.withColumns({c: F.lit(None).cast("double") for c in reported if c not in clean.columns})
    derived = {BLOCK: _text(LAYOUT_KEYS), "fees_reported": fees.reported_fee_count(), "LoanAmountMatch": F.col("loan_amount")}
    clean = cleaning.purchase_purpose_flag(clean).withColumns(derived | people.people_bits())
    return clean.select([c for c in dict.fromkeys(PREPARED_COLUMNS) if c in clean.columns])


def _in_scope(spec: Round, loans: DataFrame) -> DataFrame:
    if spec.scope == "affiliate":
        loans = pf.affiliate_sales(loans)
    elif spec.scope == "known_sale":
        loans = pf.known_sales(loans)
    return cleaning.require_keys(loans, spec.keys, spec.excluded_tracts)


def _has_layout_keys(spec: Round) -> bool:
    return set(LAYOUT_KEYS) <= set(spec.keys)


def _blocking_keys(spec: Round) -> tuple[str, ...]:
    """`BLOCK` and what it does not hold; rounds on other keys than the layout's have a `BLOCK` of all their keys."""
    if not _has_layout_keys(spec):
        return (BLOCK,)
    keys = (BLOCK, *(k for k in spec.keys if k not in LAYOUT_KEYS))
    return (*keys, "activity_year") if spec.same_year else keys


def same_people() -> Column:
    return people.age_agrees() & people.bits_agree()


def _no_fees() -> Column:
    return (F.col("fees_reported_s") == 0) | (F.col("fees_reported_p") == 0)


def _single_pair_tests(spec: Round, pairs: DataFrame) -> list[Column]:
    tests = [pf.within_tolerances(pf.present(pairs, spec.tolerances))]
    if not spec.same_year:
        tests.append(F.col("activity_year_s") <= F.col("activity_year_p"))
    if spec.purposes:
        tests.append(pf.purposes_compatible(spec.purposes))
    if not spec.tidy:
        tests.append(same_people())
        tests.append(fees.any_fee_agrees() | _no_fees())
    return tests


def _final_test(spec: Round, pairs: DataFrame) -> Column:
    """What a link must fulfil after uniqueness, as far as it depends on the pair alone."""
    tolerances = pf.present(pairs, spec.final_tolerances)
    if not spec.tidy:
        return ~pf.beyond_tolerances(tolerances)
    tests = [same_people(), pf.within_tolerances(tolerances), ~pf.untidy()]
    if spec.amount_step:
        tests += [is_true(pf.difference("loan_amount") >= 0), pf.primary_purchase()]
    return all_of(tests)


def blocking_of(spec: Round, loans: DataFrame, max_block_pairs: int | None = candidates.MAX_BANDED_PAIRS) -> Blocking:
    return Blocking(
        keys=_blocking_keys(spec),
        bands={c: spec.tolerances[c] for c in BAND_COLUMNS if c in spec.tolerances and c in loans.columns},
        max_block_pairs=max_block_pairs,
    )


Sides = tuple[DataFrame, DataFrame]


def _by_own_keys(spec: Round, sides: Sides) -> Sides:
    """Both sides with the round's own keys as `BLOCK`; a seller comes once for each amount that it tries."""
    sellers, purchasers = sides
    if spec.amount_step:
        for key, values in candidates.amount_steps(spec.amount_step).items():
            sellers = sellers.withColumn(key, F.explode(values))
    block = _text([*spec.keys, *(["activity_year"] if spec.same_year else [])])
    return sellers.withColumn(BLOCK, block), purchasers.withColumn(BLOCK, block)


def separate(spec: Round, loans: LoanLayout, blocking: Blocking, crosswalk: DataFrame | None = None) -> tuple[Sides, ...]:
    """The round's sellers and purchasers, not linked before, in calm and, if there are any, in crowded blocks.

    A layout by the round's keys is read where it is. Otherwise both sides are written
    once, as each reading of the pairs moves them, those in calm blocks by `BLOCK`.
    """

    def usable(sides: Sides, apart: bool = True) -> Sides:
        if crosswalk is not None:
            sides = tuple(_not_linked(side, crosswalk, name) for side, name in zip(sides, ("s", "p")))
        return tuple(cut_lineage(side) for side in sides) if apart else sides

    if _has_layout_keys(spec) and loans.serves(blocking.keys):
        calm = usable(candidates.split_sides(_in_scope(spec, loans.calm)), apart=False)
        return (calm,) if loans.crowded is None else (calm, usable(candidates.split_sides(_in_scope(spec, loans.crowded))))
    sides = candidates.split_sides(_in_scope(spec, loans.everything()))
    if not _has_layout_keys(spec):
        sides = _by_own_keys(spec, sides)
    sides = usable(sides)
    crowded = candidates.crowded_blocks(*sides, blocking)
    parts = (sides,) if crowded is None else zip(*(candidates.split_crowded(side, crowded) for side in sides))
    calm, *hot = parts
    return (tuple(side.repartition(BLOCK) for side in calm), *hot)


def _not_linked(loans: DataFrame, crosswalk: DataFrame, side: str) -> DataFrame:
    """Loans whose record the crosswalk does not link; what is moved for it are ids and blocks."""
    used = crosswalk.select(F.col(f"{schema.LOAN_ID}_{side}").alias("used_id")).distinct()
    listed = loans.select(F.col(BLOCK).alias("used_block"), F.col(schema.LOAN_ID).alias("listed_id"))
    linked = cut_lineage(listed.join(used, F.col("listed_id") == F.col("used_id"), "left_semi").distinct())
    return loans.join(linked, (F.col(BLOCK) == F.col("used_block")) & (F.col(schema.LOAN_ID) == F.col("listed_id")), "left_anti")


@dataclass(frozen=True)
class Candidates:
    """The loans of a round, and how their pairs are formed anew on each reading.

    ``parts`` holds sellers and purchasers of calm and, if there are any, of
    crowded blocks.
    """

    spec: Round
    blocking: Blocking
    parts: tuple[Sides, ...]
    types: DataFrame | None = None
    affiliates: DataFrame | None = None

    def facts(self, marks: DataFrame | None = None) -> list[DataFrame]:
        """The pairs of each part that pass all single-pair tests, reduced to block, ids and facts."""
        found = []
        for sides, join in zip(self.parts, (candidates.banded_join, candidates.crowded_join)):
            if marks is not None:
                sides = tuple(rivals.marked(loans, marks, side, BLOCK, schema.LOAN_ID) for loans, side in zip(sides, ("s", "p")))
            found.append(self._narrow(join(*sides, self.blocking)))
        return found

    def _narrow(self, pairs: DataFrame) -> DataFrame:
        spec = self.spec
        pairs = pairs.filter(all_of(_single_pair_tests(spec, pairs)))
        facts = {
            BLOCK: F.col(BLOCK),
            "HMDAIndex_s": F.col("HMDAIndex_s"),
            "HMDAIndex_p": F.col("HMDAIndex_p"),
            "fits": _final_test(spec, pairs),
        }
        if set(spec.contests) & {"closest_rate", "rate"}:
            facts["rate_gap"] = F.abs(pf.difference("interest_rate"))
        if "income" in spec.contests:
            facts["income_gap"] = F.abs(pf.difference("income"))
        if "fees" in spec.contests:
            # Pairs got here by an agreeing fee or for want of fees, never both.
            facts |= {"fee_matches": fees.same_fee_count(), "generous": ~_no_fees()}
        if spec.tidy:
            facts["fees_fit"] = (fees.same_fee_count() >= 1) | _no_fees()
        if not spec.one_to_one:
            facts["secondary"] = is_true(F.col("purchaser_type_p") > schema.LAST_PRIMARY_PURCHASER_TYPE)
        known_by = ["lei_s", "lei_p"] if spec.needs_affiliates else []
        if spec.needs_types:
            known_by = ["lei_s", "lei_p", "activity_year_s", "purchaser_type_s"]
        marks = [c for c in pairs.columns if c.startswith(("won_", "standing_"))]
        facts |= {c: F.col(c) for c in (*known_by, *marks)}
        narrow = pairs.select([expression.alias(name) for name, expression in facts.items()])
        if spec.needs_types:
            narrow = candidates.purchaser_type_check(narrow, self.types).drop(*known_by)
        if self.affiliates is not None:
            listed = self.affiliates.select("lei_s", "lei_p").distinct().withColumn("affiliated", F.lit(True))
            narrow = narrow.join(listed, ["lei_s", "lei_p"], "left").drop(*known_by)
        return narrow


def form(
    spec: Round,
    loans: DataFrame | LoanLayout,
    crosswalk: DataFrame | None = None,
    types: DataFrame | None = None,
    max_block_pairs: int | None = candidates.MAX_BANDED_PAIRS,
    affiliates: DataFrame | None = None,
) -> Candidates:
    """The candidates of a round, without records that were linked before."""
    layout = loans if isinstance(loans, LoanLayout) else LoanLayout(loans)
    blocking = blocking_of(spec, layout.calm, max_block_pairs)
    parts = separate(spec, layout, blocking, crosswalk)
    return Candidates(spec, blocking, parts, types, affiliates if spec.needs_affiliates else None)


def candidate_facts(
    spec: Round,
    loans: DataFrame | LoanLayout,
    crosswalk: DataFrame | None = None,
    types: DataFrame | None = None,
    max_block_pairs: int | None = candidates.MAX_BANDED_PAIRS,
) -> DataFrame:
    """The pairs that pass all single-pair tests, reduced to ids and facts, without records that were linked before."""
    pairs = reduce(DataFrame.unionByName, form(spec, loans, None, types, max_block_pairs).facts()).drop(BLOCK)
    return pairs if crosswalk is None else candidates.unlinked(pairs, crosswalk)


def _contest(name: str) -> Rule:
    if name == "closest_rate":
        return pf.closest_rule(F.col("rate_gap"), CLOSEST_RATE)
    if name == "rate":
        return pf.rate_rule(F.col("rate_gap"))
    if name == "fees":
        return pf.fee_rule(F.col("fee_matches"), F.col("generous"))
    if name == "income":
        return pf.income_rule(F.col("income_gap"))
    raise ValueError(f"unknown contest {name!r}")


def settle(found: Candidates) -> DataFrame:
    """Contests, uniqueness and final tests.

    The pairs are formed anew for each contest, which leaves marks on the
    records, and once more for what is written: the pairs of records that can
    still be linked.
    """
    spec = found.spec
    counts = F.col("fees_fit") if spec.tidy else F.lit(True)
    if spec.needs_affiliates:
        counts = F.col("affiliated")
    counts, most = is_true(counts), 1 if spec.one_to_one else 2

    def undecided(n: int) -> Column:
        return ~F.col(f"won_{n}_s") & ~F.col(f"won_{n}_p")

    rules, marks = [_contest(name) for name in spec.contests], None

    def left(contests: int) -> Column:
        """The pair has passed so many contests."""
        return all_of(stands | undecided(n) for n, (stands, _) in enumerate(rules[:contests]))

    for n, rule in enumerate(rules):
        parts = [pairs.filter(left(n)) for pairs in found.facts(marks)]
        marks = cut_lineage(rivals.marks_of(parts, BLOCK, rule, counts, n))
    last = len(rules) - 1
    standing = {"s": most, "p": 1}
    few = {side: F.col(f"standing_{side}") <= so_many for side, so_many in standing.items()}
    open_ = F.col("standing") <= F.when(F.col("side") == "s", most).otherwise(1)
    marks = marks.filter(open_ | ~F.col(f"won_{last}"))
    stands = rules[last][0]
    kept = (stands & few["s"] & few["p"]) | (~stands & undecided(last) & (few["s"] | few["p"]))
    carried = ["HMDAIndex_s", "HMDAIndex_p", "fits", *([] if spec.one_to_one else ["secondary"]), "standing_s", "standing_p"]
    parts = [pairs.filter(left(last) & counts & kept).select(*carried, (~stands).alias("weak")) for pairs in found.facts(marks)]
    rows = cut_lineage(reduce(DataFrame.unionByName, parts))
    unique = rivals.up_to_marked(most, rows, None if spec.one_to_one else F.col("secondary"))
    links = unique.filter("fits") if spec.one_to_one else pf.drop_sales_where(unique, ~F.col("fits"))
    return links.select("HMDAIndex_s", "HMDAIndex_p")


def lay_out(loans: DataFrame, max_block_pairs: int | None = candidates.MAX_BANDED_PAIRS) -> LoanLayout:
    """Set the loans of crowded blocks apart, by the keys most rounds share.

    Loans that no round can pair by their block are spread: those without one,
    and those of large blocks with one side only. Rounds on other keys read
    the real columns.
    """
    sides = candidates.split_sides(loans.dropna(subset=[BLOCK]))
    blocking = Blocking((BLOCK,), max_block_pairs=max_block_pairs)
    crowded = candidates.crowded_blocks(*sides, blocking)
    lonely = cut_lineage(candidates.lonely_blocks(*sides, BLOCK, int((max_block_pairs or candidates.MAX_BANDED_PAIRS) ** 0.5)))
    calm, apart = (loans, None) if crowded is None else candidates.split_crowded(loans, crowded)
    return LoanLayout(candidates.spread_block(calm, BLOCK, lonely), apart, (BLOCK,))


def link(
    match_round: int | Round,
    loans: DataFrame | LoanLayout,
    crosswalk: DataFrame | None = None,
    affiliates: DataFrame | None = None,
    types: DataFrame | None = None,
    max_block_pairs: int | None = candidates.MAX_BANDED_PAIRS,
) -> DataFrame:
    """New links ``HMDAIndex_s, HMDAIndex_p`` of one round.

    ``loans`` comes from `prepare` (or `lay_out`), ``crosswalk`` holds the links to exclude,
    ``affiliates`` (round 6) and ``types`` (round 7) the known relationships.
    """
    spec = match_round if isinstance(match_round, Round) else ROUNDS[match_round]
    if spec.needs_affiliates and affiliates is None:
        raise ValueError(f"round {spec.number} needs the affiliate list")
    if spec.needs_types and types is None:
        raise ValueError(f"round {spec.number} needs the typed relationships")
    if spec.previous > 0 and crosswalk is None:
        raise ValueError(f"round {spec.number} needs the crosswalk of round {spec.previous}")
    spark = (loans.calm if isinstance(loans, LoanLayout) else loans).sparkSession
    with small_methods(spark):
        return settle(form(spec, loans, crosswalk, types, max_block_pairs, affiliates))
