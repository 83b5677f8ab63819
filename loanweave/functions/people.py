"""Whether the borrowers of the two records of a pair can be the same people.

Most rules have one form: what one record reports *needs* a counterpart in
what the other *offers*, in both directions. Each report is one bit of a long,
so a whole set of rules is two bit tests per pair, and a loan carries two longs
into the join instead of all its borrower columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions.codes import recoded
from loanweave.functions.logic import all_of, differs, is_true

ANYTHING_ELSE = "anything else"


@dataclass(frozen=True)
class Report:
    """One reported trait of one person.

    ``columns``    the slots; the first is the primary one, whose code needs a
                   counterpart in any slot of the other record.
    ``codes``      codes that need a counterpart.
    ``unknown``    primary codes that offer a counterpart to every code.
    ``absent``     the primary code that says there is no such person, which
                   needs one of ``absent_or_unknown`` on the other record.
    ``first_bit``  where the report's bits start.
    """

    columns: tuple[str, ...]
    codes: tuple[int, ...]
    unknown: tuple[int, ...] | str
    first_bit: int
    absent: int | None = None
    absent_or_unknown: tuple[int, ...] = ()
    recodes: Mapping[int, Iterable[int]] = field(default_factory=dict)

    def _bit(self, column: Column) -> Column:
        place = (column + F.lit(self.first_bit)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
        return F.when(column.isin(*self.codes), bit).otherwise(F.lit(0).cast("bigint"))

    def _slot(self, name: str, suffix: str) -> Column:
        return recoded(F.col(f"{name}{suffix}"), self.recodes)

    @property
    def _absent_bit(self) -> Column:
        return F.lit(1 << self.first_bit).cast("bigint")

    def needs(self, suffix: str) -> Column:
        primary = self._slot(self.columns[0], suffix)
        bits = self._bit(primary)
        if self.absent is None:
            return bits
        return F.when(primary == self.absent, self._absent_bit).otherwise(bits)

    def offers(self, suffix: str) -> Column:
        slots = [self._slot(c, suffix) for c in self.columns]
        every_code = F.lit(sum(1 << (self.first_bit + c) for c in self.codes)).cast("bigint")
        if self.unknown == ANYTHING_ELSE:
            wild = ~is_true(slots[0].isin(*self.codes))
        else:
            wild = slots[0].isin(*self.unknown)
        bits = F.when(wild, every_code).otherwise(reduce(Column.bitwiseOR, [self._bit(s) for s in slots]))
        if self.absent is None:
            return bits
        accepted = F.when(slots[0].isin(*self.absent_or_unknown), self._absent_bit).otherwise(F.lit(0).cast("bigint"))
        return bits.bitwiseOR(accepted)


def _slots(name: str, count: int) -> tuple[str, ...]:
    return tuple(f"{name}_{n}" for n in range(1, count + 1))


def _race(first_bits: tuple[int, int], recodes: Mapping) -> tuple[Report, ...]:
    codes, unknown = schema.REPORTED_RACES, schema.UNKNOWN_RACES
    return (
        Report(_slots("applicant_race", 5), codes, unknown, first_bits[0], recodes=recodes),
        Report(
            _slots("co_applicant_race", 5), codes, unknown, first_bits[1],
            schema.NO_CO_APPLICANT_RACE, unknown, recodes,
        ),
    )


def _ethnicity(first_bits: tuple[int, int]) -> tuple[Report, ...]:
    codes, unknown, recodes = schema.REPORTED_ETHNICITIES, schema.UNKNOWN_ETHNICITIES, schema.ETHNICITY_RECODES
    return (
        Report(_slots("applicant_ethnicity", 5), codes, unknown, first_bits[0], recodes=recodes),
        Report(
            _slots("co_applicant_ethnicity", 5), codes, unknown, first_bits[1],
            schema.NO_CO_APPLICANT_ETHNICITY, unknown, recodes,
        ),
    )


# The bit of the no-co-applicant code is the one before the first code's.
RACE = _race((0, 7), schema.RACE_RECODES)
ETHNICITY = _ethnicity((14, 18))
SEX = tuple(
    Report((f"{who}_sex",), schema.REPORTED_SEXES, ANYTHING_ELSE, bit) for who, bit in zip(schema.PEOPLE, (22, 29))
)
PEOPLE = (*RACE, *ETHNICITY, *SEX)
TRAITS = {"race": RACE, "ethnicity": ETHNICITY, "sex": SEX}

RACE_PRE2018 = _race((0, 7), {})
ETHNICITY_PRE2018 = (
    Report(("applicant_ethnicity",), schema.REPORTED_ETHNICITIES, schema.UNKNOWN_ETHNICITY_STRICT, 14),
    Report(
        ("co_applicant_ethnicity",), schema.REPORTED_ETHNICITIES, schema.UNKNOWN_ETHNICITY_STRICT, 18,
        schema.NO_CO_APPLICANT_ETHNICITY, schema.UNKNOWN_ETHNICITIES,
    ),
)
# Only male against female conflicts, and having against lacking a co-applicant.
SEX_PRE2018 = (
    Report(("applicant_sex",), (1, 2), ANYTHING_ELSE, 22),
    Report(("co_applicant_sex",), (1, 2, 5), ANYTHING_ELSE, 29),
)
PEOPLE_PRE2018 = (*RACE_PRE2018, *ETHNICITY_PRE2018, *SEX_PRE2018)
TRAITS_PRE2018 = {"race_pre2018": RACE_PRE2018, "ethnicity_pre2018": ETHNICITY_PRE2018, "sex_pre2018": SEX_PRE2018}


def needs(reports: Iterable[Report], suffix: str = "") -> Column:
    return reduce(Column.bitwiseOR, [r.needs(suffix) for r in reports])


def offers(reports: Iterable[Report], suffix: str = "") -> Column:
    return reduce(Column.bitwiseOR, [r.offers(suffix) for r in reports])


def met(need: Column, offer: Column) -> Column:
    """Whether all needed bits are offered."""
    return need.bitwiseAND(offer) == need


def agree(reports: Iterable[Report]) -> Column:
    """Both directions, from the borrower columns of a pair."""
    reports = tuple(reports)
    return met(needs(reports, "_s"), offers(reports, "_p")) & met(needs(reports, "_p"), offers(reports, "_s"))


def people_bits(reports: Iterable[Report] = PEOPLE) -> dict[str, Column]:
    """The two longs a loan carries for `bits_agree`."""
    reports = tuple(reports)
    return {"people_needs": needs(reports), "people_offers": offers(reports)}


def trait_bits(traits: Mapping[str, Iterable[Report]]) -> dict[str, Column]:
    """Two longs per trait, for rules that test one trait of a pair (`agree_on`)."""
    return {f"{t}_{kind}": bits(reports) for t, reports in traits.items() for kind, bits in (("needs", needs), ("offers", offers))}


def agree_on(trait: str, columns: Iterable[str], reports: Iterable[Report]) -> Column:
    """`agree` on the trait's longs if both records carry them, so that the slots are read per loan, else per pair."""
    carried = {f"{trait}_{kind}{suffix}" for kind in ("needs", "offers") for suffix in ("_s", "_p")} <= set(columns)
    return bits_agree(trait) if carried else agree(reports)


def bits_agree(trait: str = "people") -> Column:
    """`agree` on the longs that both records carry."""
    return met(F.col(f"{trait}_needs_s"), F.col(f"{trait}_offers_p")) & met(
        F.col(f"{trait}_needs_p"), F.col(f"{trait}_offers_s")
    )


def age_agrees() -> Column:
    """Equal ages, or an unknown on either side. A missing age is not a wildcard."""
    unknown = list(schema.UNKNOWN_AGES)

    def agrees(who: str) -> Column:
        s, p = F.col(f"{who}_age_s"), F.col(f"{who}_age_p")
        return is_true((s == p) | s.isin(unknown) | p.isin(unknown))

    cs, cp = F.col("co_applicant_age_s"), F.col("co_applicant_age_p")
    absent = schema.NO_CO_APPLICANT_AGE
    both_absent = (differs(cs, absent) | is_true(cp.isin(unknown))) & (differs(cp, absent) | is_true(cs.isin(unknown)))
    return agrees("applicant") & agrees("co_applicant") & both_absent


def primary_equal(trait: str, unknown: Iterable[int]) -> Column:
    """The strict form: equal primary codes unless one is unknown."""

    def equal(who: str) -> Column:
        s, p = F.col(f"{who}_{trait}_1_s"), F.col(f"{who}_{trait}_1_p")
        return is_true((s == p) | s.isin(list(unknown)) | p.isin(list(unknown)))

    return all_of(equal(who) for who in schema.PEOPLE)
