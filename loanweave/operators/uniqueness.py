"""Settling which candidate pairs are links."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions.logic import all_of, is_true, within_or_unknown
from loanweave.operators import rivals
from loanweave.operators.pair_filters import difference, over_sides, present

#: Sellers, purchasers and what forms pairs of them, with all their columns as ``_s`` and ``_p``.
Formed = tuple[DataFrame, DataFrame, Callable[[DataFrame, DataFrame], DataFrame]]


def keep_uniques(df: DataFrame, one_to_one: bool = True, secondary: Column | None = None, ids: rivals.Ids = rivals.BY_ID) -> DataFrame:
    """Pairs whose purchase has no other sale and whose sale has no other purchase.

    Without ``one_to_one`` a sale may keep two purchases if one that no other
    sale claims is a secondary-market purchase.
    """
    return _of_purchases(df, unique_pairs(df, one_to_one, secondary, ids, formed=True), ids)


def unique_pairs(
    df: DataFrame,
    one_to_one: bool = True,
    secondary: Column | None = None,
    ids: rivals.Ids = rivals.BY_ID,
    counted: Mapping[str, Column] | None = None,
    carried: Mapping[str, Column] | None = None,
    formed: bool = False,
) -> DataFrame:
    """`keep_uniques` with the ids alone and the facts that are ``carried`` along, so that no row is joined back.

    ``formed`` says that the pairs come from a join and are not written.
    """
    if secondary is None:
        secondary = F.lit(False) if one_to_one else F.col("purchaser_type_p") > schema.LAST_PRIMARY_PURCHASER_TYPE
    columns = [c for side in ids.values() for c in side]
    counted = counted or {side: F.lit(1) for side in ids}
    facts = {"is_secondary": is_true(secondary)} | {f"counts_{side}": counts for side, counts in counted.items()} | dict(carried or {})
    narrow = df.select(*columns, *(fact.alias(name) for name, fact in facts.items()))
    found = rivals.up_to(1 if one_to_one else 2, narrow, {side: F.col(f"counts_{side}") for side in ids}, F.col("is_secondary"), ids, formed)
    return found.select(*columns, *(carried or {}))


def _of_purchases(df: DataFrame, unique: DataFrame, ids: rivals.Ids) -> DataFrame:
    """The pairs of the purchases of the unique pairs; each has one counted pair.

    Spark moves this test below the join that forms the pairs.
    """
    purchases = unique.select([F.col(c).alias(f"single_{c}") for c in ids["p"]])
    return df.join(purchases, rivals.same_ids(ids["p"], purchases.columns), "left_semi")


def _among(df: DataFrame, unique: DataFrame, ids: rivals.Ids) -> DataFrame:
    """The rows of the unique pairs; a purchase may also have rows that are not counted."""
    columns = [c for side in ids.values() for c in side]
    return df.join(unique.withColumnsRenamed({c: f"unique_{c}" for c in columns}), rivals.same_ids(columns, [f"unique_{c}" for c in columns]), "left_semi")


def composite_ids(df: DataFrame) -> dict[str, list[str]]:
    """The 2007-2017 id columns that exist, per side."""
    return {
        side: [f"{c}_{side}" for c in schema.PRE2018_ID_COLUMNS if f"{c}_{side}" in df.columns] for side in ("s", "p")
    }


def keep_uniques_pre2018(df: DataFrame, one_to_one: bool = True) -> DataFrame:
    """`keep_uniques` on the composite id; missing id parts equal each other.

    Only pairs with a known year are counted, as the year is what is counted.
    """
    ids = composite_ids(df)
    unique = unique_pairs_pre2018(df, one_to_one, formed=True)
    return _among(_of_purchases(df, unique, ids), unique, ids)


def unique_pairs_pre2018(
    df: DataFrame, one_to_one: bool = True, carried: Mapping[str, Column] | None = None, formed: bool = False
) -> DataFrame:
    """`unique_pairs` on the composite id."""
    counted = {side: F.col(f"activity_year_{side}") for side in ("s", "p")}
    return unique_pairs(df, one_to_one, None, composite_ids(df), counted, carried, formed)


def match_cardinality(df: DataFrame, ids: rivals.Ids | None = None, formed: Formed | None = None) -> DataFrame:
    """How many pairs have a sale with so many and a purchase with so many candidates.

    Pairs that are ``formed`` by a join need not be written nor moved: they are formed
    once for each count and once with both, which the loans take into the join.
    """
    if formed is None:
        counted = over_sides(df, {"count_index": F.count(F.lit(1))}, ("p", "s"), ids or rivals.BY_ID)
    else:
        counted = _formed_with_counts(df, *formed)
    return counted.groupBy("count_index_s", "count_index_p").agg(F.count(F.lit(1)).alias("pairs"))


def _formed_with_counts(pairs: DataFrame, sellers: DataFrame, purchasers: DataFrame, form: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The pairs with ``count_index_s`` and ``count_index_p``, as `over_sides` counts them: a pair without an id is counted at the purchase only."""
    sold = pairs.dropna(subset=[rivals.PURCHASE]).groupBy(rivals.SALE).agg(F.count(F.lit(1)).alias("count_index"))
    bought = pairs.groupBy(rivals.PURCHASE).agg(F.count(F.lit(1)).alias("count_index"))
    counted = [
        loans.join(counts.withColumnRenamed(column, schema.LOAN_ID), schema.LOAN_ID)
        for loans, counts, column in ((sellers, sold, rivals.SALE), (purchasers, bought, rivals.PURCHASE))
    ]
    return form(*counted)


def filter_attrition(df: DataFrame, tolerances: Mapping[str, float]) -> DataFrame:
    """Pairs that each tolerance drops when they are applied in the given order.

    A pair is tested up to the first tolerance that drops it.
    """
    passes = {c: within_or_unknown(difference(c), t) for c, t in present(df, tolerances).items()}
    dropped_by = F.lit(None).cast("int")
    for n, test in reversed([*enumerate(passes.values())]):
        dropped_by = F.when(~test, n).otherwise(dropped_by)
    counts = [F.count_if(F.col("dropped_by") == n).alias(column) for n, column in enumerate(passes)]
    return df.select(dropped_by.alias("dropped_by")).agg(*counts).unpivot([], list(passes), "column", "dropped")


def observe_attrition(df: DataFrame, tests: Mapping[str, Column], observation: Observation) -> DataFrame:
    """Apply the filters and count each one's losses on the way, without a job of its own."""
    counts, alive = [], F.lit(True)
    for name, test in tests.items():
        counts.append(F.count_if(alive & ~is_true(test)).alias(name))
        alive = alive & is_true(test)
    return df.observe(observation, *counts).filter(all_of(tests.values()))


def crosswalk_by_round(crosswalk: DataFrame, round_column: str = "match_round") -> DataFrame:
    return crosswalk.groupBy(round_column).agg(F.count(F.lit(1)).alias("links"))
