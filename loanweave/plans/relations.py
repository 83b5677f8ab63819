"""Matched loans and the lender relationships they reveal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions.logic import not_true
from loanweave.operators.cleaning import suffix_columns

LINK_KEYS = ("HMDAIndex_s", "HMDAIndex_p", "match_round")

# Floors on the share of a seller's and of a purchaser's links that a pair of
# lenders must reach: in every line, one of the two.
RELATIONSHIP_SHARES = ((0.001, 0.001), (0.005, 0.0005), (0.0005, 0.005), (0.0001, 0.01), (0.01, 0.0001))


# The register fields that relationships are read from.
RELATION_COLUMNS = ("HMDAIndex", "lei", "activity_year", "purchaser_type")


def matched_loans(loans: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """All register fields of both records of every link, in name order.

    Each side is reduced to its linked records, by the links alone, before
    its fields move; a record of many links goes with each of them.
    """
    links = crosswalk.select(*LINK_KEYS)

    def records(action: int, side: str) -> DataFrame:
        chosen = suffix_columns(loans.filter(F.col("action_taken") == action), f"_{side}")
        return chosen.join(links, f"HMDAIndex_{side}")

    both = records(schema.ORIGINATED, "s").join(records(schema.PURCHASED, "p"), list(LINK_KEYS))
    return both.select(*LINK_KEYS, *sorted(c for c in both.columns if c not in LINK_KEYS))


def single_sale_links(matched: DataFrame, strict: bool = False) -> DataFrame:
    """Links of sales that have just one.

    The lenient form first keeps all links of sales not made to an agency. A
    sale has one type, so links of a sale are kept or dropped together and the
    second count decides as the first would.
    """
    single = matched.groupBy("HMDAIndex_s").agg(F.count(F.lit(1)).alias("sale_links"), F.any_value(F.struct(*matched.columns)).alias("link"))
    return single.filter("sale_links = 1").select("link.*")


def _type_counts(matched: DataFrame, strict: bool) -> DataFrame:
    """Links per lender pair, year and sale type, and per lender pair and year.

    The second count sums the first, so the loans are shuffled once and the
    sums move only aggregated rows.
    """
    lenders = ["lei_s", "lei_p", "activity_year_s"]
    known = single_sale_links(matched.select("HMDAIndex_s", *lenders, "purchaser_type_s"), strict).filter(not_true(F.col("purchaser_type_s") == 0))
    typed = known.groupBy(*lenders, "purchaser_type_s").agg(F.count("activity_year_s").alias("CountLEIPurchaserTypeMatches"))
    total = F.sum("CountLEIPurchaserTypeMatches").over(Window.partitionBy(*lenders))
    return typed.withColumn("CountLEIMatches", total).dropna(subset=[*lenders, "purchaser_type_s"])


def _typical(min_share: float, min_links: int) -> Column:
    share = F.col("CountLEIPurchaserTypeMatches") / F.col("CountLEIMatches")
    return (share >= min_share) & (F.col("CountLEIPurchaserTypeMatches") >= min_links)


def affiliate_candidates(
    matched: DataFrame, strict: bool = False, min_share: float = 0.95, min_links: int = 10
) -> DataFrame:
    """Lender pairs that mostly report sales to affiliates in some year, in lender order."""
    typed = _type_counts(matched, strict).filter(F.col("purchaser_type_s") == schema.AFFILIATE_PURCHASER_TYPE)
    return typed.filter(_typical(min_share, min_links)).select("lei_s", "lei_p").dropDuplicates().orderBy("lei_s", "lei_p")


def named_affiliates(affiliates: DataFrame, lender_names: DataFrame) -> DataFrame:
    """Affiliates of which both lenders are in the name list."""
    known = lender_names.select("lei").dropDuplicates()
    named = affiliates
    for side in ("s", "p"):
        named = named.join(known.withColumnRenamed("lei", f"lei_{side}"), f"lei_{side}", "left_semi")
    return named.select("lei_s", "lei_p").dropDuplicates()


def affiliates(matched: DataFrame, lender_names: DataFrame, **thresholds) -> DataFrame:
    return named_affiliates(affiliate_candidates(matched, **thresholds), lender_names)


def typed_relationships(
    matched: DataFrame, strict: bool = False, min_share: float = 0.99, min_links: int = 50
) -> DataFrame:
    """The sale type of frequent lender pairs, per year, in lender order."""
    typed = _type_counts(matched, strict).filter(_typical(min_share, min_links))
    columns = ["lei_s", "lei_p", "purchaser_type_s", "activity_year_s", "CountLEIMatches", "CountLEIPurchaserTypeMatches"]
    return typed.select(*columns).orderBy("lei_s", "lei_p", "activity_year_s", "purchaser_type_s")


def large_relationships(matched: DataFrame, strict: bool = False, min_links: int = 1000) -> DataFrame:
    """Pairs of large lenders that share more than a negligible part of their links."""
    pairs = (
        single_sale_links(matched.select("HMDAIndex_s", "lei_s", "lei_p"), strict)
        .groupBy("lei_s", "lei_p")
        .agg(F.count(F.lit(1)).alias("CountMatches"))
    )
    for side, name in (("s", "CountSeller"), ("p", "CountPurchaser")):
        totals = pairs.groupBy(f"lei_{side}").agg(F.sum("CountMatches").alias(name))
        pairs = pairs.join(totals.filter(F.col(name) >= min_links), f"lei_{side}")
    of_seller = F.col("CountMatches") / F.col("CountSeller")
    of_purchaser = F.col("CountMatches") / F.col("CountPurchaser")
    for seller_share, purchaser_share in RELATIONSHIP_SHARES:
        pairs = pairs.filter((of_seller >= seller_share) | (of_purchaser >= purchaser_share))
    return pairs.select("lei_s", "lei_p")
