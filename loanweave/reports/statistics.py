"""Match rates, overall and by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.functions.logic import all_of
from loanweave.session import cut_lineage

METRICS = (
    "originations_total", "purchases_total", "links_total", "originations_matched", "purchases_matched",
    "match_rate_originations", "match_rate_purchases", "links_per_matched_origination",
)


def best_link(links: DataFrame, seller: str, purchaser: str, score: str) -> DataFrame:
    """The best-scored link per seller; ties go to the lower purchase id.

    The best row is merged from partial results; the links of a seller are
    neither gathered nor sorted.
    """
    value = F.col(score)
    floats = dict(links.dtypes)[score] in ("double", "float")
    # Least first: scored, not-a-number as the highest score, the higher score, the lower id.
    order = [value.isNull(), ~F.isnan(value) if floats else F.lit(True), F.negate(value)]
    order += [F.col(purchaser)] if purchaser in links.columns else []
    others = [c for c in links.columns if c != seller]
    best = links.groupBy(seller).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("best"))
    return best.select(*[F.col(c) if c == seller else F.col(f"best.{c}").alias(c) for c in links.columns])


def unique_links(matches: DataFrame, keep_top_purchase: bool = True, score_col: str | None = "match_score") -> DataFrame:
    """One link per origination if scored, otherwise distinct links."""
    if keep_top_purchase and score_col is not None and score_col in matches.columns:
        return best_link(matches, "origination_id", "purchase_id", score_col)
    return matches.dropDuplicates(["origination_id", "purchase_id"])


def _ratio(top: str, bottom: str):
    return F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double"))


def overall_match_rates(originations: DataFrame, purchases: DataFrame, links: DataFrame) -> DataFrame:
    """Eight metrics in long form; a rate without a base is null."""
    counts = [
        originations.agg(F.count(F.lit(1)).alias("originations_total")),
        purchases.agg(F.count(F.lit(1)).alias("purchases_total")),
        links.agg(
            F.count(F.lit(1)).alias("links_total"),
            F.count_distinct("origination_id").alias("originations_matched"),
            F.count_distinct("purchase_id").alias("purchases_matched"),
        ),
    ]
    one_row_each = counts[0].unionByName(counts[1], True).unionByName(counts[2], True)
    row = one_row_each.agg(*[F.sum(c).alias(c) for c in one_row_each.columns])
    row = row.withColumns(
        {
            "match_rate_originations": _ratio("originations_matched", "originations_total"),
            "match_rate_purchases": _ratio("purchases_matched", "purchases_total"),
            "links_per_matched_origination": _ratio("links_total", "originations_matched"),
        }
    )
    return row.select([F.col(m).cast("double").alias(m) for m in METRICS]).unpivot([], list(METRICS), "metric", "value")


def match_rate_by(groups: Sequence[str], base: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Per group: base rows, distinct matched keys and their ratio."""
    totals = base.groupBy(*groups).agg(F.count(F.lit(1)).alias("N_total"))
    found = matched.groupBy(*groups).agg(F.count_distinct(key).alias("N_matched"))
    rates = totals.join(found, list(groups), "left").withColumn("N_matched", F.coalesce("N_matched", F.lit(0)))
    return rates.withColumn("match_rate", F.col("N_matched") / F.col("N_total"))


def origination_attributes(links: DataFrame, originations: DataFrame) -> DataFrame:
    """Links with their origination's year, lender and type."""
    facts = originations.select("origination_id", "activity_year", "lei", "loan_type")
    return links.select("origination_id", "purchase_id").join(facts, "origination_id", "left")


def purchase_attributes(links: DataFrame, purchases: DataFrame) -> DataFrame:
    """Links with their purchase's year and purchaser type, as far as known."""
    facts = purchases.select([c for c in ("purchase_id", "activity_year", "purchaser_type") if c in purchases.columns])
    return links.join(facts.withColumnsRenamed({"activity_year": "purc_activity_year"}), "purchase_id", "left")


def enriched_links(links: DataFrame, originations: DataFrame, purchases: DataFrame) -> DataFrame:
    """Links with the attributes of both records and both years."""
    with_origination = origination_attributes(links, originations).withColumnRenamed("activity_year", "orig_activity_year")
    return purchase_attributes(with_origination, purchases)


def _marked(base: DataFrame, links: DataFrame, key: str, groups: Sequence[str]) -> DataFrame:
    """The keys of the base with their groups and whether a link uses them; a key names one record."""
    used = links.select(F.col(key).alias("used_key")).dropDuplicates()
    marked = base.select(key, *groups).join(used, F.col(key) == F.col("used_key"), "left")
    return marked.select(*groups, F.col("used_key").isNotNull().alias("is_matched"))


def rates_by_sets(marked: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rates for several sets of groups from one pass, told apart by ``set_number``.

    A group with a missing part counts its records but no matches, as such
    parts equal nothing.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = marked.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping_id(*columns).alias("set_id"), F.count(F.lit(1)).alias("N_total"), F.count_if("is_matched").alias("N_matched")
    )
    ids = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): n for n, s in enumerate(sets)}
    number = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])[F.col("set_id").cast("int")]
    rows = rows.withColumn("set_number", number)
    known = F.lit(False)
    for n, s in enumerate(sets):
        known = known | ((F.col("set_number") == n) & all_of(F.col(c).isNotNull() for c in s))
    rows = rows.withColumn("N_matched", F.when(known, F.col("N_matched")).otherwise(F.lit(0).cast("long")))
    return rows.withColumn("match_rate", F.col("N_matched") / F.col("N_total")).drop("set_id")


def global_match_rates(
    originations: DataFrame, purchases: DataFrame, matches: DataFrame, keep_top_purchase: bool = True
) -> dict[str, DataFrame | None]:
    """Match rates overall and by year, lender, loan type and purchaser type.

    Groups by year use the origination's year. One pass over the originations,
    marked with their links, gives the groups of all tables; it is written
    once, and the tables are read from it. An id names one record.
    """
    links = cut_lineage(unique_links(matches, keep_top_purchase).select("origination_id", "purchase_id"))
    sets = [["activity_year"], ["lei"], ["loan_type"], ["activity_year", "lei"]]
    rates = cut_lineage(rates_by_sets(_marked(originations, links, "origination_id", ["activity_year", "lei", "loan_type"]), sets))

    def by(number: int) -> DataFrame:
        return rates.filter(F.col("set_number") == number).select(*sets[number], "N_total", "N_matched", "match_rate")

    by_type = None
    if "purchaser_type" in purchases.columns:
        types = rates_by_sets(_marked(purchases, links, "purchase_id", ["purchaser_type"]), [["purchaser_type"]])
        by_type = types.drop("set_number").orderBy(F.desc("N_total"))
    return {
        "overall": overall_match_rates(originations, purchases, links),
        "by_year": by(0).orderBy("activity_year"),
        "by_lei": by(1).orderBy(F.desc("N_total")),
        "by_loan_type": by(2).orderBy(F.desc("N_total")),
        "by_purchaser_type": by_type,
        "by_year_lei": by(3).orderBy("activity_year", F.desc("N_total")),
    }
