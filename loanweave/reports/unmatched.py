"""Profiles of the records that no crosswalk link uses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions.codes import number
from loanweave.functions.quantiles import exact_median
from loanweave.operators.cleaning import product_label, rural_flag
from loanweave.reports.statistics import best_link
from loanweave.session import cut_lineage

ORIGINATION_COLUMNS = (
    "HMDAIndex", "activity_year", "lei", "loan_type", "product", "loan_amount", "state_code", "census_tract",
    "is_rural_county",
)
PURCHASE_COLUMNS = ("HMDAIndex", "activity_year", "respondent_name", "purchaser_type")


def unique_matches(
    matches: DataFrame,
    seller: str = "HMDAIndex_s",
    purchaser: str = "HMDAIndex_p",
    score_col: str | None = "match_score",
) -> DataFrame:
    """One link per sale if scored, otherwise distinct links (or sales)."""
    if score_col and score_col in matches.columns:
        return best_link(matches, seller, purchaser, score_col)
    return matches.dropDuplicates([c for c in (seller, purchaser) if c in matches.columns])


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def enriched(df: DataFrame) -> DataFrame:
    return rural_flag(product_label(df))


def _ids(matches: DataFrame, side: str) -> DataFrame:
    return matches.select(F.col(f"HMDAIndex_{side}").alias(schema.LOAN_ID))


def marked_originations(
    originations: DataFrame, matches: DataFrame, numeric_cols: Sequence[str] = ()
) -> DataFrame:
    """Originations with ``is_linked``, reduced to the columns of the profile."""
    linked = _ids(matches, "s").dropDuplicates().withColumn("is_linked", F.lit(True))
    marked = enriched(originations.join(linked, schema.LOAN_ID, "left"))
    kept = _present(marked, dict.fromkeys((*ORIGINATION_COLUMNS, *numeric_cols)))
    return marked.select(*kept, F.coalesce("is_linked", F.lit(False)).alias("is_linked"))


def unmatched_originations(originations: DataFrame, matches: DataFrame) -> DataFrame:
    unmatched = marked_originations(originations, matches).filter("NOT is_linked")
    return unmatched.select(_present(unmatched, ORIGINATION_COLUMNS))


def _as_number(df: DataFrame, column: str) -> Column:
    dtype = dict(df.dtypes)[column]
    return (F.col(column) if dtype not in ("string", "double", "float") else number(F.col(column), dtype)).cast("double")


def _long(df: DataFrame, numeric_cols: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """One row per record and numeric column, for all columns at once."""
    wide = df.select(*groups, *[_as_number(df, c).alias(c) for c in numeric_cols])
    return wide.unpivot(list(groups), list(numeric_cols), "variable", "value")


def _same(a: DataFrame, b: DataFrame, groups: Sequence[str], how: str) -> DataFrame:
    """Null-safe join on columns both tables have."""
    renamed = b.withColumnsRenamed({g: f"other_{g}" for g in groups})
    same = reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"other_{g}")) for g in groups))
    return a.join(renamed, same, how)


def unmatched_overall(unmatched: DataFrame, numeric_cols: Sequence[str] = ("loan_amount",), medians: DataFrame | None = None) -> DataFrame:
    """Count, and mean and exact median per numeric column, in long form; ``medians`` if they are known."""
    total = unmatched.agg(F.lit("N_unmatched").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))
    columns = _present(unmatched, numeric_cols)
    if not columns:
        return total
    values = _long(unmatched, columns)
    means = values.groupBy("variable").agg(F.avg("value").alias("value"))
    found = exact_median(values, ["variable"], "value") if medians is None else medians
    medians = _same(means.select("variable"), found, ["variable"], "left")

    def named(df: DataFrame, ending: str, value: str) -> DataFrame:
        return df.select(F.concat("variable", F.lit(ending)).alias("metric"), F.col(value).alias("value"))

    return total.unionByName(named(means, "_mean", "value")).unionByName(named(medians, "_median", "median"))


def unmatched_by_year(unmatched: DataFrame, numeric_cols: Sequence[str] = ("loan_amount",)) -> DataFrame:
    columns = _present(unmatched, numeric_cols)
    means = [F.avg(_as_number(unmatched, c)).alias(f"{c}_mean") for c in columns]
    result = unmatched.groupBy("activity_year").agg(F.count(F.lit(1)).alias("N_unmatched"), *means)
    if columns:
        values = _long(unmatched, columns, ["activity_year"])  # the medians of all columns together
        medians = exact_median(values, ["activity_year", "variable"], "value")
        wide = [F.max(F.when(F.col("variable") == c, F.col("median"))).alias(f"{c}_median") for c in columns]
        result = _same(result, medians.groupBy("activity_year").agg(*wide), ["activity_year"], "left").drop("other_activity_year")
    return result.orderBy("activity_year")


def mix(df: DataFrame, column: str, count: str = "N", share: str = "share") -> DataFrame:
    """Rows and share of all rows per category."""
    groups = df.groupBy(column).agg(F.count(F.lit(1)).alias(count))
    total = df.agg(F.count(F.lit(1)))
    return groups.withColumn(share, F.col(count) / total.scalar())


def unmatched_mix(unmatched: DataFrame, column: str) -> DataFrame:
    return mix(unmatched, column).orderBy(F.desc("N"))


def _moments(df: DataFrame, columns: Sequence[str], side: str, medians: DataFrame | None) -> DataFrame:
    values = _long(df, columns)
    moments = values.groupBy("variable").agg(
        F.avg("value").alias(f"{side}_mean"), F.var_samp("value").alias(f"{side}_variance")
    )
    medians = exact_median(values, ["variable"], "value") if medians is None else medians
    return _same(moments, medians.withColumnRenamed("median", f"{side}_median"), ["variable"], "left").drop("other_variable")


def compare_numeric(
    matched: DataFrame, unmatched: DataFrame, numeric_cols: Sequence[str] = ("loan_amount",), medians: Sequence[DataFrame] | None = None
) -> DataFrame | None:
    """Mean, median and standardised mean difference of matched against unmatched; ``medians`` of both if they are known.

    The difference is null if a side has fewer than two values or neither varies.
    """
    columns = _present(unmatched, numeric_cols)
    if not columns:
        return None
    table = matched.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("variable"))
    for number, (side, df) in enumerate((("matched", matched), ("unmatched", unmatched))):
        table = _same(table, _moments(df, columns, side, medians and medians[number]), ["variable"], "left").drop("other_variable")
    pooled = F.sqrt((F.col("matched_variance") + F.col("unmatched_variance")) / 2)
    return table.select(
        "variable", "matched_mean", "unmatched_mean", "matched_median", "unmatched_median",
        F.try_divide(F.col("matched_mean") - F.col("unmatched_mean"), pooled).alias("std_mean_diff"),
    )


def compare_mix(matched: DataFrame, unmatched: DataFrame, column: str) -> DataFrame:
    """Category counts and shares of both sides next to each other.

    A category without a value is a category like any other.
    """
    a = mix(matched, column, "N_matched", "share_matched")
    b = mix(unmatched, column, "N_unmatched", "share_unmatched")
    both = _same(a, b, [column], "full_outer")
    category = F.coalesce(column, f"other_{column}").alias(column)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("N_matched", "N_unmatched")]
    shares = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("share_matched", "share_unmatched")]
    return both.select(category, counts[0], shares[0], counts[1], shares[1]).orderBy(F.desc("share_unmatched"))


def profile_unmatched_originations(
    originations: DataFrame, matches: DataFrame, numeric_cols: Sequence[str] | None = None
) -> dict[str, DataFrame | None]:
    """All tables on originations without a link.

    The marked originations are written once; the tables are lazy aggregates.
    """
    numeric = list(numeric_cols or ["loan_amount"])
    marked = cut_lineage(marked_originations(originations, unique_matches(matches), numeric))
    matched, unmatched = marked.filter("is_linked"), marked.filter("NOT is_linked")
    medians = None
    if _present(marked, numeric):  # of both sides and all columns together, once for two tables
        values = _long(marked, _present(marked, numeric), ["is_linked"])
        found = cut_lineage(exact_median(values, ["is_linked", "variable"], "value"))
        medians = [found.filter(F.col("is_linked") == side).drop("is_linked") for side in (True, False)]
    return {
        "summary_unmatched_overall": unmatched_overall(unmatched, numeric, medians and medians[1]),
        "summary_unmatched_by_year": unmatched_by_year(unmatched, numeric),
        "dist_product_unmatched": unmatched_mix(unmatched, "product"),
        "dist_rural_unmatched": unmatched_mix(unmatched, "is_rural_county"),
        "compare_numeric_matched_vs_unmatched": compare_numeric(matched, unmatched, numeric, medians),
        "compare_mix_product": compare_mix(matched, unmatched, "product"),
        "compare_mix_rural": compare_mix(matched, unmatched, "is_rural_county"),
        "unmatched_originations": unmatched.select(_present(unmatched, ORIGINATION_COLUMNS)),
    }


def unmatched_purchases(purchases: DataFrame, matches: DataFrame) -> DataFrame:
    return purchases.join(_ids(matches, "p"), schema.LOAN_ID, "left_anti")


def unmatched_purchases_by_year(unmatched: DataFrame) -> DataFrame:
    return unmatched.groupBy("activity_year").agg(F.count(F.lit(1)).alias("N_unmatched")).orderBy("activity_year")


def unmatched_purchases_top_inst(unmatched: DataFrame, top_n: int = 25) -> DataFrame | None:
    """Institutions with most unmatched purchases, and their share of all."""
    if "respondent_name" not in unmatched.columns:
        return None
    ranked = mix(unmatched, "respondent_name", "N_unmatched")
    return ranked.orderBy(F.desc("N_unmatched"), F.asc_nulls_last("respondent_name")).limit(top_n)


def unmatched_purchases_by_type(unmatched: DataFrame) -> DataFrame | None:
    if "purchaser_type" not in unmatched.columns:
        return None
    return mix(unmatched, "purchaser_type", "N_unmatched").orderBy(F.desc("N_unmatched"))


def profile_unmatched_purchases(purchases: DataFrame, matches: DataFrame, top_n: int = 25) -> dict[str, DataFrame | None]:
    """All tables on purchases without a link."""
    unmatched = unmatched_purchases(purchases, unique_matches(matches))
    return {
        "summary_unmatched_purchases_by_year": unmatched_purchases_by_year(unmatched),
        "unmatched_purchases_by_inst_top": unmatched_purchases_top_inst(unmatched, top_n),
        "unmatched_purchases_by_type": unmatched_purchases_by_type(unmatched),
        "unmatched_purchases": unmatched.select(_present(unmatched, PURCHASE_COLUMNS)),
    }
